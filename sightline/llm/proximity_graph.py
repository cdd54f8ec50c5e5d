"""A robust-pruned directed proximity graph over the vectors of one shard, built and searched in batches.

Vectors enter in batches that at most double the graph. A greedy beam search over the graph so far
proposes each newcomer's neighbours, together with the nearest of its own batch; relaxed pruning keeps a
diverse few of them (a candidate goes if a kept one is nearer to it by the factor ``alpha``), and every
kept edge is offered back to its end, which is pruned again when it has too many. All steps work on
arrays over the whole batch.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512  # queries that search together
ENTRIES = 512  # vectors a search looks at first; the nearest of them are where it begins


class ProximityGraph:
    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 32, alpha: float = 1.2, width: int = 4, seed: int = 7):
        n = len(vectors)
        self.n, self.degree, self.beam, self.width, self.alpha2 = n, degree, beam, width, alpha * alpha
        self.x = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)]).astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.norm[n] = np.inf  # the last row stands for "no neighbour"
        self.edges = np.full((n + 1, degree), n, np.int32)
        self.length = np.full((n + 1, degree), np.inf, np.float32)
        order = np.random.RandomState(seed).permutation(n).astype(np.int32)
        self.entries = order[: min(n, 48)]
        self._insert(order[: min(n, 48)], first=True)
        done = min(n, 48)
        while done < n:
            size = min(done, 1024, n - done)
            self._insert(order[done : done + size], first=False)
            done += size
            self.entries = order[: min(done, ENTRIES)]

    def search(self, queries: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the vectors left in each query's beam, nearest first."""
        beam = beam or self.beam
        ids = np.full((len(queries), beam), self.n, np.int32)
        dist = np.full((len(queries), beam), np.inf, np.float32)
        for s in range(0, len(queries), BLOCK):
            ids[s : s + BLOCK], dist[s : s + BLOCK] = self._search(np.ascontiguousarray(queries[s : s + BLOCK]), beam)
        return ids, dist

    def search_own(self, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for every vector of the graph, beginning at its own edges; it is not in its own beam."""
        beam = beam or self.beam
        ids = np.full((self.n, beam), self.n, np.int32)
        dist = np.full((self.n, beam), np.inf, np.float32)
        for s in range(0, self.n, BLOCK):
            rows = np.arange(s, min(s + BLOCK, self.n))
            ids[rows], dist[rows] = self._search(self.x[rows], beam, rows)
        return ids, dist

    def _search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        b, n, width = len(q), self.n, self.width
        out_ids, out_dist = np.full((b, beam), n, np.int32), np.full((b, beam), np.inf, np.float32)
        qn = np.einsum("ij,ij->i", q, q)
        ids = np.full((b, beam + 1), n, np.int32)
        dist = np.full((b, beam + 1), np.inf, np.float32)
        seen = np.zeros((b, n + 1), bool)
        if own is None:
            e = self.entries
            d = qn[:, None] + self.norm[e][None] - 2 * (q @ self.x[e].T)
            first = np.argpartition(d, beam, axis=1)[:, :beam] if beam < len(e) else np.tile(np.arange(len(e)), (b, 1))
            first = np.take_along_axis(first, np.argsort(np.take_along_axis(d, first, 1), axis=1), 1)
            ids[:, : first.shape[1]] = e[first]
            dist[:, : first.shape[1]] = np.take_along_axis(d, first, 1)
            seen[:, e] = True
        else:
            first = np.argsort(self.length[own], axis=1)[:, :beam]
            ids[:, : first.shape[1]] = np.take_along_axis(self.edges[own], first, 1)
            dist[:, : first.shape[1]] = np.take_along_axis(self.length[own], first, 1)
            seen[np.arange(b)[:, None], self.edges[own]] = True
            seen[np.arange(b), own] = True
        seen[:, n] = True
        open_ = np.isfinite(dist)
        row = np.arange(b)
        places = np.arange(beam + 1)
        while True:
            active = open_.any(1)
            if not active.all():
                out_ids[row[~active]], out_dist[row[~active]] = ids[~active, :beam], dist[~active, :beam]
                if not active.any():
                    return out_ids, out_dist
                ids, dist, open_, row = ids[active], dist[active], open_[active], row[active]
            at = np.arange(len(row))[:, None]
            chosen = np.partition(np.where(open_, places, beam), width - 1, axis=1)[:, :width]
            open_[at, chosen] = False
            near = np.sort(self.edges[ids[at, chosen]].reshape(len(row), -1), axis=1)
            fresh = ~seen[row[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(fresh)
            flat = near[r, c]
            seen[row[r], flat] = True
            dots = np.einsum("ij,ij->i", self.x[flat], q[row[r]])
            found = np.full(near.shape, np.inf, np.float32)
            found[r, c] = qn[row[r]] + self.norm[flat] - 2 * dots
            all_dist = np.concatenate([dist[:, :beam], found], axis=1)
            best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_dist, best, 1), axis=1), 1)
            all_ids = np.concatenate([ids[:, :beam], near], axis=1)
            all_open = np.concatenate([open_[:, :beam], fresh], axis=1)
            ids[:, :beam] = np.take_along_axis(all_ids, best, 1)
            dist[:, :beam] = np.take_along_axis(all_dist, best, 1)
            open_[:, :beam] = np.take_along_axis(all_open, best, 1) & np.isfinite(dist[:, :beam])

    def _prune(self, ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates, nearest first, the diverse ones: at most ``degree``."""
        b, c = ids.shape
        kept, kept_dist = np.full((b, self.degree), self.n, np.int32), np.full((b, self.degree), np.inf, np.float32)
        for s in range(0, b, 512):
            i, d = ids[s : s + 512], dist[s : s + 512]
            v, norm = self.x[i], np.where(i < self.n, self.norm[i], 0)
            between = self.alpha2 * (norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)))
            alive, at = np.isfinite(d), np.arange(len(i))
            for k in range(self.degree):
                pick = alive.argmax(1)
                some = alive[at, pick]
                if not some.any():
                    break
                kept[s : s + 512][some, k] = i[at, pick][some]
                kept_dist[s : s + 512][some, k] = d[at, pick][some]
                alive &= between[at, pick] > d
                alive[at, pick] = False
        return kept, kept_dist

    def _insert(self, batch: np.ndarray, first: bool) -> None:
        v = self.x[batch]
        among = self.norm[batch][:, None] + self.norm[batch][None] - 2 * (v @ v.T)
        np.fill_diagonal(among, np.inf)
        take = min(len(batch), 48 if first else 12)
        nearest = np.argpartition(among, take - 1, axis=1)[:, :take] if take < len(batch) else np.tile(np.arange(len(batch)), (len(batch), 1))
        ids, dist = batch[nearest].astype(np.int32), np.take_along_axis(among, nearest, 1).astype(np.float32)
        if not first:
            more_ids, more_dist = self.search(v)
            ids, dist = np.concatenate([ids, more_ids], axis=1), np.concatenate([dist, more_dist], axis=1)
        best = np.argsort(dist, axis=1)[:, : self.beam]
        kept, kept_dist = self._prune(np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1))
        self.edges[batch], self.length[batch] = kept, kept_dist
        self._offer_back(batch, kept, kept_dist)

    def _offer_back(self, batch: np.ndarray, kept: np.ndarray, kept_dist: np.ndarray) -> None:
        to, source, d = kept.ravel(), np.repeat(batch, self.degree), kept_dist.ravel()
        real = to < self.n
        to, source, d = to[real], source[real], d[real]
        order = np.lexsort((d, to))
        to, source, d = to[order], source[order], d[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
        rank = np.arange(len(to)) - np.repeat(starts, np.diff(np.r_[starts, len(to)]))
        kept_rank = rank < self.degree
        ends, at = to[starts], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(to)]))
        ids = np.full((len(ends), 2 * self.degree), self.n, np.int32)
        dist = np.full((len(ends), 2 * self.degree), np.inf, np.float32)
        ids[:, : self.degree], dist[:, : self.degree] = self.edges[ends], self.length[ends]
        ids[at[kept_rank], self.degree + rank[kept_rank]] = source[kept_rank]
        dist[at[kept_rank], self.degree + rank[kept_rank]] = d[kept_rank]
        twice = (ids[:, self.degree :, None] == ids[:, None, : self.degree]).any(2)
        dist[:, self.degree :][twice] = np.inf
        best = np.argsort(dist, axis=1)
        ids, dist = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1)
        ids[~np.isfinite(dist)] = self.n
        full = np.isfinite(dist).sum(1) > self.degree
        if full.any():
            ids[full, : self.degree], dist[full, : self.degree] = self._prune(ids[full], dist[full])
        self.edges[ends], self.length[ends] = ids[:, : self.degree], dist[:, : self.degree]
