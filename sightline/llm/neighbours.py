"""The most similar vectors of every vector, by a robust-pruned proximity graph in each shard.

With ``exact`` the graph only bounds how far each vector must look, and every cell that may hold a vector so
near is then compared whole. That is quadratic work where vectors have no near neighbours; it serves to
measure what the graphs find.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.exact import Bound, Queries, each_block, one_block, read, runs
from sightline.llm.proximity_graph import ProximityGraph
from sightline.llm.vectors import ASIDE, classes, copy_rows, distinct_rows, fit_pivots, packed, to_shards, unpacked
from sightline.runtime import Staging

DEGREE, BEAM, VISITOR_BEAM, ALPHA, WIDTH = 24, 10, 8, 1.1, 2
ALIKE = 1.3  # squared distances that differ by less are about as far


def _search_shard(rows: pa.Table, k: int, limit: float) -> pa.Table:
    """Pairs of one shard: its own vectors build the graph, all its vectors search it. Copies have d2 = -1."""
    copied, up = copy_rows(rows)
    source, target, squared = [copied], [up], [np.full(len(copied), -1, np.int64)]
    if len(rows) and rows["place"][0].as_py() == ASIDE:
        return _pairs(source, target, squared)
    ids, place, x = rows["id"].to_numpy(), rows["place"].to_numpy(), unpacked(rows["vec"])
    own_ids, own = distinct_rows(ids[place == 0], x[place == 0])
    guest_ids, guests = distinct_rows(ids[place > 0], x[place > 0])
    if len(own_ids):
        graph = ProximityGraph(own.astype(np.float32), DEGREE, max(BEAM, 2 * k), ALPHA, WIDTH)
        for query_ids, queries in ((own_ids, own), (guest_ids, guests)):
            if not len(query_ids):
                continue
            near, d = graph.search_own() if queries is own else graph.search(queries.astype(np.float32), max(VISITOR_BEAM, k + 3))
            _settle(graph, queries.astype(np.float32), near, d, k, limit)
            known = np.append(own_ids, -1)[near]
            d = np.where(np.isfinite(d), np.rint(d), np.inf)
            other = (known != query_ids[:, None]) & np.isfinite(d) & (d <= limit)
            rank = np.cumsum(other, axis=1)
            r, c = np.nonzero(other & ((rank <= k) | (d <= np.where(rank == k, d, -1).max(1)[:, None])))
            source.append(query_ids[r])
            target.append(known[r, c])
            squared.append(d[r, c].astype(np.int64))
    return _pairs(source, target, squared)


def _settle(graph: ProximityGraph, queries: np.ndarray, near: np.ndarray, d: np.ndarray, k: int, limit: float) -> None:
    """Compare the queries whose ``k`` nearest are all about as far away with the whole cell, in place.

    In such a region no edge leads nearer and a beam settles anywhere; elsewhere it does not.
    """
    rows = np.flatnonzero((d[:, k - 1] <= min(limit, np.finfo(np.float32).max)) & (d[:, k - 1] <= ALIKE * d[:, 0])) if d.shape[1] >= k else np.zeros(0, int)
    beam = min(d.shape[1], graph.n)
    for s in range(0, len(rows), 512):
        r = rows[s : s + 512]
        q = queries[r]
        every = np.einsum("ij,ij->i", q, q)[:, None] + graph.norm[None, : graph.n] - 2 * (q @ graph.x[: graph.n].T)
        best = np.argpartition(every, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(every, best, 1), axis=1, kind="stable"), 1)
        near[r, :beam], d[r, :beam] = best, np.take_along_axis(every, best, 1)


def _pairs(source: list, target: list, squared: list) -> pa.Table:
    columns = [np.concatenate(c) for c in (source, target, squared)]
    return pa.table({"src": pa.array(columns[0], pa.int64()), "dst": pa.array(columns[1], pa.int64()), "d2": pa.array(columns[2], pa.int64())})


FOUND = "id long, up long, shard int, kth double, vec binary"


def _bound_shard(rows: pa.Table, k: int, limit: float) -> pa.Table:
    """The distinct vectors of one shard and the squared distance within which their ``k`` nearest lie, as far
    as the shard's graph shows. Copies have no vector and name the id they are copies of."""
    copied, up = copy_rows(rows)
    parts = [_found(copied, up, -1, np.zeros(len(copied)), pa.nulls(len(copied), pa.binary()))]
    if len(rows) and rows["place"][0].as_py() != ASIDE:
        ids, x = distinct_rows(rows["id"].to_numpy(), unpacked(rows["vec"]))
        near, d = ProximityGraph(x.astype(np.float32), DEGREE, max(BEAM, 2 * k), ALPHA, WIDTH).search_own()
        d = np.sort(np.where(near < len(ids), d, np.inf), axis=1)[:, k - 1]
        parts.append(_found(ids, ids, rows["shard"][0].as_py() >> 20, np.minimum(np.rint(d), limit), packed(x)))
    return pa.concat_tables(parts)


def _found(ids: np.ndarray, up: np.ndarray, shard: int, kth: np.ndarray, vec: pa.Array) -> pa.Table:
    columns = {"id": pa.array(ids, pa.int64()), "up": pa.array(up, pa.int64()), "shard": pa.array(np.full(len(ids), shard, np.int32)), "kth": pa.array(kth, pa.float64())}
    return pa.table({**columns, "vec": vec})


class _Nearest:
    """The ``k`` nearest of each row so far, the smaller id first among equals."""

    def __init__(self, queries: Queries, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.d, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        limit = self.queries.limit
        good = (d <= limit[row]) & (near != self.ids[row])
        if not good.any():
            return
        touched = np.unique(row[good])
        row = np.r_[row[good], np.repeat(touched, self.k)]
        near, d = np.r_[near[good], self.near[touched].ravel()], np.r_[d[good], self.d[touched].ravel()]
        order = np.lexsort((near, d, row))
        starts = np.searchsorted(row[order], touched)
        first = order[starts[:, None] + np.arange(self.k)]
        self.near[touched], self.d[touched] = near[first], d[first]
        limit[touched] = np.minimum(limit[touched], self.d[touched, -1])
        self.queries.narrow(touched)


def _nearest_of_block(files: list[str], unit: tuple[int, int, int, int], bound: Bound, k: int) -> pa.Table:
    """The exact ``k`` nearest of each vector of a block, out of the whole staged table."""
    block = one_block(files, unit, ["id", "kth"])
    queries = Queries(bound, block["vec"], block["kth"])
    best = _Nearest(queries, block["id"], k)
    for other in read(files, ["id", "shard"]):
        for cell, start, end in runs(other["shard"]):
            rows = queries.reach(cell)
            if len(rows):
                for row, place, d in queries.within(rows, other["vec"][start:end], k):
                    best.add(row, other["id"][start + place], d)
    r, c = np.nonzero(np.isfinite(best.d))
    return pa.table({"src": pa.array(block["id"][r], pa.int64()), "dst": pa.array(best.near[r, c], pa.int64()), "d2": pa.array(best.d[r, c].astype(np.int64))})


def similar_vectors(df: DataFrame, id_col: str, vector_col: str, k: int = 5, max_distance: float | None = None, exact: bool = False) -> DataFrame:
    """``id, neighbour, squared_distance, rank``: the ``k`` nearest other ids of each id, as far as found.

    Distances are exact; of equal ones the smaller id is nearer. ``max_distance`` drops neighbours further
    away. Unusable vectors (see :mod:`vectors`) have no rows and are nobody's neighbour; repeated rows count
    once; an empty table gives no rows; other columns are ignored. A vector is indexed in the graph of its own
    cell and searches that of every cell it visits; a pair found from either side counts for both. With
    ``exact`` no neighbour is lost. Exact copies are one vector in the graph and are put back afterwards: each
    copy has the other copies nearest.
    """
    staging = Staging(df.sparkSession, "neighbours")
    limit = math.inf if max_distance is None else float(max_distance) ** 2
    pivots = fit_pivots(df, id_col, vector_col)
    if exact:
        pivots = pivots.flat()
        shards = to_shards(df, id_col, vector_col, pivots, visits=1)
        bounded = staging.write(shards.groupBy("shard").applyInArrow(lambda rows: _bound_shard(rows, k, limit), FOUND))
        shared = df.sparkSession.sparkContext.broadcast(Bound(pivots.points, limit))
        ranked = staging.write(each_block(bounded, lambda files, unit: iter([_nearest_of_block(files, unit, shared.value, k)]), "src long, dst long, d2 long"))
        members, sizes = classes(bounded.filter("vec IS NULL").select("id", "up"))
    else:
        shards = to_shards(df, id_col, vector_col, pivots, max_distance)
        found = staging.write(shards.groupBy("shard").applyInArrow(lambda rows: _search_shard(rows, k, limit), "src long, dst long, d2 long"))
        pairs = found.filter("d2 >= 0")
        both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2"))
        nearest = Window.partitionBy("src").orderBy("d2", "dst")
        ranked = both.withColumn("r", F.dense_rank().over(nearest)).filter(F.col("r") <= k).select("src", "dst", "d2").distinct()
        members, sizes = classes(found.filter("d2 < 0").select(F.col("src").alias("id"), F.col("dst").alias("up")))
    by_id = Window.partitionBy("rep").orderBy("id")
    first = members.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    # the copies of each neighbour, then the copies of each source that has room beside its own copies
    to_copies = ranked.join(first.filter(F.col("n") <= k).select(F.col("rep").alias("dst"), F.col("id").alias("copy")), "dst", "left")
    to_copies = to_copies.select("src", F.coalesce("copy", "dst").alias("neighbour"), "d2")
    roomy = to_copies.join(sizes.select(F.col("rep").alias("src"), "size"), "src", "left").withColumn("room", F.lit(k + 1) - F.coalesce("size", F.lit(1)))
    roomy = roomy.filter("room > 0").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "neighbour"))).filter("rank <= room")
    outside = roomy.join(members.select(F.col("rep").alias("src"), "id"), "src", "left").select(
        F.coalesce("id", "src").alias("id"), "neighbour", F.col("d2").alias("squared_distance"), (F.col("rank") + k - F.col("room")).cast("int").alias("rank")
    )
    place = first.select("rep", F.col("id").alias("neighbour"), "n")
    inside = members.join(place, "rep").filter("id <> neighbour").select("id", "neighbour", (F.col("n") - (F.col("neighbour") > F.col("id")).cast("int")).alias("rank"))
    inside = inside.filter(F.col("rank") <= k).select("id", "neighbour", F.lit(0).cast("long").alias("squared_distance"), F.col("rank").cast("int").alias("rank"))
    return outside.unionByName(inside)
