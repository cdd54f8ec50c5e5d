"""Descriptor vectors on their way to shards: packing, copies, pivots.

A descriptor is usable if it has ``DIM`` values, none null, all from 0 to 255 and not all zero. Usable ones
travel as bytes. Shards are the cells of pivots, which are fitted on a bounded sample; every vector is then
indexed. Each vector belongs to the cell of its nearest pivot and visits the cells beyond the planes it is
near to, so near vectors meet in a cell of one of them. No cell grows with the table: a crowded one is
divided by pivots of its own, and one that no pivots divide is dealt into parts, each of which is visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 128
SAMPLE_ROWS, MOST_SAMPLED = 16_384, 262_144  # pivots are fitted on a 500th of the rows, within these bounds
CELL_ROWS = 1_000  # vectors to a pivot, as long as that takes no more than MOST_PIVOTS
MOST_PIVOTS = 2_048
DIVIDED_ROWS, INNER_ROWS = 12_000, 8_000  # a cell with more vectors gets a pivot of its own for so many each
MOST_INNER = 65_536
PART_ROWS = 16_000  # a cell that still has more vectors is dealt into parts of so many
VISITS, FAR_VISITS = 3, 12  # cells of a vector, its own included; without a greatest distance
CROWD_VISITS = 5  # more for a vector in the midst of a divided cell
MARGIN = 0.2  # a vector visits a cell if the plane before it is no further than this share of the greatest distance
SHARD_ROWS = 40_000  # vectors to a task of the shards
ASIDE = -1  # the place of a copy that does not travel to a shard
SPREAD = 300.0  # least distance between pivots that are not the split of a crowded cell


def _usable(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and byte vectors of the usable rows of a batch; a null id is not usable."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0)) if len(vectors) else np.zeros(0, int)
    good = (lengths == DIM) & np.asarray(ids.is_valid())
    if not good.any():
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.uint8)
    flat = vectors.filter(pa.array(good)).flatten()
    values = flat.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, DIM)
    fit = (values.min(1) >= 0) & (values.max(1) <= 255) & (values.max(1) > 0)
    return ids.filter(pa.array(good)).to_numpy(zero_copy_only=False)[fit], values[fit].astype(np.uint8)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary column."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column) or column.null_count or column.type != pa.binary():
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIM)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, DIM)


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct vector once, under the smallest of its ids."""
    if not len(ids):
        return ids, x
    order = np.argsort(ids, kind="stable")
    _, first = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, DIM))).ravel(), return_index=True)
    keep = order[np.sort(first)]
    return ids[keep], x[keep]


def stand_ins(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row the smallest id that has the same vector."""
    if not len(ids):
        return ids
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, DIM))).ravel(), return_inverse=True)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group.ravel(), ids)
    return least[group.ravel()]


def copy_rows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smaller ids they are copies of: those that were set aside before the shards, or the copies
    among a shard's own vectors, which came from different batches."""
    ids, place = rows["id"].to_numpy(), rows["place"].to_numpy()
    if len(ids) and place[0] == ASIDE:
        return ids, np.frombuffer(b"".join(rows["vec"].to_pylist()), np.int64)
    own = place == 0
    least = stand_ins(ids[own], unpacked(rows["vec"])[own]) if own.any() else ids[:0]
    copied = least != ids[own]
    return ids[own][copied], least[copied]


def classes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of exact copies from ``id, up`` rows: ``id, rep`` of each member, and ``rep, size``.

    A copy may name a stand-in of its batch that itself names the smallest id of all; two steps always reach
    it. Minima and sizes are combined on the map side.
    """
    up = found.select("id", "up").distinct()
    further = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
    reps = up.join(further, "up", "left").groupBy("id").agg(F.min(F.coalesce("top", "up")).alias("rep"))
    members = reps.unionByName(reps.select(F.col("rep").alias("id"), "rep").distinct())
    return members, reps.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("size"))


@dataclass
class Pivots:
    """``points`` are the pivots a vector looks for first; those of a divided cell are in ``inner``, under numbers that follow."""

    points: np.ndarray
    inner: dict[int, np.ndarray] = field(default_factory=dict)
    parts: dict[int, int] = field(default_factory=dict)
    rows: int = 0

    def __post_init__(self) -> None:
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.first, at = {}, len(self.points)
        for cell in sorted(self.inner):
            self.first[cell] = at
            at += len(self.inner[cell])
        self.every = np.concatenate([self.points, *(self.inner[c] for c in sorted(self.inner))])

    def flat(self) -> Pivots:
        """All pivots as one level, so that every vector stands in the cell of the nearest of all."""
        return Pivots(self.every, rows=self.rows)

    def nearest(self, x: np.ndarray, visits: int = VISITS) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the nearest pivots of each row, nearest first, and squared distances less the row's own norm;
        infinite where a row has no further cell."""
        d = self.norms[None] - 2 * (x @ self.points.T)
        take = min(visits, len(self.points))
        cells = np.argpartition(d, take - 1, axis=1)[:, :take] if take > 1 else d.argmin(1)[:, None]
        away = np.take_along_axis(d, cells, 1)
        if self.inner:
            cells, away = self._divided(x, cells, away, visits)
        order = np.argsort(away, axis=1, kind="stable")
        return np.take_along_axis(cells, order, 1), np.take_along_axis(away, order, 1)

    def _divided(self, x: np.ndarray, cells: np.ndarray, away: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with inner cells in place of divided ones; only a row in the midst of a crowd has ``CROWD_VISITS`` more."""
        width = visits + CROWD_VISITS
        wide, far = np.repeat(cells, width, axis=1), np.full((len(x), cells.shape[1] * width), np.inf, np.float32)
        far[:, ::width] = away
        for cell, points in self.inner.items():
            row, place = np.nonzero(cells == cell)
            if not len(row):
                continue
            d = np.einsum("ij,ij->i", points, points)[None] - 2 * (x[row] @ points.T)
            take = min(width, len(points))
            best = np.argpartition(d, take - 1, axis=1)[:, :take]
            at = (place * width)[:, None] + np.arange(take)
            wide[row[:, None], at] = self.first[cell] + best
            far[row[:, None], at] = np.take_along_axis(d, best, 1)
        order = np.argsort(far, axis=1, kind="stable")[:, :width]
        wide, far = np.take_along_axis(wide, order, 1), np.take_along_axis(far, order, 1)
        far[wide[:, 0] < len(self.points), visits:] = np.inf
        return wide, far


def fit_pivots(df: DataFrame, id_col: str, vector_col: str) -> Pivots:
    """Pivots from a sample of rows, taken by a hash of the id.

    Pivots are vectors of the sample at least ``SPREAD`` apart. The share of the sample in a cell tells how
    many vectors it will hold: a cell of more than ``DIVIDED_ROWS`` gets inner pivots, and what still holds
    more than ``PART_ROWS`` is dealt into parts. Sample and pivots are bounded by the constants above.
    """
    total = df.count()
    every = max(1, total // min(MOST_SAMPLED, max(SAMPLE_ROWS, total // 500)))
    mark = F.xxhash64(F.col(id_col).cast("long"))
    rows = df.filter(F.pmod(mark, F.lit(every)) == 0).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).toArrow()
    ids, x = [], []
    for batch in rows.to_batches():
        i, v = _usable(batch.column(0), batch.column(1))
        ids.append(i)
        x.append(v)
    if not ids or not sum(map(len, ids)):
        return Pivots(np.zeros((1, DIM), np.float32), rows=total)
    ids, x = distinct_rows(np.concatenate(ids), np.concatenate(x))
    x = x[np.random.RandomState(11).permutation(len(x))].astype(np.float32)
    cells = int(min(MOST_PIVOTS, max(1, -(-total // CELL_ROWS))))
    norms = np.einsum("ij,ij->i", x, x)
    pivots, nearest, owner = [], np.full(len(x), np.inf), np.zeros(len(x), int)
    for i in range(len(x)):
        if len(pivots) >= cells:
            break
        if nearest[i] > SPREAD**2:
            d = norms + norms[i] - 2 * (x @ x[i])
            owner[d < nearest] = len(pivots)
            nearest = np.minimum(nearest, d)
            pivots.append(i)
    inner: dict[int, np.ndarray] = {}
    left = MOST_INNER
    sizes = np.bincount(owner, minlength=len(pivots))
    for cell in np.argsort(-sizes, kind="stable").tolist():
        take = min(left, int(sizes[cell]), -(-int(sizes[cell]) * every // INNER_ROWS))
        if sizes[cell] * every > DIVIDED_ROWS and take > 1:
            inner[cell] = x[np.flatnonzero(owner == cell)[:take]]
            left -= take
    found = Pivots(x[pivots], inner, rows=total)
    held = np.zeros(len(found.every), np.int64)
    for s in range(0, len(x), 4096):
        held += np.bincount(found.nearest(x[s : s + 4096])[0][:, 0], minlength=len(held))
    found.parts = {int(c): int(-(-held[c] * every // PART_ROWS)) for c in np.flatnonzero(held * every > PART_ROWS)}
    return found


def to_shards(df: DataFrame, id_col: str, vector_col: str, pivots: Pivots, max_distance: float | None = None, visits: int | None = None) -> DataFrame:
    """``shard, place, id, vec``: each vector in its own cell, at place 0, and as a visitor in those it is near to.

    A vector visits the cells of its nearest pivots, ``FAR_VISITS`` with its own (``CROWD_VISITS`` more in a divided cell);
    with a ``max_distance`` ``VISITS``, and only those whose dividing plane is within ``MARGIN`` of it. Two vectors
    with a plane between them meet if either visits, so a pair is lost only if it stands across more planes
    than that, or straight across one with both ends far from it. In a cell of several parts a vector stands in
    one and visits the others.

    Copies within a batch go once, under their smallest id, so a group of copies of any size reaches a
    shard as one row for each batch. The others are set aside, with that id in place of the vector, in
    groups of their own that are no larger than a batch.
    """
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    reach = np.inf if max_distance is None else MARGIN * max_distance
    wanted = visits or (FAR_VISITS if max_distance is None else VISITS)
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())])

    def rows_of(shard: np.ndarray, place: np.ndarray, ids: np.ndarray, vec: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(place.astype(np.int32)), pa.array(ids, pa.int64()), vec], schema=schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            every, vectors = _usable(batch.column(0), batch.column(1))
            least = stand_ins(every, vectors)
            copied = least != every
            if copied.any():
                n, group = int(copied.sum()), -1 - int(every[0] * 2654435761 % (2**31 - 1))
                yield rows_of(np.full(n, group), np.full(n, ASIDE), every[copied], packed(least[copied].reshape(-1, 1).view(np.uint8)))
            ids, x = distinct_rows(every, vectors)
            for s in range(0, len(ids), 4096):
                i, v = ids[s : s + 4096], x[s : s + 4096]
                cells, away = p.nearest(v.astype(np.float32), wanted)
                for place in range(cells.shape[1]):
                    cell = cells[:, place]
                    meets = np.isfinite(away[:, place])
                    if place and np.isfinite(reach):
                        between = np.linalg.norm(p.every[cell] - p.every[cells[:, 0]], axis=1)
                        meets &= away[:, place] - away[:, 0] <= 2 * between * reach + 1e-3
                    number = np.array([p.parts.get(c, 1) for c in cell.tolist()]) if p.parts else np.ones(len(i), int)
                    mark = v.astype(np.int64) @ np.arange(1, DIM + 1) if p.parts else i  # copies have the same
                    for part in range(int(number[meets].max(initial=0))):
                        there = meets & (part < number)
                        stands = mark[there] % number[there] == part
                        yield rows_of(cell[there] * np.int64(1 << 20) + part, np.where(stands & (place == 0), 0, max(place, 1)), i[there], packed(v[there]))

    assigned = df.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(assign, "shard long, place int, id long, vec binary")
    return assigned.repartition(max(8, -(-pivots.rows * wanted // (2 * SHARD_ROWS))), "shard")
