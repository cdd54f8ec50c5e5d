"""Every pair of vectors within a distance, proved: blocks of a staged table against the whole of it.

A staged table holds each distinct vector once, the rows of a cell side by side. A task takes a block of it
and reads all of it again from the shared folder, so no vector is sent to a second shard. Two tests spare
exact distances, and neither loses a pair. A vector cannot be within reach of a cell if it is further than
that from the plane that halves the way between its own pivot and the cell's. And the distance of two
vectors is at least that of their projections on a few orthonormal directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from sightline.llm.vectors import DIM, unpacked

BLOCK, TILE = 8_192, 512
DENSE = 0.02  # a tile with a larger share of candidates is compared whole


def _opened(uri: str) -> pq.ParquetFile:
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(files.open_input_file(path))


def units(staged: DataFrame, blocks: int = 1) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """Files of a staged table, and its blocks, or some of them together: file, row group, first row and end."""
    files, out = sorted(staged.inputFiles()), []
    for n, uri in enumerate(files):
        about = _opened(uri).metadata
        for g in range(about.num_row_groups):
            rows = about.row_group(g).num_rows
            out += [(n, g, s, min(rows, s + blocks * BLOCK)) for s in range(0, rows, blocks * BLOCK)]
    return files, out


def _columns(rows: pa.Table) -> dict[str, np.ndarray]:
    """Columns of the rows that have a vector."""
    rows = rows.filter(pa.compute.is_valid(rows["vec"]))
    return {c: unpacked(rows[c]) if c == "vec" else rows[c].to_numpy() for c in rows.column_names}


def one_block(files: list[str], unit: tuple[int, int, int, int], columns: list[str]) -> dict[str, np.ndarray]:
    n, group, start, end = unit
    return _columns(_opened(files[n]).read_row_group(group, columns=[*columns, "vec"]).slice(start, end - start))


def read(files: list[str], columns: list[str], unit: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Iterator[dict[str, np.ndarray]]:
    """The columns of all stretches of the table from a block on, one after another."""
    for n in range(unit[0], len(files)):
        file = _opened(files[n])
        for g in range(unit[1] if n == unit[0] else 0, file.num_row_groups):
            rows = file.read_row_group(g, columns=[*columns, "vec"])
            for s in range(0, len(rows), BLOCK):
                if (n, g) > unit[:2] or s + BLOCK > unit[2]:
                    yield _columns(rows.slice(s, BLOCK))


def each_block(staged: DataFrame, work: Callable[[list[str], tuple[int, int, int, int]], Iterator[pa.Table]], schema: str, together: int = 1) -> DataFrame:
    """Rows that ``work`` gives for each block of a staged table, or for so many ``together``, a task for each."""
    spark = staged.sparkSession
    files, blocks = units(staged, together)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                for rows in work(files, blocks[n]):
                    yield from rows.to_batches()

    return spark.range(0, len(blocks), 1, max(1, len(blocks))).mapInArrow(run, schema)


class Bound:
    """Orthonormal directions in which all but a ``share`` of the pivots' pairs are further apart than ``limit`` (squared)."""

    def __init__(self, pivots: np.ndarray, limit: float, share: float = 1e-3):
        self.pivots, self.mean = pivots.astype(np.float32), pivots.mean(0).astype(np.float32)
        centred = pivots.astype(np.float64) - pivots.mean(0)
        basis = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        sample = (centred @ basis)[:512]
        self.dims = DIM
        for dims in (16, 24, 32, 48, 64, 96):
            y = sample[:, :dims]
            norm = (y * y).sum(1)
            near = (norm[:, None] + norm[None] - 2 * y @ y.T <= limit).sum() - len(y)
            if len(y) > 16 and near <= share * len(y) ** 2:
                self.dims = dims
                break
        self.basis = np.ascontiguousarray(basis[:, : self.dims]).astype(np.float32)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (x - self.mean) @ self.basis
        return y, np.einsum("ij,ij->i", y, y)


class Queries:
    """A block of vectors and the squared distance up to which each looks for others."""

    def __init__(self, bound: Bound, x: np.ndarray, limit: np.ndarray):
        self.bound, self.x, self.limit = bound, x.astype(np.float32), limit.astype(np.float64)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        y, self._size = bound.project(self.x)
        self._left = np.hstack([-2 * y, np.zeros((len(x), 1)), np.ones((len(x), 1))]).astype(np.float32)
        self.narrow(np.arange(len(x)))
        p = bound.pivots
        squared = np.einsum("ij,ij->i", p, p)
        self._to = squared[None] + self.norm[:, None] - 2 * self.x @ p.T
        self.cell = (squared[None] - 2 * self.x @ p.T).argmin(1) if len(x) else np.zeros(0, int)
        self._between = np.sqrt(np.maximum(squared[:, None] + squared[None] - 2 * p @ p.T, 1e-6))

    def narrow(self, rows: np.ndarray) -> None:
        """Take over smaller limits of some rows."""
        self._left[rows, -2] = self._size[rows] - self.limit[rows]

    def reach(self, cell: int) -> np.ndarray:
        """Rows that may have a vector of a cell within their limit."""
        own = self._to[np.arange(len(self.x)), self.cell]
        return np.flatnonzero(self._to[:, cell] - own <= 2 * self._between[self.cell, cell] * np.sqrt(self.limit) + 1)

    def within(self, rows: np.ndarray, x: np.ndarray, best: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of some rows with the vectors ``x`` at their limit or nearer: row, place in x, squared distance.

        Distances are sums of whole numbers below 2^24 and exact. With ``best`` a row's pairs beyond its
        that many nearest may be left out of a crowded tile; equal ones stay.
        """
        x = x.astype(np.float32)
        norm = np.einsum("ij,ij->i", x, x)
        y, size = self.bound.project(x)
        slack = 1 + 4e-6 * float(size.max(initial=0) + self._size.max(initial=0))
        right = np.hstack([y, np.ones((len(x), 1)), (size - slack)[:, None]]).astype(np.float32)
        for c in range(0, len(x), TILE):
            tile = np.ascontiguousarray(right[c : c + TILE].T)
            wide = tile.shape[1]
            for s in range(0, len(rows), TILE):
                r = rows[s : s + TILE]
                hits = np.flatnonzero((self._left[r] @ tile <= 0).ravel())
                if not len(hits):
                    continue
                if len(hits) > DENSE * len(r) * wide:
                    d = self.norm[r, None] + norm[None, c : c + TILE] - 2 * (self.x[r] @ x[c : c + TILE].T)
                    most = self.limit[r]
                    if best is not None and wide > best + 1:
                        most = np.minimum(most, np.partition(d, best, axis=1)[:, best])  # one of them may be the row itself
                    i, j = np.nonzero(d <= most[:, None])
                    yield r[i], c + j, d[i, j]
                else:
                    i, j = r[hits // wide], c + hits % wide
                    apart = self.x[i] - x[j]
                    d = np.einsum("ij,ij->i", apart, apart)
                    good = d <= self.limit[i]
                    yield i[good], j[good], d[good]


def runs(cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Cell, first row and end of each stretch of equal cells."""
    if len(cells):
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        yield from zip(cells[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True)
