"""Small dense solvers and their distributed shells: alignment, rotation averaging, robust two-view estimation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators.graph import maximum_spanning_forest, propagate_rotations
from sightline.operators.robust import on_group, x84
from sightline.runtime import Staging

# Fixed values of the averaging: rounds, and where they stop.
MOST_ROUNDS, LEAST_ERROR, LEAST_DROP = 32, 1e-5, 1e-2
ADMM_ROUNDS, ADMM_RHO, ADMM_ALPHA, ADMM_ABSOLUTE, ADMM_RELATIVE = 1000, 1.0, 1.0, 1e-4, 1e-2
IRLS_SCALE = np.radians(5.0)

L1_FLOOR = 1e-3  # residuals below this weigh alike in the first stage, radians
L1_ENOUGH = 1e-3  # the first stage only has to come near: it ends when views move less than this on average
CG_TOLERANCE = {"l1": 1e-2, "irls": 1e-3}
MOST_VIEWS = 20_000_000  # views of one connected graph, whose rotations the driver holds


def alignment_sums(pairs: DataFrame, keys: Sequence[str], a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """``keys, n, cov, spread`` and the means of either side (``ma0..mb2``) of each group of point pairs.

    Rows with a null or NaN do not count. Means, spreads and the 3x3 covariance are sums, so each group becomes one row.
    """
    keys = list(keys)
    whole = pairs.filter(F.forall(F.array(*[F.col(c).cast("double") for c in (*a, *b)]), lambda x: x.isNotNull() & ~F.isnan(x)))
    averages = [F.avg(c).alias(f"m{s}{i}") for s, cols in (("a", a), ("b", b)) for i, c in enumerate(cols)]
    rows = on_group(whole, whole.groupBy(*keys).agg(*averages) if keys else whole.agg(*averages), keys)
    da = [F.col(c) - F.col(f"ma{i}") for i, c in enumerate(a)]
    db = [F.col(c) - F.col(f"mb{i}") for i, c in enumerate(b)]
    cov = F.array(*[F.sum(x * y) for y in db for x in da]).alias("cov")
    spread = F.sum(da[0] * da[0] + da[1] * da[1] + da[2] * da[2]).alias("spread")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), cov, spread, *[F.first(f"m{s}{i}").alias(f"m{s}{i}") for s in "ab" for i in range(3)])


def similarity_alignment(pairs: DataFrame, keys: Sequence[str], a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """``keys, n, scale, r, t`` with b ~ scale R a + t, least squares in closed form.

    Numpy decomposes one covariance for each group (see :func:`alignment_sums`). Groups of fewer than three
    points, or without spread, have nulls.
    """
    sums = alignment_sums(pairs, keys, a, b).filter("n > 0")

    @F.pandas_udf("scale double, r array<double>, t array<double>")
    def solve(n: pd.Series, cov: pd.Series, spread: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.DataFrame:
        out = []
        for count, h, s, p, q in zip(n, cov, spread, ma, mb, strict=True):
            if count < 3 or s <= 1e-12:
                out.append((None, None, None))
                continue
            u, d, vt = np.linalg.svd(np.array(h).reshape(3, 3))
            sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
            r = u @ np.diag(sign) @ vt
            scale = float((d * sign).sum() / s)
            out.append((scale, r.ravel().tolist(), (np.array(q) - scale * r @ np.array(p)).tolist()))
        return pd.DataFrame(out, columns=["scale", "r", "t"])

    centre = [F.array(*[F.col(f"m{s}{i}") for i in range(3)]) for s in "ab"]
    return sums.withColumn("fit", solve("n", "cov", "spread", *centre)).select(*keys, "n", "fit.scale", "fit.r", "fit.t")


def iterative_alignment(pairs: DataFrame, keys: Sequence[str], a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """The same by Gauss-Newton on the seven parameters, from the closed form's sums: ``keys, n, scale, r, t``.

    The squared error of a similarity depends on the points through the same sums only (spreads, covariance,
    means), so a group is iterated on in one row, however many points it has.
    """
    sums = alignment_sums(pairs, keys, a, b).filter("n > 0")

    @F.pandas_udf("scale double, r array<double>, t array<double>")
    def solve(n: pd.Series, cov: pd.Series, spread: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.DataFrame:
        out = []
        for count, h, s, p, q in zip(n, cov, spread, ma, mb, strict=True):
            if count < 3 or s <= 1e-12:
                out.append((None, None, None))
                continue
            h, r = np.array(h).reshape(3, 3), np.eye(3)
            for _ in range(200):  # the axis of M = R^T H that is not symmetric turns R until the trace is greatest
                m = h @ r.T
                axis = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])
                sym = (m + m.T) / 2
                hessian = np.trace(sym) * np.eye(3) - sym
                values = np.linalg.eigvalsh(hessian)
                step = np.linalg.solve(hessian + max(0.0, 1e-9 * abs(values[-1]) - values[0]) * np.eye(3), axis / 2)
                r = _exp(step[None])[0] @ r
                if np.abs(step).max() < 1e-13:
                    break
            scale = float(np.trace(h @ r.T) / s)
            out.append((scale, r.ravel().tolist(), (np.array(q) - scale * r @ np.array(p)).tolist()))
        return pd.DataFrame(out, columns=["scale", "r", "t"])

    centre = [F.array(*[F.col(f"m{s}{i}") for i in range(3)]) for s in "ab"]
    return sums.withColumn("fit", solve("n", "cov", "spread", *centre)).select(*keys, "n", "fit.scale", "fit.r", "fit.t")


def iterative_similarity(a: np.ndarray, b: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """The same by Gauss-Newton on seven parameters, from the identity."""
    s, r, t = 1.0, np.eye(3), b.mean(0) - a.mean(0)
    for _ in range(rounds):
        moved = a @ r.T
        residual = (b - s * moved - t).ravel()
        jacobian = np.zeros((len(a), 3, 7))
        jacobian[:, :, 0] = moved
        jacobian[:, :, 1:4] = -s * _skews(moved)
        jacobian[:, :, 4:] = np.eye(3)
        step = np.linalg.lstsq(jacobian.reshape(-1, 7), residual, rcond=None)[0]
        s, r, t = s + step[0], _exp(step[None, 1:4])[0] @ r, t + step[4:]
        if np.abs(step).max() < 1e-12:
            break
    return s, r, t


def rotation_alignment(pairs: DataFrame, ra: str, rb: str) -> DataFrame:
    """``r`` with R_b ~ R_a R of all pairs, by the sum of R_a^T R_b made a rotation."""
    products = pairs.select(g.multiply(g.transpose(F.col(ra)), F.col(rb)).alias("m")).filter("m IS NOT NULL")
    sums = products.agg(F.array(*[F.sum(F.col("m")[k]) for k in range(9)]).alias("m"))

    @F.pandas_udf("array<double>")
    def nearest(m: pd.Series) -> pd.Series:
        return m.map(lambda v: None if v is None or any(x is None for x in v) else _project(np.array(v).reshape(3, 3)).ravel().tolist())

    return sums.select(nearest("m").alias("r"))


def _project(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt


def _skews(v: np.ndarray) -> np.ndarray:
    z = np.zeros(len(v))
    return np.stack([z, -v[:, 2], v[:, 1], v[:, 2], z, -v[:, 0], -v[:, 1], v[:, 0], z], 1).reshape(-1, 3, 3)


def _exp(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=1)[:, None, None]
    k = _skews(v)
    safe = np.where(angle > 1e-12, angle, 1.0)
    return np.eye(3) + np.where(angle > 1e-12, np.sin(angle) / safe, 1.0) * k + np.where(angle > 1e-12, (1 - np.cos(angle)) / safe**2, 0.5) * (k @ k)


def _log(r: np.ndarray) -> np.ndarray:
    cosine = np.clip((np.trace(r, axis1=1, axis2=2) - 1) / 2, -1, 1)
    angle = np.arccos(cosine)
    v = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1)
    k = np.where(angle > 1e-9, angle / np.maximum(2 * np.sin(angle), 1e-9), 0.5)
    out = v * k[:, None]
    for n in np.flatnonzero(angle > np.pi - 1e-4):  # the sine is useless near a half turn
        values, vectors = np.linalg.eigh((r[n] + r[n].T) / 2)
        axis = vectors[:, values.argmax()]
        out[n] = angle[n] * axis * (1 if axis @ v[n] >= 0 else -1)
    return out


def _incidence(i: np.ndarray, j: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x[j] - x[i]


def _adjoint(i: np.ndarray, j: np.ndarray, y: np.ndarray, n: int, root: int) -> np.ndarray:
    out = np.zeros((n, 3))
    np.add.at(out, j, y)
    np.add.at(out, i, -y)
    out[root] = 0
    return out


def _conjugate(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, diagonal: np.ndarray, tolerance: float) -> np.ndarray:
    """x of ``apply(x) = right``, a symmetric positive operator with the given diagonal, by conjugate gradients."""
    x, r = np.zeros_like(right), right.copy()
    z = r / diagonal
    p, size = z.copy(), float((r * z).sum())
    enough = tolerance**2 * size
    for _ in range(4 * len(right) + 50):
        if size <= enough or size < 1e-24:
            break
        ap = apply(p)
        step = size / max(float((p * ap).sum()), 1e-300)
        x, r = x + step * p, r - step * ap
        z = r / diagonal
        new = float((r * z).sum())
        p, size = z + new / size * p, new
    return x


def _least_squares(i: np.ndarray, j: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, root: int, tolerance: float = 1e-10) -> np.ndarray:
    """Weighted least squares of x_j - x_i = b with x_root = 0."""
    diagonal = np.maximum(np.bincount(i, w, n) + np.bincount(j, w, n), 1e-300)[:, None]
    return _conjugate(lambda p: _adjoint(i, j, w[:, None] * _incidence(i, j, p), n, root), _adjoint(i, j, w[:, None] * b, n, root), diagonal, tolerance)


def l1_solve(i: np.ndarray, j: np.ndarray, b: np.ndarray, n: int, root: int) -> np.ndarray:
    """x that minimises the sum of |x_j - x_i - b| with x_root = 0, by alternating directions of multipliers.

    For one linearised graph in memory; :func:`refine_rotations` reweights instead, which ends at the same sum
    in a fraction of the passes.
    """
    x, z, u = np.zeros((n, 3)), np.zeros_like(b), np.zeros_like(b)
    ones = np.ones(len(b))
    for _ in range(ADMM_ROUNDS):
        x = _least_squares(i, j, b + z - u, ones, n, root)
        ax = _incidence(i, j, x)
        relaxed = ADMM_ALPHA * ax + (1 - ADMM_ALPHA) * (z + b)
        old, v = z, relaxed - b + u
        z = np.sign(v) * np.maximum(np.abs(v) - 1 / ADMM_RHO, 0)
        u = u + relaxed - z - b
        primal, dual = np.linalg.norm(ax - z - b), np.linalg.norm(ADMM_RHO * _adjoint(i, j, z - old, n, root))
        enough = np.sqrt(b.size) * ADMM_ABSOLUTE
        if primal < enough + ADMM_RELATIVE * max(np.linalg.norm(ax), np.linalg.norm(z), np.linalg.norm(b)) and dual < enough + ADMM_RELATIVE * np.linalg.norm(ADMM_RHO * u):
            break
    return x


def _weights(b: np.ndarray, stage: str) -> np.ndarray:
    """Weights of edges from their residuals: of the least sum of lengths, or of the final reweighting."""
    e2 = (b * b).sum(1)
    return 1 / np.maximum(np.sqrt(e2), L1_FLOOR) if stage == "l1" else IRLS_SCALE**2 / (e2 + IRLS_SCALE**2) ** 2


class EdgesInMemory:
    """The relative rotations of a view graph, and the sums over them that averaging needs, in numpy."""

    def __init__(self, i: np.ndarray, j: np.ndarray, rel: np.ndarray, n: int):
        self.i, self.j, self.rel, self.n = i, j, rel, n

    def linearise(self, r: np.ndarray, stage: str) -> tuple[np.ndarray, np.ndarray]:
        """Take residuals and weights at ``r``; the weighted residuals and the weights summed at each view."""
        self.b = _log(np.swapaxes(r[self.j], 1, 2) @ self.rel @ r[self.i])
        self.w = _weights(self.b, stage)
        return _adjoint(self.i, self.j, self.w[:, None] * self.b, self.n, 0), np.bincount(self.i, self.w, self.n) + np.bincount(self.j, self.w, self.n)

    def apply(self, p: np.ndarray) -> np.ndarray:
        return _adjoint(self.i, self.j, self.w[:, None] * _incidence(self.i, self.j, p), self.n, 0)


class EdgesInTable:
    """The same over a staged table ``i, j, rel``: each sum is one pass over the edges, which never leave their tasks.

    Vectors of one value for each view travel to the tasks and back, so the views of one graph are bounded
    (``MOST_VIEWS``, 24 bytes each), its edges are not. Residuals are staged once for each linearisation.
    """

    def __init__(self, edges: DataFrame, n: int, staging: Staging):
        self.edges, self.n, self.staging, self.at = edges, n, staging, None

    def _sums(self, frame: DataFrame, work: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """``work`` gives i, j and the values that each edge adds at j and takes at i; summed in the tasks first."""
        n = self.n

        def add(batches):
            total = None
            for rows in batches:
                i, j, y, z = work(rows)
                total = np.zeros((n, y.shape[1])) if total is None else total
                np.add.at(total, j, y)
                np.add.at(total, i, z)
            if total is not None:
                at = np.flatnonzero(total.any(1))
                yield pd.DataFrame({"v": at, **{f"s{k}": total[at, k] for k in range(total.shape[1])}})

        width = 4
        parts = frame.mapInPandas(add, "v long, " + ", ".join(f"s{k} double" for k in range(width)))
        found = parts.groupBy("v").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).toPandas()
        out = np.zeros((n, width))
        out[found["v"].to_numpy(int)] = found[[f"s{k}" for k in range(width)]].to_numpy()
        return out

    def linearise(self, r: np.ndarray, stage: str) -> tuple[np.ndarray, np.ndarray]:
        shared = self.edges.sparkSession.sparkContext.broadcast(r)

        def residuals(batches):
            for rows in batches:
                at = shared.value
                rel = np.array(rows["rel"].tolist()).reshape(-1, 3, 3)
                b = _log(np.swapaxes(at[rows["j"]], 1, 2) @ rel @ at[rows["i"]])
                yield pd.DataFrame({"i": rows["i"], "j": rows["j"], "b0": b[:, 0], "b1": b[:, 1], "b2": b[:, 2], "w": _weights(b, stage)})

        old, self.at = self.at, self.staging.write(self.edges.mapInPandas(residuals, "i int, j int, b0 double, b1 double, b2 double, w double"))
        self.staging.drop(old)

        def work(rows: pd.DataFrame):
            w = rows["w"].to_numpy()
            y = rows[["b0", "b1", "b2"]].to_numpy() * w[:, None]
            return rows["i"].to_numpy(), rows["j"].to_numpy(), np.column_stack([y, w]), np.column_stack([-y, w])

        out = self._sums(self.at, work)
        shared.destroy()
        right, weight = out[:, :3].copy(), out[:, 3]
        right[0] = 0
        return right, weight

    def apply(self, p: np.ndarray) -> np.ndarray:
        shared = self.edges.sparkSession.sparkContext.broadcast(p)

        def work(rows: pd.DataFrame):
            i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
            y = rows["w"].to_numpy()[:, None] * (shared.value[j] - shared.value[i])
            y = np.column_stack([y, np.zeros(len(y))])
            return i, j, y, -y

        out = self._sums(self.at.select("i", "j", "w"), work)[:, :3]
        shared.destroy()
        out[0] = 0
        return out


def refine_rotations(r: np.ndarray, edges: EdgesInMemory | EdgesInTable) -> np.ndarray:
    """Rotations refined from a start, view 0 staying: a stage of least absolute residuals, then least squares
    reweighted by the residuals.

    Each round weighs the edges by their residuals and solves the weighted normal equations by conjugate
    gradients, to a share of ``CG_TOLERANCE``; the first stage ends when moves are small, the second also when
    they grow or hardly fall.
    """
    for stage in ("l1", "irls"):
        before = np.inf
        for _ in range(MOST_ROUNDS):
            right, weight = edges.linearise(r, stage)
            x = _conjugate(edges.apply, right, np.maximum(weight, 1e-300)[:, None], CG_TOLERANCE[stage])
            r = r @ _exp(x)
            error = float(np.linalg.norm(x, axis=1).mean())
            if error <= (L1_ENOUGH if stage == "l1" else LEAST_ERROR) or (stage == "irls" and (error > before or (np.isfinite(before) and (before - error) / before <= LEAST_DROP))):
                break
            before = error
    return r


def rotation_residuals(pairs: DataFrame, rotations: DataFrame) -> DataFrame:
    """``view_i, view_j, residual``: Frobenius norm of R_ij - R_j R_i^T of each pair with both rotations."""
    a = rotations.select(F.col("view_id").alias("view_i"), F.col("r").alias("ri"))
    b = rotations.select(F.col("view_id").alias("view_j"), F.col("r").alias("rj"))
    rows = pairs.join(a, "view_i").join(b, "view_j").filter("ri IS NOT NULL AND rj IS NOT NULL")
    return rows.withColumn("c", g.multiply(F.col("rj"), g.transpose(F.col("ri")))).select("view_i", "view_j", g.frobenius(F.col("r"), F.col("c")).alias("residual"))


def average_rotations(views: DataFrame, pairs: DataFrame, driver_edges: int = 100_000) -> DataFrame:
    """``view_id, r`` of views, from relative rotations ``view_i, view_j, weight, r`` (R_j = R_ij R_i).

    The spanning forest of greatest weight gives the start, :func:`refine_rotations` the rest. The sums over
    the edges of a graph of at most ``driver_edges`` edges (counted first) are numpy's on the driver, those of
    a larger one are taken where its edges are; the steps and where they stop are the same, so are the results
    but for rounding. Views that the root's part does not reach have null rotations; a part of more than
    ``MOST_VIEWS`` views raises.
    """
    staging = Staging(views.sparkSession, "averaging")
    edges = staging.write(pairs.filter("view_i <> view_j AND r IS NOT NULL").select("view_i", "view_j", F.coalesce("weight", F.lit(1.0)).alias("weight"), "r"))
    forest = maximum_spanning_forest(edges.select("view_i", "view_j", "weight"))
    i, j = F.least("view_i", "view_j"), F.greatest("view_i", "view_j")
    upright = F.when(F.col("view_i") < F.col("view_j"), F.col("r")).otherwise(g.transpose(F.col("r")))
    directed = edges.select(i.alias("view_i"), j.alias("view_j"), "weight", upright.alias("r"))
    tree = directed.join(forest.select("view_i", "view_j", "weight"), ["view_i", "view_j", "weight"]).groupBy("view_i", "view_j").agg(F.min("r").alias("r"))
    start = staging.write(propagate_rotations(views, tree).select("view_id", "r"))
    reached = start.filter("r IS NOT NULL")
    n = reached.count()
    if n > MOST_VIEWS:
        raise ValueError(f"{n} views hang together, more than {MOST_VIEWS}")
    nodes = reached.orderBy("view_id").toPandas()
    if not len(nodes):
        return start
    numbers = views.sparkSession.createDataFrame(pd.DataFrame({"view_id": nodes["view_id"], "at": np.arange(n, dtype=np.int32)}), "view_id long, at int")
    inside = directed.join(numbers.select(F.col("view_id").alias("view_i"), F.col("at").alias("i")), "view_i").join(numbers.select(F.col("view_id").alias("view_j"), F.col("at").alias("j")), "view_j")
    inside = staging.write(inside.select("i", "j", F.col("r").alias("rel")))
    r = np.array(nodes["r"].tolist()).reshape(-1, 3, 3)
    n_edges = inside.count()
    if not n_edges:
        return start
    if n_edges <= driver_edges:
        rows = inside.toPandas().sort_values(["i", "j"])
        r = refine_rotations(r, EdgesInMemory(rows["i"].to_numpy(), rows["j"].to_numpy(), np.array(rows["rel"].tolist()).reshape(-1, 3, 3), n))
    else:
        r = refine_rotations(r, EdgesInTable(inside, n, staging))
    out = pd.DataFrame({"view_id": nodes["view_id"], "r": [m.ravel().tolist() for m in r]})
    found = views.sparkSession.createDataFrame(out, "view_id long, r array<double>")
    return views.select("view_id").distinct().join(found, "view_id", "left")


def filter_by_residual(pairs: DataFrame, rotations: DataFrame) -> DataFrame:
    """Pairs with their residual and whether it is an inlier by the X84 rule."""
    return x84(rotation_residuals(pairs, rotations), [], "residual")


def eight_point(b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Essential matrix with b2^T E b1 = 0 of eight or more bearing pairs."""
    rows = np.einsum("ni,nj->nij", b2, b1).reshape(len(b1), 9)
    u, _, vt = np.linalg.svd(np.linalg.svd(rows)[2][-1].reshape(3, 3))
    return u @ np.diag([1.0, 1.0, 0.0]) @ vt


def epipolar_residual(e: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Sine of the angle between each bearing and its epipolar plane, the larger of both sides."""
    l2, l1 = b1 @ e.T, b2 @ e
    s = np.abs(np.einsum("ni,ni->n", b2, l2))
    return np.maximum(s / np.maximum(np.linalg.norm(l2, axis=1), 1e-12), s / np.maximum(np.linalg.norm(l1, axis=1), 1e-12))


def ransac(n: int, least: int, fit: Callable[[np.ndarray], object], cost: Callable[[object], np.ndarray], threshold: float, seed: int, rounds: int = 500, sure: float = 0.999):
    """Model with most rows of a cost up to the threshold, and those rows; then fitted to them again."""
    random, best, inliers, k = np.random.RandomState(seed), None, np.zeros(n, bool), 0
    while k < rounds and n >= least:
        k += 1
        model = fit(random.choice(n, least, replace=False))
        good = cost(model) <= threshold
        if good.sum() > inliers.sum():
            best, inliers = model, good
            share = inliers.mean() ** least
            rounds = min(rounds, int(np.ceil(np.log(1 - sure) / np.log(max(1 - share, 1e-12)))) if share < 1 else k)
    if inliers.sum() >= least:
        refit = fit(np.flatnonzero(inliers))
        if (again := cost(refit) <= threshold).sum() >= inliers.sum():
            best, inliers = refit, again
    return best, inliers


def decompose_essential(e: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the four poses of an essential matrix the one with most points in front of both cameras."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    best = None
    for r in (u @ w @ vt, u @ w.T @ vt):
        for t in (u[:, 2], -u[:, 2]):
            a = b1 @ r.T
            # depths of x2 d2 = d1 a + t, least squares in two unknowns
            aa, bb, ab, at, bt = (np.einsum("ni,ni->n", p, q) for p, q in ((a, a), (b2, b2), (a, b2), (a, np.broadcast_to(t, a.shape)), (b2, np.broadcast_to(t, a.shape))))
            det = np.maximum(aa * bb - ab * ab, 1e-12)
            front = int((((ab * bt - bb * at) / det > 0) & ((aa * bt - ab * at) / det > 0)).sum())
            if best is None or front > best[0]:
                best = (front, r, t)
    return best[1], best[2]


TWO_VIEW = "view_i long, view_j long, n_matches long, n_inliers long, r array<double>, t array<double>, inliers array<boolean>, reason string"
AT_ONCE = 16_384  # bearings of the pairs that are solved side by side
SOURCES: list[np.random.RandomState] = []


def _eight_points(b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """:func:`eight_point` for each of a stack; rows of zeros add nothing. What eight rows leave is the last column of a QR
    factor of their columns; of more rows only the triangle is decomposed."""
    rows = (b2[:, :, :, None] * b1[:, :, None, :]).reshape(len(b1), -1, 9)
    last = np.linalg.qr(rows.transpose(0, 2, 1), mode="complete")[0][:, :, -1] if rows.shape[1] < 9 else np.linalg.svd(np.linalg.qr(rows, mode="r"))[2][:, -1]
    u, _, vt = np.linalg.svd(last.reshape(-1, 3, 3))
    return u[:, :, :2] @ vt[:, :2]


def _residuals(e: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """:func:`epipolar_residual` for each of a stack."""
    l2, l1 = b1 @ e.transpose(0, 2, 1), b2 @ e
    s = np.abs(np.einsum("gni,gni->gn", b2, l2))
    return np.maximum(s / np.maximum(np.linalg.norm(l2, axis=2), 1e-12), s / np.maximum(np.linalg.norm(l1, axis=2), 1e-12))


def _seeded(seeds: np.ndarray) -> list[np.random.RandomState]:
    """Generators with these seeds, good until the next call: to make one takes a hundred times as long as to seed it again."""
    SOURCES.extend(np.random.RandomState() for _ in range(len(seeds) - len(SOURCES)))
    for source, seed in zip(SOURCES, seeds.tolist(), strict=False):
        source.seed(seed)
    return SOURCES


def _ransac_eight(b1: np.ndarray, b2: np.ndarray, n: np.ndarray, threshold: float, seeds: np.ndarray, rounds: int = 500, sure: float = 0.999) -> tuple[np.ndarray, np.ndarray]:
    """:func:`ransac` of eight points for a stack of pairs with ``n`` bearings each, in step: the samples of a pair, and so its
    model, are the same as if it stood alone. Gives essential matrices and inliers."""
    there = np.arange(b1.shape[1]) < n[:, None]
    random = _seeded(seeds)
    best, inliers, most = np.zeros((len(n), 3, 3)), np.zeros(there.shape, bool), np.full(len(n), rounds)
    active, k = np.flatnonzero(n >= 8), 0
    while len(active):
        k += 1
        sample = np.array([random[p].permutation(m)[:8] for p, m in zip(active.tolist(), n[active].tolist(), strict=True)])  # what choice without replacement takes
        model = _eight_points(b1[active[:, None], sample], b2[active[:, None], sample])
        good = (_residuals(model, b1[active], b2[active]) <= threshold) & there[active]
        better = good.sum(1) > inliers[active].sum(1)
        p = active[better]
        best[p], inliers[p] = model[better], good[better]
        share = (inliers[p].sum(1) / n[p]) ** 8
        with np.errstate(divide="ignore"):
            needed = np.ceil(np.log(1 - sure) / np.log(np.maximum(1 - share, 1e-12)))
        most[p] = np.where(share < 1, np.minimum(most[p], needed), k)
        active = active[k < most[active]]
    p = np.flatnonzero(inliers.sum(1) >= 8)
    if len(p):
        refit = _eight_points(b1[p] * inliers[p][:, :, None], b2[p])
        again = (_residuals(refit, b1[p], b2[p]) <= threshold) & there[p]
        kept = again.sum(1) >= inliers[p].sum(1)
        best[p[kept]], inliers[p[kept]] = refit[kept], again[kept]
    return best, inliers


def _decompose(e: np.ndarray, b1: np.ndarray, b2: np.ndarray, inliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`decompose_essential` for each of a stack, by its inliers."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u))[:, None, None], vt * np.sign(np.linalg.det(vt))[:, None, None]
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    rotations, shifts, front = [], [], []
    for r in (u @ w @ vt, u @ w.T @ vt):
        a = b1 @ r.transpose(0, 2, 1)
        aa, bb, ab = (np.einsum("gni,gni->gn", p, q) for p, q in ((a, a), (b2, b2), (a, b2)))
        det = np.maximum(aa * bb - ab * ab, 1e-12)
        for t in (u[:, :, 2], -u[:, :, 2]):
            at, bt = np.einsum("gni,gi->gn", a, t), np.einsum("gni,gi->gn", b2, t)
            front.append(((((ab * bt - bb * at) / det > 0) & ((aa * bt - ab * at) / det > 0)) & inliers).sum(1))
            rotations.append(r)
            shifts.append(t)
    which, row = np.argmax(front, axis=0), np.arange(len(e))
    return np.stack(rotations)[which, row], np.stack(shifts)[which, row]


def _solve_pairs(i: np.ndarray, j: np.ndarray, n: np.ndarray, b1: np.ndarray, b2: np.ndarray, least_inliers: int, least_ratio: float, threshold: float) -> pa.RecordBatch:
    """Rows of ``TWO_VIEW`` for pairs of ``n`` bearings each, zeros behind them, solved side by side."""
    seeds = np.array([(12345 ^ (7919 * int(a) + 7927 * int(b))) % 2**32 for a, b in zip(i, j, strict=True)])
    e, inliers = _ransac_eight(b1, b2, n, threshold, seeds)
    r, t = _decompose(e, b1, b2, inliers)
    found = inliers.sum(1)
    reason = np.where(found < max(least_inliers, 8), "too_few_inliers", np.where(found / n < least_ratio, "too_low_ratio", "ok"))

    def lists(values: np.ndarray, sizes: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
        missing = None if there is None else pa.array(~there)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values), mask=missing)

    ok = reason == "ok"
    pose = [lists(v.ravel(), np.full(len(n), v[0].size), ok) for v in (r, t)]
    inside = lists(inliers[np.arange(inliers.shape[1]) < n[:, None]], n)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (i, j, n, found)] + [*pose, inside, pa.array(reason.tolist(), pa.string())], schema=TWO_VIEW_ARROW)


def _bearings_of_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of columns of flat lists: bearings of each pair, and those of either side, one pair after another."""
    return np.asarray(batch.column(2).value_lengths()) // 3, *(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3) for c in batch.columns[2:4])


def two_view_poses_of_lists(pairs: DataFrame, least_matches: int = 50, least_inliers: int = 50, least_ratio: float = 0.25, threshold: float = 0.005) -> DataFrame:
    """:func:`two_view_poses` of rows ``view_i, view_j, b1, b2`` that hold the bearings of all matches of a pair, in order."""
    rows = pairs.select("view_i", "view_j", F.flatten("b1").alias("b1"), F.flatten("b2").alias("b2"), F.size("b1").alias("n"))
    return two_view_poses_where_seen(rows, F.col("n"), _bearings_of_lists, least_matches, least_inliers, least_ratio, threshold)


def two_view_poses_where_seen(
    pairs: DataFrame, n: Column, seen: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], least_matches: int = 50, least_inliers: int = 50, least_ratio: float = 0.25, threshold: float = 0.005
) -> DataFrame:
    """:func:`two_view_poses` of rows ``view_i, view_j`` and columns that ``seen`` makes the bearings of, in the task that
    solves them: how many each pair has (``n``), and those of either side, one pair after another.

    Pairs are solved many at a time where they are, without a shuffle; those with too few matches do not go to Python.
    """
    least = max(least_matches, 8)
    few = pairs.filter(n < least).select(
        "view_i", "view_j", n.cast("long").alias("n_matches"), F.lit(0).cast("long").alias("n_inliers"), F.lit(None).cast("array<double>").alias("r"), F.lit(None).cast("array<double>").alias("t"),
        F.lit(None).cast("array<boolean>").alias("inliers"), F.lit("too_few_matches").alias("reason"),
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            i, j = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            size, *sides = seen(batch)
            first = np.cumsum(size) - size
            order, start = np.argsort(size, kind="stable"), 0
            while start < len(order):
                end = start + 1
                while end < len(order) and (end + 1 - start) * size[order[end]] <= AT_ONCE:
                    end += 1
                now = order[start:end]
                at = np.arange(size[now[-1]])
                there = at < size[now, None]
                b1, b2 = (side[np.where(there, first[now, None] + at, 0)] * there[:, :, None] for side in sides)
                yield _solve_pairs(i[now], j[now], size[now], b1, b2, least_inliers, least_ratio, threshold)
                start = end

    enough = pairs.filter(n >= least).withColumns({c: F.col(c).cast("long") for c in ("view_i", "view_j")})
    return enough.mapInArrow(solve, TWO_VIEW).unionByName(few)


TWO_VIEW_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("view_i", "view_j", "n_matches", "n_inliers")] + [(c, pa.list_(pa.float64())) for c in "rt"] + [("inliers", pa.list_(pa.bool_())), ("reason", pa.string())]
)


def two_view_poses(bearings: DataFrame, least_matches: int = 50, least_inliers: int = 50, least_ratio: float = 0.25, threshold: float = 0.005) -> DataFrame:
    """Relative pose x_j ~ R x_i + t of each pair of ``view_i, view_j, match_idx, b1, b2``, or why there is none.

    Pairs with too few matches are set aside before any row goes to Python. ``reason`` is ``ok``,
    ``too_few_matches``, ``too_few_inliers`` or ``too_low_ratio``; ``inliers`` is in the order of match_idx.
    A pair's matches are gathered in one row; they are bounded by its images' features.
    """
    lists = bearings.groupBy("view_i", "view_j").agg(F.array_sort(F.collect_list(F.struct("match_idx", "b1", "b2"))).alias("m"))
    return two_view_poses_of_lists(lists.select("view_i", "view_j", F.col("m.b1").alias("b1"), F.col("m.b2").alias("b2")), least_matches, least_inliers, least_ratio, threshold)


def random_subset(df: DataFrame, keys: Sequence[str], order: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, the same for the same seed: those first by a hash of their place in it."""
    rank = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), F.col(order)), order)
    return df.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= n).drop("_n")
