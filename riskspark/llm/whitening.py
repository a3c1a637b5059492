"""Whitening of vectors by their principal components.

The components come from the centred scatter matrix in two steps. A pivoted Cholesky factorisation, which always
goes on with the largest diagonal left, writes the scatter as L L' (rows permuted) and stops where nothing is left: its
columns are the rank. One-sided Jacobi then rotates pairs of columns of L until all are orthogonal: their squared
lengths are the eigenvalues, the columns divided by their lengths the components. Small eigenvalues keep their
relative precision, because the factor and not the scatter is rotated.

Entries are integers, and so are the sums: vectors are centred at the whole number next to the mean, multiplied,
summed exactly, and the rest of the centring is taken off exactly. The result doesn't depend on the partitions.
Entries may be of any size whose squares are doubles (below 1e150).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1_024, 100_000
COMPONENTS = 8
#: Columns of the factor left out: what remains of the diagonal, as a share of its largest entry at first.
RANK_TOLERANCE = 1e-14
SWEEPS = 60
EXACT = 1 << 52
DIGIT = 1 << 60


def usable(vector: str, width: int | None = None) -> Column:
    """A vector without null or non-finite entries, not empty (and of this width)."""
    v = F.col(vector)
    xs = F.transform(v, lambda x: x.cast("double"))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine if width is None else fine & (F.size(v) == width), F.lit(False))


def whole(values: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) + SHIFT of a batch of vectors: int64, or Python integers where they don't fit."""
    x = np.floor(SCALE * values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width))
    if x.size and np.abs(x).max() >= EXACT:
        return np.array([[int(c) + SHIFT for c in row] for row in x], object).reshape(-1, width)
    return x.astype(np.int64) + SHIFT


def product(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """y' z, exactly: in doubles if no sum can leave their whole numbers, else in Python integers."""
    most = max((abs(int(m.max())) if m.size else 0) + (abs(int(m.min())) if m.size else 0) for m in (y, z))
    if most * most * max(1, len(y)) < EXACT:
        return (y.astype(float).T @ z.astype(float)).astype(np.int64).astype(object)
    return y.astype(object).T @ z.astype(object)


def digits(v: int) -> list[int]:
    """The digits of an integer to the base DIGIT, lowest first, each with its sign."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v or not out:
        v, digit = divmod(v, DIGIT)
        out.append(sign * digit)
    return out


def summed(df: DataFrame, width: int, rows, name: str) -> dict[tuple[int, int], int]:
    """Exact sums over all vectors of a matrix that `rows` makes of a batch; cells are summed by key, not gathered."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = rows(whole(batch.column(0), width))
                total = m if total is None else total + m
        if total is not None:
            parts = [(i, j, at, digit) for (i, j), v in np.ndenumerate(total) for at, digit in enumerate(digits(int(v)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*parts)], names=["i", "j", "at", "digit"])

    found = df.select(name).mapInArrow(cells, "i long, j long, at long, digit long")
    exact = found.groupBy("i", "j", "at").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("s")).toArrow()
    out: dict[tuple[int, int], int] = {}
    for i, j, at, s in zip(*(exact[c].to_pylist() for c in ("i", "j", "at", "s"))):
        out[i, j] = out.get((i, j), 0) + int(s) * DIGIT**at
    return out


def pivoted_cholesky(a: np.ndarray, tolerance: float = RANK_TOLERANCE) -> np.ndarray:
    """L with a = L L', rows in the order of `a`; as many columns as the rank."""
    left = a.astype(float).copy()
    n = len(left)
    least = tolerance * max(left.diagonal().max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    taken = np.zeros(n, bool)
    for _ in range(n):
        diagonal = np.where(taken, -np.inf, left.diagonal())
        p = int(diagonal.argmax())
        if not diagonal[p] > least:
            break
        column = np.where(taken, 0.0, left[:, p]) / np.sqrt(diagonal[p])
        columns.append(column)
        taken[p] = True
        left -= np.outer(column, column)
    return np.stack(columns, axis=1) if columns else np.zeros((n, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of factor factor': its columns rotated until orthogonal.

    Pairs are taken in rounds of disjoint columns, so that a round is one vector operation.
    """
    u = factor.copy()
    k = u.shape[1]
    ring = list(range(k + k % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if a < k and b < k]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = u[:, p], u[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            some = np.abs(xy) > 1e-16 * size
            worst = max(worst, float(np.max(np.abs(xy[some]) / size[some], initial=0.0)))
            gap = (yy - xx) / np.where(some, 2 * xy, 1.0)
            t = np.where(some, np.where(gap >= 0, 1.0, -1.0) / (np.abs(gap) + np.hypot(1.0, gap)), 0.0)
            c = 1 / np.hypot(1.0, t)
            u[:, p], u[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst < 1e-15:
            break
    values = (u * u).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order] / np.sqrt(values[order])


@dataclass(frozen=True)
class Whitening:
    """Mean (sums and count), components and eigenvalues of the fit vectors; its size is width x components."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part exactly, then the fraction."""
        middle = np.array([s // self.n for s in self.sums], object if x.dtype == object else np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - middle).astype(float) - rest

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exactly; null where it is no 64-bit integer."""
        most = max((abs(self.n * int(v) - s) for s, lo, hi in zip(self.sums, x.min(axis=0), x.max(axis=0)) for v in (lo, hi)), default=0)
        if x.dtype != object and self.n * int(np.abs(x).max(initial=0)) < 1 << 62 and most * most * max(1, self.width) < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        out = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in out]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean and components over all usable vectors of `df`; None if there is none.

    The width is the commonest one (the smaller of equally common ones); other vectors are not usable. Only
    width x width sums reach the driver. Components without variance are left out.
    """
    sizes = df.where(usable(vector)).groupBy(F.size(vector).alias("width")).count()
    top = sizes.orderBy(F.desc("count"), "width").first()
    if top is None:
        return None
    width, n = int(top["width"]), int(top["count"])
    rows = df.where(usable(vector, width))
    cells = summed(rows, width, lambda x: x.astype(object).sum(axis=0).reshape(1, -1) if x.dtype == object else x.sum(axis=0).astype(object).reshape(1, -1), vector)
    sums = tuple(cells[0, j] for j in range(width))
    middle = [(2 * s + n) // (2 * n) for s in sums]

    def scatter(x: np.ndarray) -> np.ndarray:
        y = x - np.array(middle, object if x.dtype == object else np.int64)
        return product(y, y)

    cells = summed(rows, width, scatter, vector)
    rest = [s - n * m for s, m in zip(sums, middle)]
    # n^2 V = n sum(y y') - R R' with the remainders R of the centring, exactly; then one rounding.
    v = np.array([[float(Fraction(n * cells[i, j] - rest[i] * rest[j], n * n)) for j in range(width)] for i in range(width)])
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    kept = min(components, len(values))
    return Whitening(n, sums, vectors[:, :kept].copy(), values[:kept].copy(), float(v.trace()))


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest entry, by size, of the whitened vectors' covariance minus the identity; their mean is taken off first."""
    k = len(model.eigenvalues)

    def sums(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.apply(whole(batch.column(0), model.width)) - mean
                one += w.sum(axis=0)
                two += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate((one, two.ravel())))], names=["i", "x"])

    def total(mean: np.ndarray) -> np.ndarray:
        found = rows.select(vector).mapInArrow(lambda b: sums(b, mean), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(k * k + k)
        out[found["i"].to_numpy()] = found["x"].to_numpy()
        return out

    mean = total(np.zeros(k))[:k] / model.n
    covariance = total(mean)[k:].reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whitened(df: DataFrame, model: Whitening | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, n, deviation, whitened array): every usable vector of the model's width, in its partition.

    Rows with an unusable vector are left out; null and repeated keys are rows like others; other columns are left out.
    """
    fields = f"`{key}` {df.schema[key].dataType.simpleString()}, n long, deviation long, whitened array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(batch.column(1), model.width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([model.n] * len(x), pa.int64()), pa.array(model.deviation(x), pa.int64()),
                     pa.array(model.apply(x).tolist(), pa.list_(pa.float64()))],
                    names=[key, "n", "deviation", "whitened"],
                )

    return df.where(usable(vector, model.width)).select(key, vector).mapInArrow(run, fields)


def embedding_whitening(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector and component.

    Vectors without any variance have no component and so no row.
    """
    model = fit(df, vector)
    rows = whitened(df, model, vector, key)
    explained = [] if model is None else (model.eigenvalues / model.trace).tolist()
    error = 0.0 if model is None or not explained else identity_error(df.where(usable(vector, model.width)), model, vector)
    share = F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("component") - 1)
    return rows.select(key, "n", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened"
    ).select(key, "component", "n", "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
