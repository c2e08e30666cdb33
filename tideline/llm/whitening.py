"""Embedding whitening: principal components of a vector column, scaled to unit variance.

Every vector entry c becomes the long floor(1024 c) + 100000. Two passes give the fit: exact sums by dimension, then the
products of the entries less their means, summed by task and then by cell of the covariance. The covariance, d x d numbers
for vectors of d entries whatever the table's size, is brought to tridiagonal form by Householder reflections; Sturm counts bisect its leading
eigenvalues, and inverse iteration finds their vectors, made orthogonal again within clusters of close eigenvalues. The
components are broadcast (d x k numbers) and every row is projected on them.

Rows whose vector is null or has a null or non-finite entry are left out, as are those with an entry of 2^40 or more,
which has no exact long here, those of an empty vector, and those of another length than the commonest (of equally common ones the longest).
Repeated rows count as often as they occur; a null id stays. Equal eigenvalues have any orthonormal vectors of their
space. A component without variance (all vectors alike) has whitened values of 0. A deviation over the range of a long is
null. A table without vectors gives an empty result. Other columns stay; those with the name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, others, table

MOST = float(1 << 40)
#: Eigenvalues closer than this share of the norm are one cluster.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q' a q tridiagonal, by Householder reflections of a symmetric matrix."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if length == 0.0:
            continue
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2.0 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2.0 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each value: the negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    term = diagonal[0] - at
    count = (term < 0).astype(np.int64)
    for a, b in zip(diagonal[1:], off * off, strict=True):
        term = np.where(np.abs(term) < tiny, -tiny, term)
        term = a - at - b / term
        count += term < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling; all are bisected at once, down to neighbouring doubles."""
    d = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    high = np.nextafter(high, np.inf)
    rank = d - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        below = sturm_count(diagonal, off, middle) > rank
        high, low = np.where(below, middle, high), np.where(below, low, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = right, by elimination with row exchanges; no pivot is taken smaller than ``least``."""
    d = len(diagonal)
    main, upper, second, y = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.copy()
    for i in range(d - 1):
        lower = off[i]
        if abs(main[i]) >= abs(lower):
            main[i] = main[i] if abs(main[i]) > least else least
            share = lower / main[i]
            main[i + 1] -= share * upper[i]
            y[i + 1] -= share * y[i]
        else:
            share = main[i] / lower
            main[i], upper[i], main[i + 1] = lower, main[i + 1], upper[i] - share * main[i + 1]
            second[i], upper[i + 1] = upper[i + 1], -share * upper[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - share * y[i + 1]
    x = np.zeros(d + 2)
    for i in range(d - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > least else least
        x[i] = (y[i] - upper[i] * x[i + 1] - second[i] * x[i + 2]) / pivot
    return x[:d]


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of falling eigenvalues, as columns, by inverse iteration; those of one cluster are made orthogonal in every step."""
    d, out = len(diagonal), np.zeros((len(diagonal), len(values)))
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)) or 1.0
    diagonal, off, values = diagonal / norm, off / norm, values / norm
    eps, rng, first = np.finfo(float).eps, np.random.default_rng(0), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER:
            first = j
        x = rng.standard_normal(d)
        for _ in range(5):
            x = _solve(diagonal, off, value - 4 * eps * (j - first), x / np.linalg.norm(x), eps)
            for _ in range(2):
                x /= np.linalg.norm(x)
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def principal_axes(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    diagonal, off, q = tridiagonal(v)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    return values, q @ eigenvectors(diagonal, off, values)


@dataclass
class Whitening:
    """A fit: rows, exact sums, and the components with variance and share of the trace; ``scaled`` projects to unit variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def scaled(self) -> np.ndarray:
        return np.divide(self.components, np.sqrt(self.values), out=np.zeros_like(self.components), where=self.values > 0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exact; None where over the range of a long."""
        sums = np.array(self.sums, dtype=object)
        most = max(self.n * int(np.abs(x).max(initial=0)), int(np.abs(sums).max()))
        if most < 1 << 61:
            z = self.n * x - sums.astype(np.int64)
            if int(np.abs(z).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
                return (z * z).sum(axis=1).tolist()
        out = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in out]


def entries(column: pa.Array, d: int) -> np.ndarray:
    """The long entries of a list column of d-vectors, one row a vector."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(1024.0 * c).astype(np.int64) + 100_000


def usable(df: DataFrame, vector: str, d: int | None = None) -> DataFrame:
    """Rows whose vector has d entries (any number from one on, without d), none of them null, not finite or out of range."""
    fine = F.forall(F.col(vector).cast("array<double>"), lambda c: F.coalesce(F.abs(c) < MOST, F.lit(False)))
    return df.filter(fine & ((F.size(vector) == d) if d else (F.size(vector) > 0)))


def _sums_by_cell(vectors: DataFrame, sums_of, kind: str) -> dict:
    """Sums of the cells that ``sums_of`` (batches of lists -> sums) gives for each task: reduced by cell in a shuffle."""

    def run(batches):
        total = None
        for b in batches:
            part = sums_of(b.column(0))
            total = part if total is None else total + part
        if total is not None:
            cells = total.tolist() if kind == "double" else [Decimal(int(v)) for v in total]
            made = pa.array(cells, pa.float64() if kind == "double" else pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(range(len(cells)), pa.int32()), made], names=["cell", "total"])

    parts = vectors.mapInArrow(run, f"cell int, total {kind}")
    total = F.sum("total") if kind == "double" else F.sum("total").cast("decimal(38,0)")
    return {r.cell: r.total for r in parts.groupBy("cell").agg(total.alias("total")).collect()}


def fit_whitening(df: DataFrame, vector: str = "embedding", k: int = 8) -> Whitening | None:
    """The fit over all usable rows of df, or None where there are none."""
    sizes = usable(df, vector).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    d, n = sizes["d"], sizes["count"]
    vectors = usable(df, vector, d).select(F.col(vector).cast("array<double>"))

    def plain(column):
        x = entries(column, d)
        # Sums of a batch fit a long: its rows are far fewer than 2^12.
        return x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) >= 1 << 40 else x.sum(axis=0).astype(object)

    by_cell = _sums_by_cell(vectors, plain, "decimal(38,0)")
    sums = [int(by_cell[i]) for i in range(d)]
    mean = np.array([s / n for s in sums])
    upper = np.triu_indices(d)

    def centred(column):
        x = entries(column, d) - mean
        return (x.T @ x)[upper]

    by_cell = _sums_by_cell(vectors, centred, "double")
    v = np.zeros((d, d))
    v[upper] = [by_cell[i] / n for i in range(len(upper[0]))]
    v = np.triu(v) + np.triu(v, 1).T
    values, components = principal_axes(v, k)
    trace = np.trace(v)
    values = np.where(values > d * np.finfo(float).eps * trace, values, 0.0)
    return Whitening(n, sums, values, components, values / trace if trace > 0 else np.zeros(len(values)))


def whiten(df: DataFrame, fit: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The usable rows of df with ``whitened``, their values on the components, and ``deviation``."""
    keep = others(df, "whitened", "deviation")
    if fit is None:
        return df.filter(F.lit(False)).select(*keep, F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("long").alias("deviation"))
    d, shared = len(fit.sums), df.sparkSession.sparkContext.broadcast(fit)

    @F.arrow_udf("struct<whitened: array<double>, deviation: long>")
    def project(column: pa.Array) -> pa.Array:
        model = shared.value
        x = entries(column, d)
        w = (x - np.array([s / model.n for s in model.sums])) @ model.scaled
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))
        return pa.StructArray.from_arrays([lists, pa.array(model.deviations(x), pa.int64())], ["whitened", "deviation"])

    got = project(F.col(vector).cast("array<double>"))
    (named,) = fresh(df, "_whitening")
    out = usable(df, vector, d).withColumn(named, got)
    return out.select(*keep, f"{named}.whitened", f"{named}.deviation")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` (means taken off) less the identity, over components with variance."""

    def products(column):
        w = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return np.concatenate([[len(w)], w.sum(axis=0), (w.T @ w).ravel()])

    by_cell = _sums_by_cell(whitened.select("whitened"), products, "double")
    if not by_cell:
        return 0.0
    cells = np.array([by_cell[i] for i in range(len(by_cell))])
    mean = cells[1 : k + 1] / cells[0]
    cov = cells[k + 1 :].reshape(k, k) / cells[0] - np.outer(mean, mean)
    live = np.diag(cov) > 0
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max(initial=0.0))


def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fit = fit_whitening(vectors, k=8)
    rows = whiten(vectors, fit).select("vec_id", "deviation", "whitened")
    k = len(fit.values) if fit else 0
    error = identity_error(rows, k) if fit else 0.0
    explained = F.array(*(F.lit(float(v)) for v in fit.explained)) if fit else F.lit(None).cast("array<double>")
    out = rows.select("vec_id", F.lit(fit.n if fit else 0).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    component = F.col("place") + 1
    return out.select(
        "vec_id", component.cast("int").alias("component"), "n", "deviation", "whitened",
        F.element_at(explained, component).alias("explained"), F.lit(error).alias("identity_error"),
    )
