"""Whitening of embeddings by eigenvectors that are refined in mixed precision.

Vectors are turned into integers, so their sums and products are exact and
don't depend on how rows are dealt. Spark sums them; the driver holds matrices
of the dimension only. Single-precision eigenvectors of the covariance are
corrected by matrix products in extended precision (Ogita and Aishima's
iteration); eigenvalues that it cannot tell apart yet are solved by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values. An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Correction steps; they converge quadratically, so a few are enough.
STEPS = 24
#: Sums are moved in two parts, as one decimal has 38 digits.
PART = 10**18
#: Rows that are multiplied at once.
BLOCK = 2_048
Real = np.longdouble


def whole_vectors(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of usable vectors, and their integers as matrices of up to ``BLOCK`` rows.

    Vectors are left out if they are null, empty, hold a null, infinite or
    undefined entry or one whose integer is beyond 61 bits, or don't have the
    ``dimension``. Without one, vectors of one length after the other come.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    places, blocks = [], []
    for d in [dimension] if dimension else sorted(set(lengths[lengths > 0].tolist())):
        at = np.flatnonzero(lengths == d)
        for a in range(0, len(at), BLOCK):
            rows = at[a : a + BLOCK]
            flat = column.take(pa.array(rows)).flatten()
            entries = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64).reshape(len(rows), d)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(entries * SCALE)
                good = (np.abs(scaled) < 2.0**61).all(axis=1)
            places.append(rows[good])
            blocks.append(scaled[good].astype(np.int64) + SHIFT)
    return (np.concatenate(places) if places else np.zeros(0, np.int64)), blocks


def exact_total(x: np.ndarray) -> np.ndarray:
    """Column sums of an integer matrix as Python integers."""
    if x.size and int(np.abs(x).max()) < 1 << 50:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0) if len(x) else np.zeros(x.shape[1], object)


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of an integer matrix of at most ``BLOCK`` rows as Python integers.

    Entries are cut into limbs of 20 bits, whose products double precision sums exactly.
    """
    limbs, sign, rest = [], np.sign(y), np.abs(y)
    while rest.any():
        limbs.append((sign * (rest & 0xFFFFF)).astype(np.float64))
        rest = rest >> 20
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out = out + ((a.T @ b).astype(np.int64).astype(object) << (20 * (i + j)))
    return out


def _batch_of_sums(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    d, i, j, value = (list(c) for c in zip(*rows))
    high = [Decimal(v // PART) for v in value]
    low = [Decimal(v % PART) for v in value]
    money = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, money), pa.array(low, money)], ["d", "i", "j", "high", "low"])


def _sums(vectors: DataFrame, name: str, per_block: Callable[[np.ndarray], np.ndarray], dimension: int | None = None) -> DataFrame:
    """``d, i, j, total high, low``: integer tables of each task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in whole_vectors(batch.column(0), dimension)[1]:
                if len(x):
                    d = x.shape[1]
                    found = per_block(x)
                    totals[d] = totals[d] + found if d in totals else found
        for d, table in totals.items():
            for a in range(0, len(table), 64):
                rows = [(d, a + i, j, int(v)) for i, line in enumerate(table[a : a + 64]) for j, v in enumerate(line)]
                yield _batch_of_sums(rows)

    kinds = "d int, i int, j int, high decimal(38,0), low decimal(38,0)"
    return materialise(vectors.mapInArrow(run, kinds).groupBy("d", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")), name)


def _table(sums: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, object)
    for r in sums.collect():
        out[r["i"], r["j"]] = int(r["high"]) * PART + int(r["low"])
    return out


def fit_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """The dimension, the number of vectors with it and their sums per dimension, all exact.

    The dimension is that of most usable vectors (of equally many, the smaller).
    """
    sums = _sums(vectors, "vector-sums", lambda x: np.vstack([exact_total(x), np.full(x.shape[1], len(x), object)]))
    most = sums.filter("i = 1 AND j = 0").orderBy(F.desc("high"), F.desc("low"), "d").select("d").first()
    if most is None:
        return 0, 0, []
    found = _table(sums.filter(F.col("d") == most["d"]), (2, most["d"]))
    return most["d"], int(found[1, 0]), [int(v) for v in found[0]]


def _rounded(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor ``n``) in extended precision, from exact sums of vectors centred to the nearest integer of their mean."""
    centre = [_rounded(s, n) for s in sums]

    def centred(x: np.ndarray) -> np.ndarray:
        return exact_products(x - np.array(centre, np.int64))

    d = len(sums)
    products = _table(_sums(vectors, "vector-products", centred, d), (d, d))
    rest = [s - n * c for s, c in zip(sums, centre)]
    out = np.zeros((d, d), Real)
    for i in range(d):
        for j in range(d):
            # n * n times the covariance, an integer; its two parts keep the digits that one double would lose
            value = n * products[i, j] - rest[i] * rest[j]
            high = float(value)
            out[i, j] = (Real(high) + Real(float(value - int(high)))) / Real(n) / Real(n)
    return out


def _close_groups(values: np.ndarray, within: Real) -> list[np.ndarray]:
    """Places of runs of two or more rising ``values`` whose neighbours are at most ``within`` apart."""
    cuts = np.flatnonzero(np.diff(values) > within) + 1
    return [g for g in np.split(np.arange(len(values)), cuts) if len(g) > 1]


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix, in extended precision.

    Single-precision eigenvectors X are corrected by X (I + E), where E comes
    from R = I - X'X and S = X'AX. Pairs of eigenvalues closer than the error
    bound of S are only made orthogonal; then the matrix seen from such a
    group, less its mean eigenvalue, is solved by itself, which tells apart
    eigenvalues far below single precision. Each largest entry is positive.
    """
    d = len(a)
    a = (a + a.T) / 2
    size = np.abs(a).max() if d else Real(0)
    if size == 0:
        return np.zeros(d, Real), np.eye(d, dtype=Real)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Real)
    eps = np.finfo(Real).eps
    norm = np.sqrt((a * a).sum())
    eye = np.eye(d, dtype=Real)
    least = 4 * d * eps
    for _ in range(STEPS):
        r = eye - x.T @ x
        s = x.T @ a @ x
        s = (s + s.T) / 2  # else the corrections of a pair would not be opposite, by rounding over the gap
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        off = s - np.diag(np.diag(s))
        if np.abs(r).max() <= least and np.abs(off).max() <= least * norm:
            break
        bound = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= bound
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        for g in _close_groups(values, bound):
            part = x[:, g]
            seen = part.T @ (a - values[g].mean() * eye) @ part
            seen = (seen + seen.T) / 2
            if np.abs(seen - np.diag(np.diag(seen))).max() > least * norm:
                x[:, g] = part @ np.linalg.eigh((seen / np.abs(seen).max()).astype(np.float64))[1].astype(Real)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = ((a @ x) * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    flip = np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    return values * size, x * flip


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of every usable vector and component.

    Usable vectors are those of ``whole_vectors`` with the dimension of most;
    all of them are fitted. ``deviation`` is the sum over the dimensions of
    (n x - S) squared, a decimal (null beyond 38 digits). Components whose eigenvalue is zero to double
    precision have no whitened values and are left out, so there are none if
    all vectors are equal. Null and repeated ids stay; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    out_kinds = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    only = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    d, n, sums = fit_sums(only)
    if not n:
        return spark.createDataFrame([], out_kinds)
    cov = covariance(only, n, sums)
    values, directions = eigenpairs(cov)
    rank = int((values > d * np.finfo(np.float64).eps * max(values[0], Real(0))).sum())
    k = min(components, rank)
    if not k:
        return spark.createDataFrame([], out_kinds)
    scale = (directions[:, :k] / np.sqrt(values[:k])).astype(np.float64)
    explained = (values[:k] / np.trace(cov)).astype(np.float64)
    centre = [_rounded(s, n) for s in sums]
    rest = np.array([float(s - n * c) / n for s, c in zip(sums, centre)])
    fits = max(map(abs, sums)) < 1 << 61

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - np.array(centre, np.int64)).astype(np.float64) - rest) @ scale

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for x in whole_vectors(batch.column(0), d)[1]:
                w = project(x)
                total, first = total + w.T @ w, first + w.sum(axis=0)
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.full(k, -1)), pa.int32()), pa.array(np.append(j, np.arange(k)), pa.int32()), pa.array(np.append(total.ravel(), first))], ["i", "j", "v"])

    seen = only.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    found = np.zeros((k + 1, k))
    for r in seen:
        found[r["i"], r["j"]] = r["v"]
    mean = found[-1] / n
    error = float(np.abs(found[:-1] / n - np.outer(mean, mean) - np.eye(k)).max())

    def deviations(x: np.ndarray) -> list[int]:
        if fits and n * int(np.abs(x).max()) < 1 << 61:
            away = n * x - np.array(sums, np.int64)
            if int(np.abs(away).max()) ** 2 * d < 1 << 63:
                return (away * away).sum(axis=1).tolist()
        away = x.astype(object) * n - np.array(sums, object)
        return (away * away).sum(axis=1).tolist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, blocks = whole_vectors(batch.column(1), d)
            a = 0
            for x in blocks:
                m = len(x)
                if not m:
                    continue
                ids = batch.column(0).take(pa.array(np.repeat(places[a : a + m], k)))
                a += m
                away = pa.array([Decimal(v) if v < 10**38 else None for v in deviations(x)], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)), away, pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(rows, out_kinds)
