"""Embedding whitening by polarisation covariance.

Entries become whole numbers x = floor(256 c).  With n distinct vectors and sums S a dimension,
z = n x - S is n times the centred entry, a whole number too.  Spark aggregates the exact sum of z^2
for every dimension and of (z_a + z_b)^2 for every pair of dimensions; by polarisation
    cov(a, b) = (var(a + b) - var(a) - var(b)) / 2,
so differences of variances give every cross-covariance, exact until the one division at the end.
Only the covariance matrix (dimensions squared, whatever the rows) reaches the driver for ``eigh``.

Squares are split into limbs that cannot overflow, and partial sums travel as decimals, so every sum
is exact at any number of rows.  Three scans of the distinct vectors (sums, squares, check of the
identity) and one of all rows; the only shuffle of vectors is the one that makes them distinct.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

SCALE = 256
#: Exact sums travel as ``high * BASE + low``.
BASE = 10 ** 18
LIMB = 24
ROWS = 1 << 12


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Whole-number vectors as rows, shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def exact_column_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of whole numbers below 2^62, exact."""
    return [(int(h) << 32) + int(l) for h, l in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]


def exact_square_sums(w: np.ndarray) -> list[int]:
    """Sums of the squares of each column, exact; at most ``ROWS`` rows a call.

    Entries below 2^47 are split into two limbs of 24 bits whose products, over ``ROWS`` rows, stay
    below 2^63; larger ones are summed as Python integers.
    """
    if w.dtype == object or (w.size and max(int(w.max()), -int(w.min())) >= 1 << 47):
        return [sum(v * v for v in col) for col in w.astype(object).T.tolist()]
    low, high = w & ((1 << LIMB) - 1), w >> LIMB
    parts = [np.einsum("ij,ij->j", a, b) for a, b in ((low, low), (high, low), (high, high))]
    return [int(a) + (int(b) << LIMB + 1) + (int(c) << 2 * LIMB) for a, b, c in zip(*parts)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, as 64-bit numbers where they fit and Python integers otherwise."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _sums(df: DataFrame, keys: str, names: list[str], width: int, add: Callable[[np.ndarray], dict]) -> dict[tuple, int]:
    """Exact sums by key of ``add(rows)`` over all vectors: one row a key and task, combined by Spark."""
    columns = [f"{k} {t}" for k, t in zip(names, ["int"] * len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                for k, v in add(_matrix(b.column(keys).slice(lo, ROWS), width)).items():
                    total[k] = total.get(k, 0) + v
        if total:
            split = [divmod(v, BASE) for v in total.values()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in total], pa.int32()) for i in range(len(names))),
                 *(pa.array([Decimal(s[i]) for s in split], pa.decimal128(38, 0)) for i in (0, 1))], names=[*names, "high", "low"])

    parts = df.select(keys).mapInArrow(run, ", ".join([*columns, "high decimal(38,0)", "low decimal(38,0)"]))
    return {tuple(r[k] for k in names): int(r["h"]) * BASE + int(r["l"])
            for r in parts.groupBy(*names).agg(F.sum("high").alias("h"), F.sum("low").alias("l")).collect()}


def _add_sums(x: np.ndarray) -> dict[tuple, int]:
    return {(-1,): len(x), **{(i,): s for i, s in enumerate(exact_column_sums(x))}}


def _add_squares(x: np.ndarray, n: int, sums: list[int]) -> dict[tuple, int]:
    """Squares of every dimension ``(a, a)`` and of every sum of two ``(a, b)``, a < b."""
    z, out = centred(x, n, sums), {}
    for a in range(x.shape[1]):
        out[a, a] = exact_square_sums(z[:, a:a + 1])[0]
        for b, s in enumerate(exact_square_sums(z[:, a:a + 1] + z[:, a + 1:]), a + 1):
            out[a, b] = s
    return out


def covariance(squares: dict[tuple, int], n: int, dim: int) -> np.ndarray:
    """Covariances (divisor n) from the polarised sums; each entry is rounded once."""
    v = np.zeros((dim, dim))
    for a in range(dim):
        for b in range(a, dim):
            # the sums hold n^2 times the squares of centred entries
            top = 2 * squares[a, a] if a == b else squares[a, b] - squares[a, a] - squares[b, b]
            v[a, b] = v[b, a] = top / (2 * n ** 3)
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues (falling) and unit eigenvectors as rows; the largest entry of each is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u.T[::-1][:most]
    sign = np.sign(u[np.arange(len(u)), np.abs(u).argmax(axis=1)])
    return e, u * sign[:, None]


def _project(x: np.ndarray, n: int, sums: list[int], e: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(whitened, z)`` of rows of whole numbers; a component without variance whitens to NaN."""
    z = centred(x, n, sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(e > 0, (z / n).astype(np.float64) @ u.T / np.sqrt(np.maximum(e, 0)), np.nan), z


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector is not null and has only finite entries."""
    d = pick(vectors, vec_id=id_col, vec=vector_col).withColumn("vec", F.col("vec").cast("array<double>"))
    top = float(np.finfo(np.float64).max)
    good = F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= top))
    edge = float(1 << 61)  # keeps x a long whatever c
    return d.where(good).select("vec_id", F.transform("vec", lambda c: F.floor(
        F.greatest(F.least(c * SCALE, F.lit(edge)), F.lit(-edge)))).alias("x"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)``.

    One row for each remaining row and component (``most`` or the dimensions, if fewer).  Repeated
    rows and null ids have rows of their own; the fit counts each distinct vector once.  Vectors of
    different length compare as if filled with zeros; empty vectors have no components if all are
    empty.  ``deviation`` is null beyond a long; ``deviation_exact`` (38 digits) has it until about
    10^12 vectors.  A component without variance has a null ``whitened`` and no part in the error;
    ``explained`` is null if no component has variance.  Entries beyond 2^53 saturate at 2^61.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vector_col)
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if dim:
        padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), dim - F.size("x")))
        rows = rows.withColumn("x", padded)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, deviation_exact decimal(38,0)")
    if not dim:
        return spark.createDataFrame([], schema)
    distinct = materialize(rows.select("x").distinct(), "whole")
    got = _sums(distinct, "x", ["a"], dim, _add_sums)
    n, sums = got[-1,], [got[i,] for i in range(dim)]
    squares = _sums(distinct, "x", ["a", "b"], dim, functools.partial(_add_squares, n=n, sums=sums))
    v = covariance(squares, n, dim)
    e, u = components(v, most)
    trace = float(np.trace(v))
    # eigh leaves rounding where there is no variance
    e = np.where(e > trace * dim * np.finfo(float).eps, e, 0.0)
    error = _identity_error(distinct, n, sums, e, u)
    k = len(e)
    share = e / trace if trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, ROWS):
                b = big.slice(lo, ROWS)
                x = _matrix(b.column("x"), dim)
                w, z = _project(x, n, sums, e, u)
                total = [sum(t * t for t in r) for r in z.tolist()]
                at = np.repeat(np.arange(b.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                     pa.array(np.full(len(at), n, np.int64)),
                     pa.array([t if t < 1 << 63 else None for t in total], pa.int64()).take(pa.array(at)),
                     pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, b.num_rows), from_pandas=True),
                     pa.array(np.full(len(at), error)),
                     pa.array([Decimal(t) if t < 10 ** 38 else None for t in total], pa.decimal128(38, 0)).take(pa.array(at))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(run, schema)


def _identity_error(distinct: DataFrame, n: int, sums: list[int], e: np.ndarray, u: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on its rows."""
    dim, live = len(sums), np.flatnonzero(e > 0)
    if not len(live):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for b in batches:
            w = _project(_matrix(b.column("x"), dim), n, sums, e[live], u[live])[0]
            total += w.sum(axis=0)
            product += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size + product.size), pa.int32()),
                                          pa.array(np.concatenate([total, product.ravel()]))], names=["i", "v"])

    got = distinct.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    s = np.array([r["v"] for r in got])
    mean, second = s[:len(live)] / n, s[len(live):].reshape(len(live), -1) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(len(live))).max())
