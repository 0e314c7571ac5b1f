"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Inner products become distances: every vector v gets one coordinate more, sqrt(M^2 - |v|^2) with M
the largest norm, a query is scaled to length M with 0 there; then the nearest point has the largest
inner product.  For each of ``curves`` orderings the points are projected by a random rotation
of its own, shifted by a random offset and numbered along a Hilbert curve.  Spark range-partitions
the numbers, which gives every point its position on every curve.

Positions are cut into blocks of ``block`` points.  A query meets the candidates of its own and of
the ``reach`` blocks on either side, on each curve; what the windows return is merged and ranked by
the exact inner products.  How far the windows must reach is measured, not assumed: for
``sample`` queries (those of the smallest hash) the true neighbours are found by a scan of all rows, and
the reach covers the distance along the nearest curve for a share ``recall`` of them.  Vectors with little structure
need wide windows, clustered ones narrow ones, at any number of rows.

Equal vectors are one point with its k + 1 smallest ids (a larger id among equals can be in no
answer), so a vector that a third of the rows share is one point, cut down before the shuffle.
No row count, block or window is gathered beyond its size: candidates of a block are at most
``block`` points, and queries stream past them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, pick

SEED = 11
AXES, BITS = 8, 7
QUERY, POINT = 1, 0


@functools.lru_cache(64)
def projection(dim: int, curve: int) -> np.ndarray:
    """``dim`` x ``AXES`` (or fewer) orthonormal random directions, the same wherever they are made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, curve, dim]).standard_normal((dim, min(dim, AXES))))
    return q * np.sign(np.diag(r))


@functools.lru_cache(64)
def shift(curve: int, axes: int) -> np.ndarray:
    return np.random.default_rng([SEED, curve]).random(axes) / 2


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of cells (points, axes) with coordinates of ``bits`` bits.

    Level by level, from the largest cubes down: a cube's corner number is turned into its place on
    the curve by the Gray code, after undoing the reflection and axis exchange of the cubes around it.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, rest = 1 << level, (1 << level) - 1
        for i in range(axes):
            flipped = (x[i] & bit) != 0
            swap = np.where(flipped, 0, (x[0] ^ x[i]) & rest)
            x[0] ^= np.where(flipped, rest, swap)
            if i:
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> level & 1)
    return key


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


class Space:
    """Lifted coordinates of points and queries, and their cells on each curve."""

    def __init__(self, dim: int, scale: float, longest: float) -> None:
        self.dim, self.scale, self.longest = dim, scale, longest
        self.mean: list[np.ndarray] = []
        self.spread: list[np.ndarray] = []

    def lifted(self, v: np.ndarray, kind: np.ndarray) -> np.ndarray:
        x = v / self.scale
        norm = np.sqrt((x * x).sum(axis=1))
        query = kind == QUERY
        last = np.where(query, 0.0, np.sqrt(np.maximum(self.longest ** 2 - norm ** 2, 0)))
        stretch = np.where(query, self.longest / np.where(norm > 0, norm, 1), 1.0)
        return np.concatenate([x * stretch[:, None], last[:, None]], axis=1)

    def keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        """Hilbert numbers: half of each axis of the cube holds four deviations to either side of the mean."""
        p = (lifted @ projection(self.dim + 1, curve) - self.mean[curve]) / self.spread[curve]
        t = shift(curve, p.shape[1]) + (p / 8 + 0.5) / 2
        return hilbert(np.clip(np.floor(t * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _usable(c: Column) -> Column:
    top = float(np.finfo(np.float64).max)
    return c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= top)) & F.exists(c, lambda v: v != 0)


def _spreads(points: DataFrame, space: Space, curves: int) -> None:
    """Mean and deviation of every projected axis over all points, rounded so that order of summation cannot matter."""
    width = min(space.dim + 1, AXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, curves, width))
        for b in batches:
            x = space.lifted(_rows(b.column("vec"), space.dim), np.full(b.num_rows, POINT))
            p = np.stack([x @ projection(space.dim + 1, c) for c in range(curves)])
            n += b.num_rows
            total += np.stack([p.sum(axis=1), (p * p).sum(axis=1)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size + 1), pa.int32()), pa.array(np.append(total.ravel(), n))],
                                         names=["i", "v"])

    got = points.select("vec").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    s = np.array([r["v"] for r in got])
    first, second = s[:-1].reshape(2, curves, width) / s[-1]
    space.mean = [np.round(m, 6) for m in first / space.longest * 1.0]
    space.mean = [m * space.longest for m in space.mean]
    dev = np.sqrt(np.maximum(second - first ** 2, 0)) / space.longest
    space.spread = [np.maximum(np.round(d, 6), 1e-6) * space.longest for d in dev]


def _ordered(both: DataFrame, space: Space, curves: int) -> DataFrame:
    """``(kind, u, v, at)``: positions ``at`` (an array by curve) of every point and query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = space.lifted(_rows(b.column("vec"), space.dim), b.column("kind").to_numpy())
            for c in range(curves):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(space.keys(x, c)), *(b.column(k) for k in ("kind", "u", "v"))],
                    names=["curve", "key", "kind", "u", "v"])

    kinds = "curve int, key long, kind int, u long, v long"
    order = ["curve", "key", "kind", "u", "v"]
    ranged = both.mapInArrow(run, kinds).repartitionByRange(partitions(both.sparkSession), *order).sortWithinPartitions(*order)
    # number of the partition and place in it, fixed by being written
    placed = materialize(ranged.withColumn("place", F.monotonically_increasing_id()).select("curve", "kind", "u", "v", "place"), "ordered")
    part = F.shiftright("place", 33)
    placed = placed.withColumn("part", part)
    sizes = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a curve and partition
    starts = sizes.select("curve", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (placed.join(F.broadcast(starts), ["curve", "part"])
            .groupBy("kind", "u", "v").agg(F.sort_array(F.collect_list(F.struct("curve", (F.col("place") - F.col("low") + F.col("start")).alias("pos"))))
                                           .alias("at")).withColumn("at", F.col("at.pos")))


def best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query row the ``most`` rows of ``c`` of largest inner product (ties to smaller ids) and the products.

    A matrix product chooses; what it leaves is computed again by one fixed order of summation, so a
    pair's product is the same in every window.
    """
    rough = q @ c.T
    out = []
    size = np.abs(c).max(initial=0) * c.shape[1]
    for i in range(len(q)):
        r = rough[i]
        if len(r) > most:
            slack = 1e-13 * size * max(1e-300, np.abs(q[i]).max(initial=0))
            at = np.flatnonzero(r >= np.partition(r, len(r) - most)[len(r) - most] - slack)
        else:
            at = np.arange(len(r))
        exact = (c[at] * q[i]).sum(axis=1)
        order = np.lexsort((ids[at], -exact))[:most]
        out.append((at[order], exact[order]))
    return out


FOUND = "array<struct<s: double, first: long, u: long, v: long>>"


def _found(pairs: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Array:
    """Lists of ``(negated product, smallest id, point)``: their natural order is the wanted one."""
    at = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    s = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0)
    items = pa.StructArray.from_arrays([pa.array(-s), pa.array(first[at]), pa.array(u[at]), pa.array(v[at])], ["s", "first", "u", "v"])
    ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in pairs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), items)


def _scan(points: DataFrame, sample: list, dim: int, most: int) -> DataFrame:
    """True neighbours of the sample: ``(q, found)``, by a scan of all points that keeps ``most`` a query and task."""
    vecs = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        vecs[i, :len(r["vec"])] = r["vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            c = _rows(b.column("vec"), dim)
            cols = [b.column(k).to_numpy() for k in ("first", "u", "v")]
            new = [(s, cols[0][at], cols[1][at], cols[2][at]) for at, s in best(vecs, c, cols[0], most)]
            if kept is not None:
                joined = [[np.concatenate(z) for z in zip(a, b2)] for a, b2 in zip(kept, new)]
                new = [tuple(z[np.lexsort((a[1], -a[0]))[:most]] for z in a) for a in joined]
            kept = new
        if kept is not None:
            pairs, flat = [], [np.concatenate([k[i] for k in kept]) for i in range(4)]
            lo = 0
            for k in kept:
                pairs.append((np.arange(lo, lo + len(k[0])), k[0]))
                lo += len(k[0])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(kept)), pa.int32()), _found(pairs, *flat[1:])], names=["q", "found"])

    parts = points.select("first", "u", "v", "vec").mapInArrow(run, f"q int, found {FOUND}")
    return parts.select("q", F.explode("found").alias("f")).withColumn(
        "r", F.row_number().over(Window.partitionBy("q").orderBy("f"))).where(F.col("r") <= most).select("q", "f.u", "f.v")


def _measured_reach(points: DataFrame, queries: DataFrame, dim: int, k: int, sample: int, recall: float, block: int) -> int:
    """Blocks to either side that hold a share ``recall`` of the sample's true neighbours on their nearest curve."""
    chosen = queries.orderBy("u", "v").limit(sample).collect()
    truth = _scan(points, chosen, dim, k + 1)
    spark = points.sparkSession
    places = spark.createDataFrame([(i, list(map(int, r["at"]))) for i, r in enumerate(chosen)], "q int, here array<long>")
    far = (truth.join(F.broadcast(places), "q").join(points.select("u", "v", "at"), ["u", "v"])
           .select(F.array_min(F.zip_with("at", "here", lambda a, b: F.abs(F.floor(a / F.lit(block)) - F.floor(b / F.lit(block))))).alias("d")))
    # at most sample * (k + 1) rows
    got = sorted(r["d"] for r in far.collect())
    return int(got[min(len(got) - 1, math.ceil(recall * len(got)) - 1)]) if got else 0


def _windows(points: DataFrame, queries: DataFrame, dim: int, most: int, reach: int, block: int, curves: int) -> DataFrame:
    """What each query finds in each block of its windows: ``(qu, qv, found)``."""
    def placed(df: DataFrame, side: int, *blocks: Column) -> DataFrame:
        return df.select(F.posexplode("at").alias("curve", "pos"), "first", "u", "v", "vec").select(
            "curve", F.floor(F.col("pos") / F.lit(block)).cast("long").alias("block"), F.lit(side).alias("side"), "first", "u", "v", "vec")

    near = placed(queries, QUERY).withColumn("block", F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.col("block") + reach)))
    both = placed(points, POINT).unionByName(near.select("curve", "block", "side", "first", "u", "v", "vec"))
    job = ["curve", "block"]
    both = both.repartition(partitions(points.sparkSession), *job).sortWithinPartitions(*job, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ready = None, [], None
        for b in batches:
            curve, blk, side = (b.column(c).to_numpy() for c in ("curve", "block", "side"))
            change = np.flatnonzero((np.diff(curve) != 0) | (np.diff(blk) != 0) | (np.diff(side) != 0)) + 1
            cuts = [0, *change.tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if here != (curve[lo], blk[lo]):
                    here, held, ready = (curve[lo], blk[lo]), [], None
                part = b.slice(lo, hi - lo)
                if side[lo] == POINT:
                    held.append(part)
                    continue
                if not held:  # a block of queries alone, or beyond the last one
                    continue
                if ready is None:
                    t = pa.Table.from_batches(held)
                    ready = (np.concatenate([_rows(h.column("vec"), dim) for h in held]),
                             *(t.column(c).to_numpy() for c in ("first", "u", "v")))
                for at in range(0, part.num_rows, 512):
                    q = part.slice(at, 512)
                    pairs = best(_rows(q.column("vec"), dim), ready[0], ready[1], most)
                    yield pa.RecordBatch.from_arrays([q.column("u"), q.column("v"), _found(pairs, *ready[1:])], names=["qu", "qv", "found"])

    return both.mapInArrow(run, f"qu long, qv long, found {FOUND}")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20,
            curves: int = 6, block: int = 1024, sample: int = 256, recall: float = 0.97) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Rows without an id, and vectors that are null, empty, zero or hold a null or non-finite component,
    take no part.  Vectors of different length compare as if filled with zeros.  Rows that are equal in id and
    vector are one query, and each is a candidate (of the others too); different vectors that share
    an id are queries of their own.  Scores are inner products in double precision, summed in one fixed order.
    """
    spark = vectors.sparkSession
    d = pick(vectors, vec_id=id_col, vec=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    if d.schema["vec"].dataType.simpleString() != "array<float>":  # single precision travels as it is
        d = d.withColumn("vec", F.col("vec").cast("array<double>"))
    d = d.where(F.col("vec_id").isNotNull() & _usable(F.col("vec")))
    name = [F.xxhash64("vec").alias("u"), F.xxhash64(F.lit(SEED), F.col("vec")).alias("v")]
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    # the limit is applied before the shuffle too, so many copies of a vector are few rows
    points = (d.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
              .select("vec", "ids", *name))
    points = materialize(points.withColumn("first", F.col("ids")[0]), "points")
    asked = d.where(F.col("vec_id") % every == 0).select("vec_id", *name).distinct()
    head = points.agg(F.max(F.size("vec")).alias("dim"), F.max(F.array_max(F.transform("vec", lambda c: F.abs(c)))).cast("double").alias("top")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if head["dim"] is None:
        return spark.createDataFrame([], out)
    dim, scale = head["dim"], head["top"]
    square = F.aggregate("vec", F.lit(0.0), lambda a, c: a + (c.cast("double") / scale) * (c.cast("double") / scale))
    space = Space(dim, scale, math.sqrt(points.agg(F.max(square)).first()[0]))
    _spreads(points, space, curves)
    wanted = points.join(asked.select("u", "v").distinct(), ["u", "v"], "left_semi")
    both = (points.select(F.lit(POINT).alias("kind"), "u", "v", "vec")
            .unionByName(wanted.select(F.lit(QUERY).alias("kind"), "u", "v", "vec")))
    at = materialize(_ordered(both, space, curves), "positions")
    points = points.join(at.where(F.col("kind") == POINT).drop("kind"), ["u", "v"])
    points = materialize(points, "placed")
    queries = points.drop("at").join(at.where(F.col("kind") == QUERY).drop("kind"), ["u", "v"])
    reach = _measured_reach(points, queries, dim, k, sample, recall, block)
    found = _windows(points, queries, dim, k + 1, reach, block, curves)
    # a point lies in one block a curve, so it is found ``curves`` times at most
    first = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, (k + 1) * curves)
    merged = (found.groupBy("qu", "qv").agg(first.alias("f"))
              .select("qu", "qv", F.explode(F.slice(F.array_distinct("f"), 1, k + 1)).alias("f"))
              .select("qu", "qv", "f.s", "f.u", "f.v"))
    listed = merged.join(points.select("u", "v", "ids"), ["u", "v"]).groupBy("qu", "qv").agg(
        F.collect_list(F.struct("s", "ids", ((F.col("u") == F.col("qu")) & (F.col("v") == F.col("qv"))).alias("own"))).alias("f"))

    def others(f: Column) -> Column:
        """Ids of a found point without the query's own row, which is one of its equals."""
        mine = F.when(f["own"], F.array_position(f["ids"], F.col("vec_id"))).otherwise(F.lit(0))
        ids = F.filter(f["ids"], lambda x, i: i + 1 != mine)
        return F.transform(ids, lambda x: F.struct(f["s"].alias("s"), x.alias("id")))

    answers = asked.join(listed, (F.col("u") == F.col("qu")) & (F.col("v") == F.col("qv")))
    ranked = F.slice(F.array_sort(F.flatten(F.transform("f", others))), 1, k)
    return (answers.select(F.col("vec_id").alias("query_id"), F.posexplode(ranked).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score")))
