"""Embedding near-dedup over randomised-rotation binary codes.

Unit vectors are rotated by a seeded random rotation and reduced to the signs of their
coordinates.  With each code goes its correction factor <o, o'>, the inner product of
the vector with its code (a unit vector); <o', q> / <o', o> is then an unbiased estimate of
<o, q>, off by about sqrt((1 - <o', o>^2) / (<o', o>^2 (d - 1))) times the sine of the angle
between o and q.  A pair whose estimate plus ``sigmas`` such errors (at the threshold's
angle) stays below the threshold is dismissed; every other pair is recomputed from
the vectors in double precision, and only that decides.

Pairs meet in bands of code bits of several rotations.  At the threshold two codes differ in a
share p = arccos(t) / pi of their bits, so a band of b bits agrees with probability
(1 - p)^b; the number of bands is chosen for the wanted recall.  A pair counts in
the first band where it meets.  Which groups have several members is found from the keys alone;
only then does a vector travel, and only to those groups.  A band's group is cut into blocks of ``block`` vectors,
and the pairs of blocks are compared in tasks of their own, so no group is
gathered whole; each task returns link counts and a spanning forest, never all pairs.

Equal vectors of a label are one vector with a count.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import complete_groups, materialize, partitions, pick
from .components import connected_components
from .op4_simhash import spanning

RECALL = 0.9999
SEED = 5


@functools.lru_cache(64)
def rotation(dim: int, number: int) -> np.ndarray:
    """Random rotation of ``dim`` dimensions, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, number, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bands_needed(bits: int, threshold: float, recall: float = RECALL) -> int:
    """Bands of ``bits`` code bits that let a pair at the threshold meet with the wanted recall."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def code_bands(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Band keys (vectors, bands) of unit vectors: ``bits`` signs each, of as many rotations as it takes."""
    n, dim = unit.shape
    need = bits * bands
    signs = np.concatenate([(unit @ rotation(dim, 1 + i)) >= 0 for i in range(-(-need // dim))], axis=1)[:, :need]
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs.reshape(n, bands, bits).astype(np.int64) @ weights


def _banded(vectors: DataFrame, bits: int, bands: int) -> DataFrame:
    """Add ``dim`` and ``keys`` (the band keys) to ``(label, vec, first, n)``; ``bits`` are at most 31."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("dim", T.IntegerType()),
                           T.StructField("keys", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("vec").value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = part.column("vec").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(x), dim, np.int32)),
                     pa.array(list(code_bands(x, bits, bands).astype(np.int32)), pa.list_(pa.int32()))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def compare_blocks(a: np.ndarray, b: np.ndarray, threshold: float, sigmas: float = 4.0
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows of ``a`` and ``b`` with inner product at the threshold, confirmed in double."""
    dim = a.shape[1]
    turn = rotation(dim, 0)
    ra, rb = (a @ turn).astype(np.float32), (b @ turn).astype(np.float32)
    code = np.where(rb >= 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(dim))
    factor = (rb * code).sum(axis=1).astype(np.float64)
    error = np.sqrt(np.maximum(0, 1 - factor ** 2) / (factor ** 2 * max(1, dim - 1))) * math.sqrt(1 - threshold ** 2)
    estimate = (ra @ code.T) / factor[None, :]
    i, j = np.nonzero(estimate + sigmas * error[None, :] + 1e-5 >= threshold)
    sure = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 18):
        at = slice(lo, lo + (1 << 18))
        sure[at] = np.einsum("nd,nd->n", a[i[at]], b[j[at]]) >= threshold
    return i[sure], j[sure]


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Compare the blocks of each job of a partition sorted by job: ``(first, n, root)`` rows."""
    keys = ["label", "dim", "band", "key", "ba", "bb"]
    for t in complete_groups(batches, keys, 1 << 13):
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        cuts = np.flatnonzero(new).tolist()
        side, first, count = (t.column(c).to_numpy() for c in ("side", "first", "n"))
        band = t.column("band").to_numpy()
        for lo, hi in zip(cuts, [*cuts[1:], t.num_rows]):
            if hi - lo < 2:
                continue
            dim = int(cols[1][lo])
            part = t.slice(lo, hi - lo).combine_chunks()
            x = np.concatenate([c.flatten().to_numpy() for c in part.column("vec").chunks]).reshape(-1, dim).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            all_keys = np.concatenate([c.flatten().to_numpy() for c in part.column("keys").chunks]).reshape(hi - lo, -1)
            s, own = side[lo:hi], cols[4][lo] == cols[5][lo]
            at_a = np.arange(hi - lo) if own else np.flatnonzero(s == 0)
            at_b = at_a if own else np.flatnonzero(s == 1)
            if not len(at_a) or not len(at_b):
                continue
            i, j = compare_blocks(x[at_a], x[at_b], threshold)
            i, j = at_a[i], at_b[j]
            ok = i < j if own else np.ones(len(i), bool)
            if band[lo]:  # met in an earlier band: counted there
                ok &= ~(all_keys[i][:, :band[lo]] == all_keys[j][:, :band[lo]]).any(axis=1)
            i, j = i[ok], j[ok]
            if len(i):
                f, c = first[lo:hi], count[lo:hi]
                add = np.zeros(hi - lo, np.int64)
                np.add.at(add, i, c[j])
                np.add.at(add, j, c[i])
                hit = np.flatnonzero(add)
                node, root = spanning(f[i], f[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[hit], node])), pa.array(np.concatenate([add[hit], np.zeros(len(node), np.int64)])),
                     pa.array(np.concatenate([f[hit], root]))], names=["first", "n", "root"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.98, bits: int = 12, block: int = 512) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Rows with a null label, and vectors that are null, empty, zero or hold a null or non-finite
    component, link with nothing; so do vectors of different length.  Repeated rows are vectors
    of their own and link with each other; different vectors that share an id are one node, whose
    rows all report its links together.  Ids are whole numbers; rows with a null id have no
    place in a component: they link with nothing.
    """
    spark = vectors.sparkSession
    d = pick(vectors, vec_id=id_col, vec=vector_col, label=label_col)
    single = d.schema["vec"].dataType == T.ArrayType(T.FloatType(), d.schema["vec"].dataType.containsNull)
    if not single:  # single precision travels as it is and is widened where it is compared
        d = d.withColumn("vec", F.col("vec").cast("array<double>"))
    limit = float(np.finfo(np.float64).max)
    usable = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vec") > 0)
              & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= limit)) & F.exists("vec", lambda v: v != 0))
    good = d.where(usable)
    if not single:  # scaled by the largest component, so that no square overflows or vanishes
        top = F.array_max(F.transform("vec", lambda v: F.abs(v)))
        good = (good.withColumn("top", top)
                .withColumn("vec", F.when((F.col("top") > 1e100) | (F.col("top") < 1e-100),
                                          F.expr("transform(vec, v -> v / top)")).otherwise(F.col("vec"))).drop("top"))
    groups = materialize(good.groupBy(F.xxhash64("label").alias("label"), F.col("label").cast("string").alias("name"), "vec")
                         .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")), "vectors")
    bands = bands_needed(bits, threshold)
    coded = _banded(groups.select("label", "vec", F.col("first").cast("long").alias("first"), "n"), bits, bands)
    coded = coded.withColumn("vid", F.xxhash64("vec"))
    one, group = ["label", "first", "vid", "dim"], ["label", "dim", "band", "key"]
    keyed = coded.select(*one, F.posexplode("keys").alias("band", "key"))
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    places = keyed.join(sizes, group).groupBy(*one).agg(F.collect_set(F.struct("band", "key", "size")).alias("places"))
    met = (coded.join(places, one).withColumn("place", F.explode("places")).select("*", "place.*").drop("places", "place")
           .where(F.get("keys", F.col("band")) == F.col("key")))  # holds always, but for vectors that share id and hash
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    met = (met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("label", "dim", "band", "key", F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"),
                   F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "first", "n", "vec", "keys"))
    job = ["label", "dim", "band", "key", "ba", "bb"]
    links = (met.repartition(partitions(spark), *job).sortWithinPartitions(*job)
             .mapInArrow(lambda it: _links(it, threshold), "first long, n long, root long"))
    links = materialize(links, "links")
    degree = links.groupBy("first").agg(F.sum("n").alias("linked"))
    comp = connected_components(links.where("first <> root"), "first", "root")
    result = (groups.select("label", "name", "vec", F.col("first").cast("long").alias("first"), "n")
              .join(degree, "first", "left").join(comp, F.col("first") == F.col("node"), "left")
              .select("label", "name", "vec", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("root", "first").alias("component_id")))
    marked = good.select("vec_id", F.xxhash64("label").alias("label"), F.col("label").cast("string").alias("name"), "vec")
    linked = marked.join(result, ["label", "name", "vec"]).select("vec_id", "n_links", "component_id")
    alone = d.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                              F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
