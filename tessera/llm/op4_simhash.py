"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints become keys of a binary trie.  Two trie nodes are traversed
together, bit by bit; differing bits are added up, and a pair of nodes is dropped
as soon as its Hamming error budget is exceeded.

To spread the work, four bit orders are joined, each with a stricter budget for
its leading quarter and half.  For at most 4 differing bits, one order always
keeps within its budgets (pigeonhole on the errors of the four 16-bit quarters):

    order (q0 q1 | q2 q3): at most 1 error in q0 and 2 in q0 q1
    order (q1 q0 | q2 q3): none in q1 and 2 in q1 q0
    order (q2 q3 | q0 q1): none in q2 and 1 in q2 q3
    order (q3 q2 | q0 q1): none in q3 and 1 in q3 q2

So the top 16 levels are joined by Spark on equal prefixes (first order: or
prefixes one bit apart), and each node pair is finished in a task.  A node pair
with more fingerprints than ``max_job`` is taken down four more levels by Spark
before, as often as needed, so that no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, complete_groups, cumulative_bounds, materialize, partitions, pick, slices
from .components import connected_components

#: Quarter order, errors allowed in the first 16 and in the first 32 bits; for a budget of 4 bits.
ORDERS = (((0, 1, 2, 3), 1, 2), ((1, 0, 2, 3), 0, 2), ((2, 3, 0, 1), 0, 1), ((3, 2, 0, 1), 0, 1))
MAX_BITS = 4


def text_fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of lower-cased (A-Z) word shingles, repeats included; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 65536):  # very long texts in pieces
        part = h[lo:lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long, one row per input row."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            fp = np.array([text_fingerprint(t, shingle) for t in binary(b.column("text")).to_pylist()],
                          dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _quarter(c: Column, i: int) -> Column:
    """Quarter i (0 leads) of a 64-bit fingerprint."""
    return F.shiftrightunsigned(c, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _rotated(c: Column, order: tuple[int, ...]) -> Column:
    q = [_quarter(c, i) for i in order]
    return (F.shiftleft(q[0], 48).bitwiseOR(F.shiftleft(q[1], 32)).bitwiseOR(F.shiftleft(q[2], 16)).bitwiseOR(q[3]))


def _limit(r: Column, depth: int) -> Column:
    """Errors that order ``r`` allows in the first ``depth`` bits."""
    out = F.lit(MAX_BITS)
    if depth <= 32:
        k = 1 if depth <= 16 else 2
        for i, o in enumerate(ORDERS):
            out = F.when(r == i, F.lit(o[k])).otherwise(out)
    return out


def _first_jobs(fps: DataFrame) -> DataFrame:
    """Node pairs at depth 16: ``(r, depth, pa, pb, fp)``, ``pa <= pb``."""
    parts = []
    for r, (order, first, _) in enumerate(ORDERS):
        p = _quarter(F.col("fp"), order[0])
        masks = [0] + ([1 << i for i in range(16)] if first else [])
        rows = fps.select("fp", p.alias("p"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
        parts.append(rows.select(F.lit(r).alias("r"), F.lit(16).alias("depth"),
                                 F.least("p", F.col("p").bitwiseXOR(F.col("m"))).alias("pa"),
                                 F.greatest("p", F.col("p").bitwiseXOR(F.col("m"))).alias("pb"), "fp"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _descend(rows: DataFrame, depth: int, step: int = 4) -> DataFrame:
    """Replace node pairs at ``depth`` by the pairs of their descendants ``step`` bits below."""
    key = F.lit(None).cast("long")
    for r, (order, _, _) in enumerate(ORDERS):
        key = F.when(F.col("r") == r, _rotated(F.col("fp"), order)).otherwise(key)
    low = F.lit((1 << step) - 1).cast("long")
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << step)])
    x = (rows.withColumn("_own", F.shiftrightunsigned(key, 64 - depth))
         .withColumn("_next", F.shiftrightunsigned(key, 64 - depth - step).bitwiseAND(low))
         .withColumn("_other", F.when(F.col("_own") == F.col("pa"), F.col("pb")).otherwise(F.col("pa")))
         .withColumn("_m", F.explode(masks))
         .where(F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) + F.bit_count("_m") <= _limit(F.col("r"), depth + step)))
    mine = F.shiftleft(F.col("_own"), step).bitwiseOR(F.col("_next"))
    other = F.shiftleft(F.col("_other"), step).bitwiseOR(F.col("_next").bitwiseXOR(F.col("_m")))
    # from depth 64 on prefixes use the sign bit: any fixed order of the two ends will do
    return x.select("r", F.lit(depth + step).alias("depth"), F.least(mine, other).alias("pa"),
                    F.greatest(mine, other).alias("pb"), "fp")


def _rotate_np(fp: np.ndarray, r: np.ndarray) -> np.ndarray:
    q = [(fp >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF) for i in range(4)]
    out = np.zeros_like(fp)
    for i, (order, _, _) in enumerate(ORDERS):
        key = (q[order[0]] << np.uint64(48)) | (q[order[1]] << np.uint64(32)) | (q[order[2]] << np.uint64(16)) | q[order[3]]
        out = np.where(r == i, key, out)
    return out


def trie_links(key: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray,
               half_budget: np.ndarray, depth: int = 16, budget: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Traverse node pairs ``key[a0:a1]``, ``key[b0:b1]`` of sorted uint64 keys together.

    A pair with ``a0 == b0`` is a node with itself.  Returns index pairs of keys
    within ``budget`` differing bits (and ``half_budget`` in the first 32).
    """
    found_a, found_b = [], []
    top = np.uint64(64 - depth)
    diff = np.bitwise_count((key[a0] ^ key[b0]) >> top).astype(np.int64) if depth else np.zeros(len(a0), np.int64)
    for d in range(depth, 65):
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():  # two leaves: the remaining bits at once
            i, j, hb = a0[single], b0[single], half_budget[single]
            x = key[i] ^ key[j]
            ok = (i != j) & (np.bitwise_count(x) <= budget) & (np.bitwise_count(x >> np.uint64(32)) <= hb)
            found_a.append(i[ok])
            found_b.append(j[ok])
            keep = ~single
            a0, a1, b0, b1, diff, half_budget = (v[keep] for v in (a0, a1, b0, b1, diff, half_budget))
        if not len(a0) or d == 64:
            break
        ones = np.concatenate(([0], np.cumsum((key >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        n = [a0, am, a0, am], [am, a1, am, a1], [b0, bm, bm, b0], [bm, b1, b1, bm]
        add = (0, 0, 1, 1)
        na0, na1, nb0, nb1, nd, nh = [], [], [], [], [], []
        for k in range(4):
            c0, c1, e0, e1 = (n[m][k] for m in range(4))
            lim = np.where(d + 1 <= 32, half_budget, budget)
            ok = (c1 > c0) & (e1 > e0) & (diff + add[k] <= lim)
            if k < 2:
                ok &= ~own | (c1 - c0 > 1)
            elif k == 3:
                ok &= ~own
            for out, v in ((na0, c0), (na1, c1), (nb0, e0), (nb1, e1), (nd, diff + add[k]), (nh, half_budget)):
                out.append(v[ok])
        a0, a1, b0, b1, diff, half_budget = (np.concatenate(v) for v in (na0, na1, nb0, nb1, nd, nh))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_a) if found_a else empty), (np.concatenate(found_b) if found_b else empty)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(node, smallest node reachable)`` that join the same nodes as the given links."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = idx[:len(a)], idx[len(a):]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, old[i], low)
        np.minimum.at(label, old[j], low)
        label = label[label]
        if np.array_equal(old, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _job_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish the node pairs of a partition that is sorted by them."""
    for t in complete_groups(batches, ["r", "depth", "pa", "pb"], 1 << 17):
        r, depth, p, q = (t.column(c).to_numpy().astype(np.int64) for c in ("r", "depth", "pa", "pb"))
        fp = t.column("fp").to_numpy().view(np.uint64)
        key = _rotate_np(fp, r)
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (depth[1:] != depth[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        job = np.cumsum(new) - 1
        prefix = np.where(depth == 64, key, key >> (np.uint64(64) - np.minimum(depth, 63).astype(np.uint64)))
        side = (prefix.view(np.int64) != p).astype(np.int8)
        at = np.lexsort((key, side, job))
        job, side, key, fp, r = job[at], side[at], key[at], fp[at], r[at]
        starts = np.flatnonzero(np.concatenate(([True], job[1:] != job[:-1])))
        ends = np.concatenate((starts[1:], [len(job)]))
        mids = ends - np.add.reduceat(side.astype(np.int64), starts)
        own = (p == q)[at][starts]
        useful = np.where(own, ends - starts > 1, (mids > starts) & (mids < ends))
        a0, a1 = starts[useful], np.where(own, ends, mids)[useful]
        b0, b1 = np.where(own, starts, mids)[useful], ends[useful]
        half = np.array([o[2] for o in ORDERS])[r[a0]] if len(a0) else np.zeros(0, np.int64)
        for lo, hi in cumulative_bounds((a1 - a0) * (b1 - b0), 1 << 21) if len(a0) else []:
            i, j = trie_links(key, a0[lo:hi], a1[lo:hi], b0[lo:hi], b1[lo:hi], half[lo:hi])
            if len(i):
                x, y = spanning(fp[i].view(np.int64), fp[j].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def hamming_links(fps: DataFrame, max_job: int = 1024) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that join all those at 4 or fewer bits.

    ``fps`` holds distinct long values ``fp``.  Within a task links are thinned to a
    spanning forest, so a dense group gives no more rows than it has members.
    """
    spark = fps.sparkSession
    jobs = materialize(_first_jobs(fps), "trie")
    ready: list[DataFrame] = []
    job = ["r", "depth", "pa", "pb"]
    for depth in range(16, 64, 4):
        large = jobs.groupBy(*job).count().where(F.col("count") > max_job).drop("count")
        large = materialize(large, "large")
        if large.isEmpty():
            break
        ready.append(jobs.join(large, job, "left_anti"))
        jobs = materialize(_descend(jobs.join(large, job, "left_semi"), depth), "trie")
    for x in ready:
        jobs = jobs.unionByName(x)
    n = partitions(spark)
    return (jobs.repartition(n, *job).sortWithinPartitions(*job)
            .mapInArrow(_job_links, "a long, b long"))


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                      max_job: int = 1024) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Texts that are null or have no word get fingerprint zero and are linked like
    any other.  Repeated rows share their fingerprint and component.  A null id is
    carried along but never names a component unless all ids in it are null.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    f = materialize(fingerprints(d, shingle), "fp")
    first = f.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = hamming_links(f.select("fp").distinct(), max_job)
    comp = connected_components(links, "a", "b")
    named = first.join(comp, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(low, "root", "left").select("fp", "component_id")
    return (f.join(by_fp, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
