"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least ``threshold`` of its distinct word
5-gram shingles occur there, wherever they stand.

1. Documents are reduced to the shingles that occur in some item (a join with the
   items' shingles), so that a short item and the reduced long document are of
   comparable size; containment does not change by that.
2. Reduced documents are partitioned by size (powers of two).  Containment t of an
   item of q shingles in a document of at most u means a Jaccard similarity of at
   least t q / (u + q - t q), from which each pair of size classes gets its band
   width.  A class whose documents are too small to hold t q shingles is skipped.
   Where no band width reaches the wanted recall, the class is searched by shared
   shingles directly, so no class is lost.
3. Candidates are verified by exact containment of the word shingles in the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, binary, fits, materialize, mix, pick, plain_words, rolling, slices

HASHES = 128
WIDTHS = (4, 3, 2, 1)
RECALL = 0.9999
#: Rows of a side that may be broadcast: two longs each, 64 MB at most in a task.
BROADCAST_ROWS = 1 << 21


def shingles(words: list[bytes], k: int) -> list[tuple[bytes, ...]]:
    """Word k-grams; a shorter text has one, its whole sequence; no words: none."""
    if not words:
        return []
    return [tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]


def gram_rows(df: DataFrame, key: str, k: int) -> DataFrame:
    """``(key, h)``: the hash of every word shingle of every whole text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("h", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for b in slices(batches, "text", 2 << 20):
            parts, owner = [], []
            for i, text in enumerate(binary(b.column("text")).to_pylist()):
                h = hashed(plain_words(text))
                if len(h):
                    # a short text's only shingle must not equal a part of a longer one: its length is hashed in
                    g = rolling(h, k) if len(h) >= k else rolling(h, len(h)) ^ np.uint64(len(h))
                    parts.append(g)
                    owner.append(np.full(len(g), i))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(parts).view(np.int64))],
                    names=[key, "h"])

    return df.select(key, "text").mapInArrow(run, schema)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, HASHES, dtype=np.uint64))


def signature(h: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes."""
    a, b = _seeds()
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 4096):
        out = np.minimum(out, mix(h[lo:lo + 4096, None] * a[None, :] + b[None, :]).min(axis=0))
    return out


def _band_keys(sig: np.ndarray, width: int) -> np.ndarray:
    n = HASHES // width
    part = sig[:n * width].reshape(n, width)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
    return mix(out ^ (np.arange(n, dtype=np.uint64) * np.uint64(1000003) + np.uint64(width)))


def band_rows(sets: DataFrame, key: str) -> DataFrame:
    """``(key, size_class, band)`` of sets ``(key, hs, plan)``; ``plan`` holds size class * 8 + band width."""
    schema = T.StructType([T.StructField(key, sets.schema[key].dataType), T.StructField("size_class", T.IntegerType()),
                           T.StructField("band", T.LongType())])

    def run(batches):
        for b in batches:
            rows, cls, band = [], [], []
            for i, (hs, plan) in enumerate(zip(b.column("hs").to_pylist(), b.column("plan").to_pylist())):
                sig = signature(np.array(hs, np.int64).view(np.uint64))
                keys = {}
                for p in plan:
                    w = p % 8
                    if w not in keys:
                        keys[w] = _band_keys(sig, w).view(np.int64)
                    rows.append(np.full(len(keys[w]), i))
                    cls.append(np.full(len(keys[w]), p // 8, np.int32))
                    band.append(keys[w])
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(cls)),
                     pa.array(np.concatenate(band))], names=[key, "size_class", "band"])

    return sets.select(key, "hs", "plan").mapInArrow(run, schema)


def band_width(q: int, u: int, t: float) -> int:
    """Widest bands that find Jaccard similarity t q / (u + q - t q) with the wanted recall; 0: none does."""
    s = t * q / (u + q - t * q)
    for w in WIDTHS:
        if 1 - (1 - s ** w) ** (HASHES // w) >= RECALL:
            return w
    return 0


def _classes(sets: DataFrame) -> DataFrame:
    return sets.withColumn("size_class", F.floor(F.log2("n")).cast("int"))


def benchmark_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5,
                    threshold: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)``, one row per document and item found in it.

    Words are lower-cased runs of letters, digits and non-ASCII characters.  Null and
    empty texts match nothing.  A text of fewer than five words has one shingle, its
    whole sequence, so a short item is only found as a whole short document.  Rows that
    share an id are one document; repeated rows and repeated items give one result row.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col)
    it = (pick(items, item_id=item_id_col, text=item_text_col).where("text is not null").distinct()
          .withColumn("item", F.md5(F.col("text").cast("binary"))))
    texts = it.select("item", "text").distinct()
    grams = materialize(gram_rows(texts, "item", shingle).distinct(), "items")
    known = grams.select("h").distinct()
    hint = lambda x: F.broadcast(x) if fits(x, BROADCAST_ROWS) else x
    hits = gram_rows(d, "doc_id", shingle).join(hint(known), "h").select("doc_id", "h").distinct()
    sets = materialize(_classes(hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("h").alias("hs"))),
                       "docsets")
    isets = materialize(_classes(grams.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.collect_list("h").alias("hs"))),
                        "itemsets")
    # size classes are powers of two: at most 64 rows a side
    doc_classes = sorted(r[0] for r in sets.select("size_class").distinct().collect())
    item_classes = {r[0]: (r[1], r[2]) for r in isets.groupBy("size_class").agg(F.min("n"), F.max("n")).collect()}
    plans = {}  # (document class, item class) -> band width
    for c in doc_classes:
        for i, (low, _) in item_classes.items():
            u = 2 ** (c + 1) - 1
            if u >= threshold * low:
                plans[c, i] = band_width(low, u, threshold)
    banded = {k: w for k, w in plans.items() if w}
    found = None

    def plan_col(of: dict[int, list[int]]):
        out = F.array().cast("array<int>")
        for cls, codes in of.items():
            out = F.when(F.col("size_class") == cls, F.array(*[F.lit(x) for x in codes])).otherwise(out)
        return out

    if banded:
        by_doc: dict[int, list[int]] = {}
        by_item: dict[int, list[int]] = {}
        for (c, i), w in banded.items():
            by_doc.setdefault(c, [])
            by_doc[c] += [c * 8 + w] if c * 8 + w not in by_doc[c] else []
            by_item.setdefault(i, []).append(c * 8 + w)
        left = band_rows(sets.withColumn("plan", plan_col(by_doc)).where(F.size("plan") > 0), "doc_id")
        right = materialize(band_rows(isets.withColumn("plan", plan_col(by_item)).where(F.size("plan") > 0), "item"), "bands")
        found = left.join(hint(right), ["size_class", "band"]).select("doc_id", "item")
    rest = [k for k, w in plans.items() if not w]
    if rest:  # by shared shingles
        some = None
        for c, i in rest:
            hit = (F.col("dc") == c) & (F.col("ic") == i)
            some = hit if some is None else some | hit
        a = sets.where(F.col("size_class").isin(sorted({c for c, _ in rest}))).select(
            "doc_id", F.col("size_class").alias("dc"), F.explode("hs").alias("h"))
        b = isets.where(F.col("size_class").isin(sorted({i for _, i in rest}))).select(
            "item", F.col("size_class").alias("ic"), F.explode("hs").alias("h"))
        direct = a.join(hint(b), "h").where(some).select("doc_id", "item")
        found = direct if found is None else found.unionByName(direct)
    out = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item string, n_shared int, n_item int"
    if found is None:
        sure = spark.createDataFrame([], out)
    else:
        pairs = (found.distinct()
                 .join(sets.select(F.col("doc_id").alias("_d"), F.col("hs").alias("_x")), F.col("doc_id").eqNullSafe(F.col("_d")))
                 .join(isets.select("item", F.col("hs").alias("_q")), "item")
                 .where(F.size(F.array_intersect("_x", "_q")) >= F.lit(threshold) * F.size("_q") - 1e-9)
                 .select("doc_id", "item"))
        pairs = materialize(pairs.join(texts.withColumnRenamed("text", "item_text"), "item"), "pairs")
        sure = verified(d, pairs, shingle, threshold, out)
    return (sure.join(it.select("item", "item_id").distinct(), "item")
            .select("doc_id", "item_id", F.col("n_shared").cast("long").alias("n_shared"),
                    F.col("n_item").cast("long").alias("n_item"),
                    F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment")).distinct())


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, threshold: float, schema: str) -> DataFrame:
    """Exact containment of the word shingles of ``(doc_id, item, item_text)`` in the whole texts."""
    per = pairs.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct("item", "item_text")).alias("its"))

    def run(batches):
        known: dict[str, set] = {}
        for b in slices(batches, "text", 8 << 20):
            out = []
            for doc, text, its in zip(b.column("doc_id").to_pylist(), binary(b.column("text")).to_pylist(),
                                      b.column("its").to_pylist()):
                have = set(shingles(plain_words(text), shingle))
                for x in its:
                    if x["item"] not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[x["item"]] = set(shingles(plain_words(x["item_text"].encode()), shingle))
                    want = known[x["item"]]
                    n = len(want & have)
                    if n >= threshold * len(want) - 1e-9:
                        out.append((doc, x["item"], n, len(want)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_id").type), pa.array(cols[1]),
                                                  pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                                                 names=["doc_id", "item", "n_shared", "n_item"])

    return (docs.where("text is not null").join(per, F.col("doc_id").eqNullSafe(F.col("_d")))
            .select("doc_id", "text", "its").mapInArrow(run, schema).distinct())
