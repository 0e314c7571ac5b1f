"""Substring deduplication over super-k-mers.

A window is ``window`` consecutive words.  Its minimiser is the smallest hash of the
word ``gram``-grams inside it; consecutive windows that share it form a super-k-mer,
which travels as one packed string to the bucket of that minimiser.  Equal windows have
equal minimisers, so each bucket can sort its windows and count them by themselves.

What need not travel stays: texts that occur several times are reduced to the one with the
smallest id first, and a bucket that only one of these documents fills holds nothing
repeated within another document.

A bucket that more than ``hot`` documents fill is split further: its windows are
counted one by one under a 128-bit cryptographic digest of their words, added up before
the shuffle; the smallest document of each window learns that it owns it, and all its other
documents lose it.  So no key, however common, gathers in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, binary, complete_groups, materialize, partitions, pick, rolling, slices

WINDOW = 50
GRAM = 10
HOT = 2000
#: Super-k-mers of one minimiser value (repetitive text) are cut after so many windows.
LONGEST = 256


def window_minimisers(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Smallest ``gram``-gram hash of every window of ``window`` word hashes (as signed longs)."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    low = rolling(h, gram).view(np.int64)
    need, have = window - gram + 1, 1
    while have < need:  # sliding minimum by doubling
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def super_kmers(minis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 window of each super-k-mer."""
    if not len(minis):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], minis[1:] != minis[:-1])))
    ends = np.concatenate((starts[1:], [len(minis)]))
    if (ends - starts).max() > LONGEST:
        cuts = [np.arange(a, b, LONGEST) for a, b in zip(starts, ends)]
        starts = np.concatenate(cuts)
        ends = np.concatenate((starts[1:], [len(minis)]))
    return starts, ends


def _minimiser_rows(d: DataFrame, window: int, gram: int) -> DataFrame:
    """``(key, doc_id, mini)``: the distinct minimisers of every document with at least a window."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", d.schema["doc_id"].dataType),
                           T.StructField("mini", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for b in slices(batches, "text", 4 << 20):
            rows, minis = [], []
            for i, text in enumerate(binary(b.column("text")).to_pylist()):
                m = np.unique(window_minimisers(hashed(text.split()), window, gram))
                rows.append(np.full(len(m), i))
                minis.append(m)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("doc_id").take(at),
                                              pa.array(np.concatenate(minis))], names=["key", "doc_id", "mini"])

    return d.select("key", "doc_id", "text").mapInArrow(run, schema)


def _packed_rows(chosen: DataFrame, window: int, gram: int) -> DataFrame:
    """Super-k-mers of the minimisers ``minis`` as ``(mini, doc_id, key, start, packed)``."""
    schema = T.StructType([T.StructField("mini", T.LongType()), T.StructField("doc_id", chosen.schema["doc_id"].dataType),
                           T.StructField("key", T.BinaryType()), T.StructField("start", T.IntegerType()),
                           T.StructField("packed", T.BinaryType())])

    def run(batches):
        hashed = WordHash()
        for b in slices(batches, "text", 2 << 20):
            rows, minis, first, packed = [], [], [], []
            for i, (text, want) in enumerate(zip(binary(b.column("text")).to_pylist(), b.column("minis"))):
                words = text.split()
                m = window_minimisers(hashed(words), window, gram)
                starts, ends = super_kmers(m)
                use = np.isin(m[starts], want.values.to_numpy())
                for s, e in zip(starts[use].tolist(), ends[use].tolist()):
                    rows.append(i)
                    minis.append(m[s])
                    first.append(s)
                    packed.append(b" ".join(words[s:e - 1 + window]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(minis, pa.int64()), b.column("doc_id").take(at), b.column("key").take(at),
                 pa.array(first, pa.int32()), pa.array(packed, pa.binary())], names=schema.names)

    return chosen.select("key", "doc_id", "text", "minis").mapInArrow(run, schema)


def _sorted_bucket(rows: list[tuple[int, bytes]], window: int) -> list[tuple[int, int]]:
    """``(row, window)`` of the windows of a bucket that also stand in a row with a smaller id.

    ``rows`` holds ``(doc_id, packed)``; the windows are sorted, with the smallest id first among equals.
    """
    same: dict[bytes, list[int]] = {}
    for i, (_, p) in enumerate(rows):
        same.setdefault(p, []).append(i)
    each = []
    for p, at in same.items():  # equal strings hold equal windows: one stands for all
        low = min(rows[i][0] for i in at)
        ends = [j for j, c in enumerate(p) if c == 32] + [len(p)]
        starts = [0, *[e + 1 for e in ends[:-1]]]
        each += [(p[starts[w]:ends[w + window - 1]], low, at, w) for w in range(len(ends) - window + 1)]
    each.sort(key=lambda x: (x[0], x[1]))
    out, last, low = [], None, None
    for text, doc, at, w in each:
        if text != last:
            last, low = text, doc
        out += [(i, w) for i in at if rows[i][0] > low]
    return out


def _bucket_hits(packed: DataFrame, window: int) -> DataFrame:
    """``(key, hits)``: windows of each super-k-mer that a smaller document holds, as positions in the document."""
    def run(batches):
        for t in complete_groups(batches, ["mini"], 1 << 14):
            mini = t.column("mini").to_numpy()
            doc, key, start, text = (t.column(c).to_pylist() for c in ("doc_id", "key", "start", "packed"))
            cuts = np.flatnonzero(np.concatenate(([True], mini[1:] != mini[:-1]))).tolist()
            keys, hits = [], []
            for lo, hi in zip(cuts, [*cuts[1:], len(mini)]):
                if hi - lo < 2:
                    continue
                by: dict[int, list[int]] = {}
                for i, w in _sorted_bucket(list(zip(doc[lo:hi], text[lo:hi])), window):
                    by.setdefault(i, []).append(start[lo + i] + w)
                for i, at in by.items():
                    keys.append(key[lo + i])
                    hits.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hits, pa.list_(pa.int32()))],
                                             names=["key", "hits"])

    n = partitions(packed.sparkSession)
    return (packed.repartition(n, "mini").sortWithinPartitions("mini")
            .mapInArrow(run, "key binary, hits array<int>"))


def _digests(words: list[bytes], at: list[int], window: int) -> list[bytes]:
    return [hashlib.blake2b(b" ".join(words[i:i + window]), digest_size=16).digest() for i in at]


def _hot_windows(chosen: DataFrame, window: int, gram: int) -> DataFrame:
    """``(digest, doc_id)``: the distinct windows of hot minimisers of each document."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("doc_id", chosen.schema["doc_id"].dataType)])

    def run(batches):
        hashed = WordHash()
        for b in slices(batches, "text", 1 << 20):
            rows, out = [], []
            for i, (text, want) in enumerate(zip(binary(b.column("text")).to_pylist(), b.column("hot"))):
                words = text.split()
                m = window_minimisers(hashed(words), window, gram)
                found = set(_digests(words, np.flatnonzero(np.isin(m, want.values.to_numpy())).tolist(), window))
                rows += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column("doc_id").take(pa.array(rows, pa.int64()))],
                                             names=schema.names)

    return chosen.select("doc_id", "text", "hot").mapInArrow(run, schema)


def _kept(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Remove the words of all hit windows and digest the rest."""
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        hashed = WordHash()
        for b in slices(batches, "text", 4 << 20):
            out = []
            for text, copy, hits, hot, owned in zip(binary(b.column("text")).to_pylist(), b.column("copy").to_pylist(),
                                                    b.column("hits"), b.column("hot"), b.column("owned").to_pylist()):
                words = (text or b"").split()
                n = len(words)
                gone = np.zeros(n + 1, np.int64)
                at = []
                if copy and n >= window:
                    at.append(np.arange(n - window + 1))
                if hits.is_valid:
                    at.append(hits.values.to_numpy().astype(np.int64))
                if hot.is_valid and len(hot.values):
                    m = window_minimisers(hashed(words), window, gram)
                    cand = np.flatnonzero(np.isin(m, hot.values.to_numpy())).tolist()
                    mine = set(owned or ())
                    at.append(np.array([i for i, x in zip(cand, _digests(words, cand, window)) if x not in mine], np.int64))
                if at and n >= window:
                    at = np.concatenate(at)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                lost = np.cumsum(gone[:n]) > 0
                kept = b" ".join(w for w, x in zip(words, lost.tolist()) if not x)
                out.append((n, int(lost.sum()), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.string())], names=schema.names)

    return rows.select("doc_id", "text", "copy", "hits", "hot", "owned").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row per input row.

    A word goes if some window over it also starts in a document with a smaller id.  A
    null text has no words.  Repeated rows are one document.  A row with a null id is
    compared with nothing: it has no place in the order of ids, so it loses nothing and
    takes nothing from others.
    """
    d = pick(docs, doc_id=id_col, text=text_col).withColumn(
        "key", F.expr("substring(unhex(sha2(cast(text as binary), 256)), 1, 16)"))
    long_enough = d.where((F.length("text") >= 2 * window - 1) & F.col("doc_id").isNotNull())
    rows = materialize(_minimiser_rows(long_enough, window, gram), "minis")
    once = rows.groupBy("key", "mini").agg(F.min("doc_id").alias("doc_id"))
    shared = (once.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
              .where("lo < hi").select("mini", (F.col("n") > hot).alias("is_hot")))
    want = once.join(shared, "mini").groupBy("key", "doc_id").agg(
        F.collect_list(F.when(~F.col("is_hot"), F.col("mini"))).alias("minis"),
        F.collect_list(F.when(F.col("is_hot"), F.col("mini"))).alias("hot"))
    want = materialize(want, "wanted")  # one row per text with shared minimisers
    texts = d.select("key", "doc_id", "text")
    of = ["key", "doc_id"]
    hits = (_bucket_hits(_packed_rows(texts.join(want.where(F.size("minis") > 0), of), window, gram), window)
            .groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits")))
    owners = (_hot_windows(texts.join(want.where(F.size("hot") > 0), of), window, gram)
              .groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
              .groupBy("doc_id").agg(F.collect_list("digest").alias("owned")))
    firsts = want.select("key", "doc_id", "hot").join(hits, "key", "left").join(owners, "doc_id", "left").select(
        "key", "doc_id", F.lit(False).alias("copy"), "hits", "hot", "owned")
    ids = rows.select("key", "doc_id").distinct()
    low = ids.groupBy("key").agg(F.min("doc_id").alias("low"))
    copies = ids.join(low, "key").where("doc_id > low").select(
        "key", "doc_id", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("hits"),
        F.lit(None).cast("array<bigint>").alias("hot"), F.lit(None).cast("array<binary>").alias("owned"))
    marks = firsts.unionByName(copies)
    return _kept(texts.join(marks, of, "left"), window, gram)
