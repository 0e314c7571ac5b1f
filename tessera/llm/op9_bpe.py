"""Byte-level BPE over the distinct words of the whole corpus.

1. Every text is cut into pre-tokens, once.  Documents are taken in blocks of
   ``block_bytes`` of text; a block lists its distinct pre-tokens once, ordered by
   frequency, and keeps its texts as a position stream of indices into that list.
   Word lists and streams leave in one shuffle: a word under itself, a stream under its block's name.
2. Each distinct word is encoded once, and its ids
   are decoded through a join with the token-byte table (a vocabulary file, so its
   size is fixed and it is broadcast).
3. Ids and bytes are joined back to the words of each block, and a block puts
   them in order by position.

A frequent word is one row a block, however often it occurs, so no key is hot.
Only one block at a time is held in a task.

Words and streams come from the same shuffle, so the input is read and cut once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_from, complete_groups, partitions, pick, slices

BLOCK_BYTES = 40 << 20

# Characters that ``re`` and the Unicode classes of the pattern see differently: numbers that are no
# decimal digits, and the controls 28 to 31. Parts that hold one are cut by ``regex`` instead.
_ODD = frozenset("\x1c\x1d\x1e\x1f").union(
    c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isdecimal() or unicodedata.category(c) in ("Nl", "No"))
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
_EXACT = regex.compile(public_tokenizers.PATTERN)
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Block:
    """Documents whose position streams share one word list.

    A space before a non-space always starts a pre-token, so a text can be cut at
    such spaces first; the parts recur, and each distinct part is matched once.
    """

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.part_words: list[list[int]] = []
        self.docs: list[np.ndarray] = []
        self.rows: list = []
        self.kind: pa.DataType | None = None  # of the ids
        self.bytes = 0

    def _new(self, part: str) -> int:
        w = self.words
        found = (_FAST if _ODD.isdisjoint(part) else _EXACT).findall(part)
        self.part_words.append([w.setdefault(x, len(w)) for x in found])
        return len(self.part_words) - 1

    def _ids(self, text: str) -> list[int]:
        """Numbers of a text's parts."""
        if not text:
            return []
        if _LOOSE_SPACE.search(text):
            return [self._new(text)]
        head, *rest = text.split(" ")
        parts = self.parts
        seq = list(map(parts.get, rest))
        if None in seq:
            for i, k in enumerate(seq):
                if k is None:
                    x = rest[i]
                    k = parts.get(x)
                    seq[i] = parts[x] = self._new(" " + x) if k is None else k
        if head:
            k = self.heads.get(head)
            if k is None:
                k = self.heads[head] = self._new(head)
            seq.insert(0, k)
        return seq

    def add(self, row, text: str | None) -> None:
        self.docs.append(np.array(self._ids(text or ""), dtype=np.int32))
        self.rows.append(row)
        self.bytes += len(text or "")

    def listed(self) -> tuple[list[str], np.ndarray]:
        """Words in alphabetical order, and the place of each by number."""
        words = sorted(self.words)
        place = np.empty(len(words), np.int64)
        place[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        return words, place

    def streams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words by falling frequency, the text as indices into that, and where documents end in it."""
        _, place = self.listed()
        sizes = np.array([len(x) for x in self.part_words], np.int64)
        words = np.fromiter((i for x in self.part_words for i in x), np.int32, int(sizes.sum()))
        at = np.cumsum(sizes) - sizes
        flat, ends = [], []
        for seq in self.docs:  # document by document: no more than one text's indices at a time
            x = words[_ragged(at[seq], sizes[seq])]
            flat.append(x)
            ends.append(len(x))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        by = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
        rank = np.empty(len(place), np.int32)
        rank[by] = np.arange(len(place), dtype=np.int32)
        return place[by], rank[flat], np.cumsum(ends, dtype=np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, Block]]:
    ctx = TaskContext.get()
    base = (ctx.partitionId() if ctx else 0) << 24
    block, k = Block(), 0
    for b in slices(batches, "text", block_bytes):
        block.kind = kind = b.schema.field("doc_id").type
        for row, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if block.rows and block.bytes + len(text or "") > block_bytes:
                yield base + k, block
                block, k = Block(), k + 1
                block.kind = kind
            block.add(row, text)
    if block.rows:
        yield base + k, block


def block_name(block: int) -> str:
    """Shuffle key of a block's stream; no pre-token has a blank between a digit and a letter."""
    return f"{block} block"


def block_rows(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(key, block, place, ids, ends, places, stream)``: two kinds of rows of each block.

    A row for each distinct pre-token (``key``) with its ``place`` in the block's sorted list, and one under
    the block's name: the ids of its documents, where each ends in the stream, and the stream, which
    holds, by position, packed indices into ``places``.
    """
    schema = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("ends", T.ArrayType(T.LongType())),
                           T.StructField("places", T.BinaryType()), T.StructField("stream", T.BinaryType())])

    def rows(kind: pa.DataType, key: list, block: int, place, ids, ends, places, stream) -> pa.RecordBatch:
        n = len(key)
        types = (pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.string()), pa.array(np.full(n, block, np.int64)), pa.array(place, pa.int32()),
             *(pa.nulls(n, t) if v is None else pa.array([v], t) for v, t in zip((ids, ends, places, stream), types))], names=schema.names)

    def run(batches):
        for block, x in _blocks(batches, block_bytes):
            words, _ = x.listed()
            for lo in range(0, len(words), 1 << 17):
                part = words[lo:lo + (1 << 17)]
                yield rows(x.kind, part, block, np.arange(lo, lo + len(part), dtype=np.int32), None, None, None, None)
            places, flat, ends = x.streams()
            yield rows(x.kind, [block_name(block)], block, [None], x.rows, ends.tolist(), _pack(places), _pack(flat))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _varint(v: np.ndarray) -> np.ndarray:
    """LEB128 bytes of small non-negative integers."""
    size = 1 + (v >= 1 << 7).astype(np.int8) + (v >= 1 << 14) + (v >= 1 << 21) + (v >= 1 << 28)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(5):
        has = size > k
        out[at[:-1][has] + k] = ((v[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out


def _unvarint(b: np.ndarray) -> np.ndarray:
    stop = np.flatnonzero(b < 128)
    start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    out = np.zeros(len(stop), np.int64)
    for k in range(5):
        has = start + k <= stop
        out[has] |= (b[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _pack(v: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(
        b"".join(_varint(v[i:i + (1 << 18)]).tobytes() for i in range(0, len(v), 1 << 18)))


def _unpack(b: bytes) -> np.ndarray:
    return _unvarint(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8))


@functools.lru_cache(2)
def _encoder(ranks_path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks_path),
                             special_tokens={})


def encode_words(words: DataFrame, ranks_path: str) -> DataFrame:
    """``(word, ids)`` of distinct pre-tokens, by the merges of a rank file; ids as uint32 bytes."""
    def run(batches):
        encode = _encoder(ranks_path)._encode_single_piece
        for b in batches:
            ids = [encode(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def token_bytes(spark, ranks_path: str) -> DataFrame:
    """``(id, bytes)`` of a rank file."""
    rows = sorted((i, bytearray(t)) for t, i in load_ranks(ranks_path).items())
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode_words(encoded: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add ``bytes``: the ids of each word looked up in the token-byte table, in order.

    The table has one row for each entry of the vocabulary, tens of thousands whatever
    the corpus, hence the broadcast.
    """
    each = encoded.select("word", "ids", F.posexplode("ids").alias("k", "id")).join(F.broadcast(tokens), "id")
    out = each.groupBy("word").agg(F.first("ids").alias("ids"),
                                   F.array_sort(F.collect_list(F.struct("k", "bytes"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: F.hex(x["bytes"])), "")
    return out.select("word", "ids", F.unhex(joined).alias("bytes"))


def _pack_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and decoded bytes of the words of each block in a partition, packed: one row a block and batch."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for t in complete_groups(batches, ["block"], 1 << 17):
        block = t.column("block").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        for lo, hi in zip(cuts, [*cuts[1:], len(block)]):
            part = t.slice(lo, hi - lo)
            ids = part.column("ids").combine_chunks()
            raw = part.column("bytes").combine_chunks()
            raw = raw.cast(pa.binary()) if pa.types.is_large_binary(raw.type) else raw
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
            data = memoryview(raw.buffers()[2])[at[0]:at[-1]] if at[-1] else b""
            n_ids = ids.value_lengths().to_numpy()
            place = part.column("place").to_numpy().astype(np.int64)
            # neighbours in the sorted list have much in common: differences of places, and texts alike, pack well
            head = np.concatenate([[hi - lo], np.diff(place, prepend=0), n_ids, np.diff(at)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[lo])], pa.int64()),
                 pa.array([pack(_varint(head.astype(np.int64)).tobytes())], pa.binary()),
                 pa.array([pack(ids.flatten().to_numpy().astype("<u4").tobytes())], pa.binary()),
                 pa.array([pack(data)], pa.binary())], names=["block", "head", "ids", "bytes"])


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + len`` of each entry, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens, lens) + np.repeat(starts, lens)


def _reassemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Put the ids and bytes of one block in order, document by document."""
    unpack = zstandard.ZstdDecompressor().decompress
    n_words, places, n_ids, n_bytes, ids, raw = 0, [], [], [], [], []
    for h, i, d in zip(*(right.column(c).to_pylist() for c in ("head", "ids", "bytes"))):
        h = _unvarint(np.frombuffer(unpack(h), np.uint8))
        n = int(h[0])
        places.append(np.cumsum(h[1:1 + n]))
        n_ids.append(h[1 + n:1 + 2 * n])
        n_bytes.append(h[1 + 2 * n:])
        ids.append(np.frombuffer(unpack(i), "<u4"))
        raw.append(np.frombuffer(unpack(d), np.uint8))
        n_words += n
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    places, n_ids, n_bytes, ids, raw = (cat(x, k) for x, k in (
        (places, np.int64), (n_ids, np.int64), (n_bytes, np.int64), (ids, np.uint32), (raw, np.uint8)))
    by = np.argsort(places)
    if not np.array_equal(places[by], np.arange(n_words)):
        raise RuntimeError("the words of a block are incomplete")
    id_at, byte_at = (np.cumsum(n_ids) - n_ids)[by], (np.cumsum(n_bytes) - n_bytes)[by]
    n_ids, n_bytes = n_ids[by], n_bytes[by]
    out = []
    for doc_ids, ends, order, stream in zip(*(left.column(c).to_pylist() for c in ("ids", "ends", "places", "stream"))):
        flat, lo = _unpack(order)[_unpack(stream)], 0
        for doc, hi in zip(doc_ids, ends):
            w = flat[lo:hi]
            seq = ids[_ragged(id_at[w], n_ids[w])]
            text = raw[_ragged(byte_at[w], n_bytes[w])]
            out.append((doc, len(seq), hashlib.sha256(seq.astype("<u4").tobytes()).hexdigest(),
                        hashlib.sha256(text.tobytes()).hexdigest()))
            lo = hi
    cols = list(zip(*out)) if out else [[], [], [], []]
    return pa.table([pa.array(cols[0], left.schema.field("ids").type.value_type), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode every text, decode the ids again: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    A null or empty text has no tokens, and both hashes are those of no bytes.
    Repeated rows give repeated results; a text longer than a block is a block of its own.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    spark = docs.sparkSession
    n = partitions(spark)
    rows = block_rows(d, block_bytes).repartition(n, "key")
    # Three uses of one shuffle.  Each needs all its columns and filters above it only (the counts, the sizes
    # handed on, a condition with a random part, which may not be moved), so that all three stay the same exchange.
    packed = ("ids", "ends", "places", "stream")
    distinct = (rows.groupBy("key").agg(F.max("place").alias("place"), F.max("block").alias("block"), *[F.count(c).alias(c) for c in packed])
                .where(F.col("place").isNotNull()).withColumnRenamed("key", "word"))
    coded = decode_words(encode_words(distinct, ranks_path).repartition(n, "word"), token_bytes(spark, ranks_path))
    words = (rows.select("key", "block", "place", *[(F.size if c in ("ids", "ends") else F.octet_length)(c).alias(f"_{c}") for c in packed])
             .join(coded, F.col("key") == F.col("word")))
    answers = (words.select("block", "place", "ids", "bytes", *[f"_{c}" for c in packed]).sortWithinPartitions("block", "place")
               .mapInArrow(_pack_answers, "block long, head binary, ids binary, bytes binary")
               .withColumn("key", F.concat(F.col("block").cast("string"), F.lit(" block"))))
    streams = rows.where(F.coalesce("place", F.lit(-1)) + F.floor(F.rand(1)) < 0)  # a random number below 1 has floor 0
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return streams.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(_reassemble, schema)
