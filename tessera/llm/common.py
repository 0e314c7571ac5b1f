"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

#: Words are maximal runs of anything but space and the ASCII controls 9 to 13.
#: ``bytes.split()`` and this pattern agree.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select columns by their exact name, whatever else the table holds.

    ``pick(df, doc_id="id")`` returns one column ``doc_id``.  Extra columns may
    clash with internal names or differ only by case: columns are addressed by
    position, so nothing is ambiguous.
    """
    cols = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    out = []
    for new, old in names.items():
        hits = [i for i, c in enumerate(cols) if c == old] or \
               [i for i, c in enumerate(cols) if c.lower() == old.lower()]
        if not hits:
            raise ValueError(f"no column {old!r}; the table has {cols}")
        out.append(F.col(f"_c{hits[0]}").alias(new))
    return plain.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def ship(spark: SparkSession) -> None:
    """Give the executors this package (once a session), as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` at most (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        lens = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lens)
        lo = 0
        while lo < b.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def binary(col: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column without a copy."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())


def binary_from(parts: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary column over one buffer; row i is ``parts[offsets[i]:offsets[i+1]]``."""
    data = parts if isinstance(parts, (bytes, bytearray)) else np.ascontiguousarray(parts).tobytes()
    off = np.ascontiguousarray(offsets, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], max_rows: int = 1 << 18
                    ) -> Iterator[pa.Table]:
    """Regroup a stream that is sorted by ``keys`` into tables that hold whole groups.

    The rows of a group may span batches; the last, perhaps unfinished group of a
    table waits for the next one.  Memory is bounded by ``max_rows`` plus one group.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(final: bool) -> tuple[pa.Table | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(held).combine_chunks()
        if final or t.num_rows == 0:
            return t, []
        last = t.num_rows
        same = np.ones(t.num_rows, dtype=bool)
        for k in keys:
            c = t.column(k).to_numpy(zero_copy_only=False)
            same &= c == c[-1]
        last = int(np.argmax(same)) if same.any() else 0
        # rows are sorted, so the final group is the suffix that starts at ``last``
        return (t.slice(0, last) if last else None), t.slice(last).to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= max_rows:
            whole, held = cut(False)
            n = sum(x.num_rows for x in held)
            if whole is not None and whole.num_rows:
                yield whole
    if held:
        whole, _ = cut(True)
        if whole is not None and whole.num_rows:
            yield whole


def cumulative_bounds(weights: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges of ``weights`` whose sums stay at ``limit`` (one entry at least)."""
    out, lo = [], 0
    ends = np.cumsum(weights)
    while lo < len(weights):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


# Bytes of words of letters, digits and anything beyond ASCII; A-Z are lowered, the rest become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                    for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return (text or b"").translate(_WORD_BYTES).split()


class WordHash:
    """64-bit hashes of words, remembered within a task (forgotten beyond ``most`` words)."""

    def __init__(self, most: int = 1 << 19) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finishing step of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        out = out * step + h[j:j + n]
    return mix(out)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows
