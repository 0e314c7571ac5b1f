"""File loading (L-1..L-11): CSV / JSON / Parquet / Excel into a DataFrame.

Sniffing reads only a small head of the file; parsing, NA tokens,
inf->null and type inference are one distributed read plus one
conversion-rate aggregate over all string columns (never a per-column
loop of jobs).
"""

from __future__ import annotations

import codecs
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import NA_TOKENS, na_tokens_to_null, nullify_nonfinite

# ---- fixed values that must equal the reference's -------------------------
SEPARATORS = (",", ";", "\t", "|")
NUMERIC_SKIP_NAMES = ("id", "name", "code", "sku", "url", "link", "image", "description", "address",
                      "email", "phone")
DATE_NAME_HINTS = ("date", "time", "created", "updated", "timestamp")
NUMERIC_MIN_RATE = 0.80
DATE_MIN_RATE = 0.70
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss",
                "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")
MAX_FILE_MB = 200
# ---------------------------------------------------------------------------

SUPPORTED = {".csv": "csv", ".txt": "csv", ".tsv": "csv", ".json": "json", ".parquet": "parquet",
             ".xlsx": "excel", ".xls": "excel"}


#: Bytes of a file's head that are looked at for encoding and separator.
HEAD_BYTES = 1 << 16
#: Doubles beyond this may not fit a bigint.
BIGINT_LIMIT = 9.2e18


class LoadError(ValueError):
    pass


def head_bytes(spark: SparkSession, path: str, limit: int = HEAD_BYTES) -> bytes:
    """The first ``limit`` bytes of a file (of the first non-empty one of a folder or pattern), through Spark's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(p) or []:
        inner = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        for f in sorted(inner, key=lambda x: x.getPath().toString()):
            if f.getLen() and not f.isDirectory() and not f.getPath().getName().startswith(("_", ".")):
                stream = fs.open(f.getPath())
                try:
                    return bytes(stream.readNBytes(limit))
                finally:
                    stream.close()
    return b""


def detect_encoding(head: bytes) -> str:
    """Encoding of a file's first bytes, by a byte order mark or the first one they are valid in.

    A UTF-8 sequence that the limit cuts off counts as valid; every byte is valid Latin-1.
    """
    for mark, name in ((b"\xff\xfe\x00\x00", "UTF-32"), (b"\x00\x00\xfe\xff", "UTF-32"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=len(head) < HEAD_BYTES)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def sniff_csv(spark: SparkSession, path: str, k: int = 20) -> tuple[str, str]:
    """L-2: (encoding, separator): the encoding of the first bytes, and the first separator that cuts the header in two."""
    head = head_bytes(spark, path)
    enc = detect_encoding(head)
    lines = [x for x in head.decode(enc, errors="ignore").lstrip("\ufeff").splitlines()[:k] if x]
    if not lines:
        raise LoadError("File is empty")
    return enc, next((sep for sep in SEPARATORS if len(lines[0].split(sep)) >= 2), ",")


def clean_column_names(names: list[str], style: str = "loader") -> list[str]:
    """L-6 (loader: strip, blank/'Unnamed:' -> Column_i) and L-7 (sanitizer:
    also de-duplicates repeats as name_k, blank -> column_n)."""
    out, seen = [], {}
    for i, n in enumerate(names):
        s = str(n).replace("﻿", "").strip()
        if not s or s.startswith("Unnamed:") or s.startswith("_c"):
            s = f"Column_{i}" if style == "loader" else f"column_{i}"
        if style != "loader":
            if s in seen:
                seen[s] += 1
                s = f"{s}_{seen[s]}"
            else:
                seen[s] = 0
        out.append(s)
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """L-10 / L-11: string columns become numbers when > 80 % of ALL rows parse
    (names with id/name/code/... skipped) — integral -> bigint, else double —
    and timestamps when the name hints a date and > 70 % parse.  Text that spells NaN or an infinity
    is null, and whole numbers are read as bigint, not by way of a double, which would round them."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return df
    num_cands = [c for c in strs if not any(k in c.lower() for k in NUMERIC_SKIP_NAMES)]
    date_cands = [c for c in strs if any(k in c.lower() for k in DATE_NAME_HINTS)]

    def ts(c):
        return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in DATE_FORMATS])

    def quoted(c):
        return "`" + c.replace("`", "``") + "`"

    def number(c):
        d = F.expr(f"try_cast({quoted(c)} AS DOUBLE)")
        return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)

    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(num_cands):
        d = number(c)
        aggs += [F.count(d).alias(f"num{i}"), F.count_if(d.isNotNull() & (d != F.floor(d))).alias(f"frac{i}"),
                 F.count_if(F.abs(d) > BIGINT_LIMIT).alias(f"big{i}")]
    for i, c in enumerate(date_cands):
        aggs.append(F.count(ts(c)).alias(f"dt{i}"))
    a = df.agg(*aggs).first().asDict()
    n = max(a["__n"], 1)
    casts = {}
    for i, c in enumerate(date_cands):
        if a[f"dt{i}"] / n > DATE_MIN_RATE:
            casts[c] = ts(c)
    for i, c in enumerate(num_cands):
        if c not in casts and a[f"num{i}"] / n > NUMERIC_MIN_RATE:
            d = number(c)
            casts[c] = (F.coalesce(F.expr(f"try_cast({quoted(c)} AS BIGINT)"), d.try_cast("bigint"))
                        if a[f"frac{i}"] == 0 and a[f"big{i}"] == 0 else d)
    return df.select(*[casts[c].alias(c) if c in casts else F.col(c) for c in df.columns])


def load_file(spark: SparkSession, path: str, *, sheet_name=0, infer: bool = True,
              max_mb: float | None = None) -> DataFrame:
    """L-1: dispatch by extension; reject unsupported and empty input, and input over ``max_mb`` if one is given."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in SUPPORTED:
        raise LoadError(f"Unsupported file type: {ext or 'none'}")
    kind = SUPPORTED[ext]
    if max_mb is not None:
        size = file_size_mb(spark, path)
        if size > max_mb:
            raise LoadError(f"File too large: {size:.0f} MB (limit {max_mb} MB)")
    if kind == "csv":
        enc, sep = sniff_csv(spark, path)
        # lines of wide encodings cannot be found by their bytes: such a file is read whole by one task
        df = (spark.read.option("header", True).option("sep", sep).option("encoding", enc)
              .option("multiLine", enc in ("UTF-16", "UTF-32")).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path))
    elif kind == "json":
        df = load_json(spark, path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        df = load_excel(spark, path, sheet_name)
    df = df.toDF(*clean_column_names(df.columns))
    df = na_tokens_to_null(df, NA_TOKENS)
    df = nullify_nonfinite(df)
    if infer:
        df = infer_types(df)
    if df.isEmpty():
        raise LoadError("File contains no rows")
    return df


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """L-4: JSON lines, records list, dict-of-lists (zipped to rows), single object.
    Line-delimited parsing first (splittable); a document spread over many
    lines shows up as corrupt records only, and is then re-read whole."""
    df = spark.read.json(path)
    if df.columns == ["_corrupt_record"]:
        df = spark.read.option("multiLine", True).json(path)
    fields = df.schema.fields
    if fields and all(isinstance(f.dataType, T.ArrayType) for f in fields) and "_corrupt_record" not in df.columns:
        # dict of equal-length lists -> one row per position
        z = df.select(F.explode(F.arrays_zip(*[F.col(f.name) for f in fields])).alias("r"))
        return z.select("r.*")
    return df


def load_excel(spark: SparkSession, path: str, sheet_name=0) -> DataFrame:
    """L-3: Excel via ``binaryFile`` + ``mapInPandas`` (one file -> many rows);
    requires an Excel reader (openpyxl) on the executors."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise LoadError("Excel support needs openpyxl, which is not installed") from e
    import io

    import pandas as pd
    first = pd.read_excel(io.BytesIO(spark.read.format("binaryFile").load(path).first()["content"]),
                          sheet_name=sheet_name, nrows=5, dtype=str)
    schema = T.StructType([T.StructField(str(c), T.StringType()) for c in first.columns])

    def read(it):
        for pdf in it:
            for content in pdf["content"]:
                yield pd.read_excel(io.BytesIO(content), sheet_name=sheet_name, dtype=str)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def file_size_mb(spark: SparkSession, path: str) -> float:
    """V-10: total size of the input files from the binaryFile source metadata."""
    r = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    return (r or 0) / 1e6
