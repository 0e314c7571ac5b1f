"""Secret scan: fixed patterns, and novelty under dictionary-primed zstandard.

Beside the fixed patterns, a string of 16 or more token characters with a sensitive
word in the text around it is a candidate; names before ``=`` are no part of it, and the
lines of a block follow their first one.  It is compressed with a raw dictionary made of common identifiers and the text around it (both sides, without the
string itself).  Identifiers, paths and prose repeat what is in the dictionary and
cost few bytes; a secret does not repeat anything.  Candidates whose marginal bytes
come close to what their alphabet allows, and that mix letters with digits, are reported.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, pick, slices

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_WORD = re.compile(rb"key|token|secret|passw|pwd|auth|bearer|credential|signature|private", re.I)
_RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}")
_VALUE = re.compile(rb"[^=]{16,}(?:=+\Z)?")
_NAMES = re.compile(rb"(?:[A-Za-z_][A-Za-z_.-]*=+)*")
_NEXT_LINE = re.compile(rb"[\x20\t]*\r?\n[\x20\t]*")
#: The last, short line of a PEM block.
_TAIL = re.compile(rb"\r?\n[A-Za-z0-9+/]{1,15}={0,2}(?=\r?\n-----END)")
_LETTER, _DIGIT = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")
#: Common identifiers, the part of the dictionary that no text needs to supply.
IDENTIFIERS = (b"access_token refresh_token api_key apikey secret_key private_key public_key password passwd username "
               b"authorization authentication bearer credential certificate signature session_id client_id client_secret "
               b"http https www.example.com localhost config settings environment production development development_mode "
               b"default application application_name service database connection_string user admin root system version "
               b"request response header content-type application/json utf-8 boolean string integer function return import "
               b"export const class public private static void null true false undefined 0123456789 abcdefghijklmnopqrstuvwxyz "
               b"ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 ffffffff example placeholder your_token_here changeme xxxxxxxx")


def marginal_bytes(parts: list[bytes], around: bytes) -> list[int]:
    """Bytes that each part adds to a frame of its own, primed with identifiers and the surroundings."""
    d = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=19, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    empty = len(c.compress(b""))
    return [len(c.compress(x)) - empty for x in parts]


def _cut(text: bytes, most: int) -> list[bytes]:
    """Consecutive parts of about equal length, none above ``most``."""
    n = -(-len(text) // most)
    return [text[len(text) * i // n:len(text) * (i + 1) // n] for i in range(n)]


def is_novel(candidate: bytes, around: bytes, ratio: float = 0.9, piece: int = 24, most: int = 1 << 12) -> bool:
    """Whether a candidate repeats neither the dictionary nor itself.

    Huffman codes bring any long string towards the share of its alphabet, log2(characters) / 8, be it
    random or not.  They do not pay on pieces of up to ``piece`` bytes, so these must cost ``ratio`` of
    the length; parts of up to ``most`` bytes must cost ``ratio`` of their alphabet's share.
    """
    if sum(marginal_bytes(_cut(candidate, piece), around)) < ratio * len(candidate):
        return False
    parts = _cut(candidate, most) if len(candidate) > piece else []
    share = sum(len(x) * math.log2(len(set(x))) / 8 for x in parts)
    return sum(marginal_bytes(parts, around)) >= ratio * share


def candidates(text: bytes) -> Iterator[tuple[int, int]]:
    """Strings of token characters, without the names that stand before ``=``; with letters and digits."""
    for m in _RUN.finditer(text):
        run = m[0]
        found = [x.span() for x in _VALUE.finditer(run)]
        if not found:
            head = _NAMES.match(run).end()
            found = [(head, len(run))] if len(run) - head >= 16 else []
        for a, b in found:
            if _LETTER.search(run, a, b) and _DIGIT.search(run, a, b):
                yield m.start() + a, m.start() + b


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _outside(a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted disjoint spans leave of ``a`` to ``b``."""
    out = []
    for i in range(max(0, bisect.bisect_right(spans, (a,)) - 1), len(spans)):
        x, y = spans[i]
        if x >= b:
            break
        if a < x:
            out.append((a, x))
        a = max(a, y)
    return out + [(a, b)] if a < b else out


def find_spans(text: bytes, window: int = 512, ratio: float = 0.9, most: int = 1 << 12) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in bytes, by start and kind.

    ``window`` bytes on both sides of a candidate must hold a sensitive word, unless it is
    the next line of a secret, and prime the dictionary; ``ratio`` and ``most`` are those of
    :func:`is_novel`.  A candidate is left to the fixed patterns only if they cover it;
    of one that is not novel as a whole, the parts that they leave are measured.
    """
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base = _union(sorted((a, b) for _, a, b in out))
    last = -1  # end of the candidate before, if it was secret
    for a, b in candidates(text):
        follows = last >= 0 and _NEXT_LINE.fullmatch(text, last, a)
        last = -1
        before, after = text[max(0, a - window):a], text[b:b + window]
        if not (follows or _WORD.search(before) or _WORD.search(after)):
            continue
        free = _outside(a, b, base)
        new = lambda x, y: is_novel(text[x:y], (before + after).replace(text[x:y], b""), ratio, most=most)
        if not free:
            last = b
            continue
        found = [(a, b)] if new(a, b) else [(x, y) for x, y in free if (x, y) != (a, b) and y - x >= 16 and new(x, y)]
        if found and found[-1][1] == b:
            last = b
            tail = _TAIL.match(text, b)
            found[-1] = found[-1][0], tail.end() if tail else b
        out += [("novel", x, y) for x, y in found]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte positions of spans (sorted by start) as code points."""
    if not spans or text.isascii():
        return spans
    places = sorted({p for _, a, b in spans for p in (a, b)})
    at, n, last = {}, 0, 0
    for p in places:
        n += len(text[last:p].decode("utf-8", "replace"))
        at[p], last = n, p
    return [(k, at[a], at[b]) for k, a, b in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)``, one row per input row; positions are code points.

    Null and empty texts have no spans; repeated rows give repeated results.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            rows = []
            for text in binary(b.column("text")).to_pylist():
                found = code_points(text, find_spans(text, **params)) if text else []
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return d.mapInArrow(run, schema)


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>", **params) -> DataFrame:
    """The same rows and columns with every span of ``text_col`` replaced by ``mark``."""
    where = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = []
            for text in binary(b.column(where)).to_pylist():
                spans, out, last = (find_spans(text, **params) if text else []), [], 0
                if not spans:
                    texts.append(text)
                    continue
                for _, s, e in spans:
                    if s >= last:
                        out += [text[last:s], mark.encode()]
                    last = max(last, e)
                texts.append(b"".join(out) + text[last:])
            col = pa.array(texts, pa.binary()).cast(b.schema.field(where).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:where], col, *b.columns[where + 1:]], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of each document."""
    s = scan_secrets(docs, id_col, text_col)
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return s.select("doc_id", *[count(k) for k in KINDS[:3]],
                    F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
                    F.array_join(F.transform("spans", shown), ",").alias("spans"), count("novel"))
