"""Fill-in-the-middle transformation with a learned rank index over line boundaries.

The boundaries of the lines of a stretch of documents (byte offsets, one stretch of bounded size
at a time) are a growing sequence.  A piecewise-linear index is fitted to all of them: each
segment is the longest run of boundaries that one line predicts within ``error`` bytes, found with
a cone of admissible slopes that narrows boundary by boundary.  The index keeps a slope a
segment and a small residual a boundary instead of the offsets.  A cut after k lines of a document
is predicted from its rank by the segment's line and made exact by the stored residual.

A document's result depends on its own id and text alone, so it does not matter how the documents
are dealt to tasks and stretches.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, binary_from, pick, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 1024
SLICE_BYTES = 8 << 20


class RankIndex:
    """Piecewise-linear map from rank to value of a non-decreasing integer sequence, exact by residuals."""

    def __init__(self, values: np.ndarray, error: int = ERROR) -> None:
        values = np.asarray(values, np.int64)
        starts, slopes, at = [], [], 0
        while at < len(values):
            end, slope = self._longest(values, at, error)
            starts.append(at)
            slopes.append(slope)
            at = end
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes, np.float64)
        self.bases = values[self.starts] if len(values) else np.zeros(0, np.int64)
        residuals = values - self.predict(np.arange(len(values)))
        # a line within the error of every value, plus half a unit of rounding at each end
        small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if error + 1 <= np.iinfo(t).max)
        self.residuals = residuals.astype(small)

    @staticmethod
    def _longest(values: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """End of the longest run from ``at`` that one line through its first value fits, and a slope."""
        low, high, end, width = -np.inf, np.inf, at + 1, 64
        while end < len(values):
            run = np.arange(end, min(len(values), end + width))
            rise, steps = values[run] - values[at], run - at
            lows = np.maximum.accumulate(np.maximum((rise - error) / steps, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / steps, high))
            good = int(np.argmin(np.append(lows <= highs, False)))
            if good:
                low, high, end = lows[good - 1], highs[good - 1], end + good
            if good < len(run):
                break
            width *= 2
        return end, 0.0 if end == at + 1 else (low + high) / 2

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Value at each rank by the segments' lines alone."""
        seg = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[seg] + np.rint(self.slopes[seg] * (ranks - self.starts[seg])).astype(np.int64)

    def exact(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residuals[ranks]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line boundaries of consecutive texts in one buffer.

    ``offsets`` are the texts' ends and starts (one more than texts).  Returns all boundaries, each
    text's start first, and the rank of each text's start (one more than texts).  A line is
    ``[^\\n]*\\n|[^\\n]+``, so a text has as many lines as boundaries after its start.
    """
    newline = np.flatnonzero(data == 10) + 1
    starts, ends = offsets[:-1], offsets[1:]
    # an unfinished last line ends with its text
    open_end = ends[(ends > starts) & (data[np.maximum(ends, 1) - 1] != 10)] if len(data) else ends[:0]
    after = np.concatenate([newline, open_end])
    owner = np.searchsorted(offsets, after, side="left") - 1  # the text whose (start, end] holds the boundary
    # several empty texts share one offset: the boundary belongs to the text that ends there and is not empty
    value = np.concatenate([starts, after])
    text = np.concatenate([np.arange(len(starts)), owner])
    order = np.lexsort((value, text))
    counts = np.bincount(text, minlength=len(starts))
    return value[order], np.concatenate([[0], np.cumsum(counts)])


def _transform(batch: pa.RecordBatch, error: int) -> pa.RecordBatch:
    raw = binary(batch.column("text"))
    lengths = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in raw], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    blob = b"".join(v.as_py() or b"" for v in raw)
    data = np.frombuffer(blob, np.uint8)
    values, first = boundaries(data, offsets)
    index = RankIndex(values, error)
    lines = np.diff(first) - 1
    one, two = (batch.column(c).to_numpy() % (lines + 1) for c in ("h1", "h2"))
    cut_a, cut_b = index.exact(first[:-1] + np.minimum(one, two)), index.exact(first[:-1] + np.maximum(one, two))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])  # code points before a byte
    form = batch.column("form").to_pylist()
    plain = np.array([f == "plain" for f in form], bool)
    out = []
    for f, s, a, b, e in zip(form, offsets[:-1].tolist(), cut_a.tolist(), cut_b.tolist(), offsets[1:].tolist()):
        if f == "plain":
            out.append(blob[s:e])
        elif f == "psm":
            out.append(b"".join((b"<P>", blob[s:a], b"<S>", blob[b:e], b"<M>", blob[a:b])))
        else:
            out.append(b"".join((b"<S>", blob[b:e], b"<P>", blob[s:a], b"<M>", blob[a:b])))
    ends = np.concatenate([[0], np.cumsum([len(o) for o in out])])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(lines), batch.column("form"),
         pa.array(points[cut_a] - points[offsets[:-1]], mask=plain), pa.array(points[cut_b] - points[cut_a], mask=plain),
         binary_from(b"".join(out), ends).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
                   spm_rate: int = 50, error: int = ERROR) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per input row.

    ``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of those with the suffix first.
    A null text is an empty text; an empty text has no line and stays plain.  A null id has its
    cuts drawn from ``seed:`` alone.  Rows that are equal in id and text have equal results.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm"))
    d = d.select("doc_id", text.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            yield _transform(b, error)

    return d.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The exact text behind an output.  No marker is part of the text or arises where it meets one."""
    def between(start: Column, end: Column | None = None) -> Column:
        return F.substr(output, start) if end is None else F.substr(output, start, F.greatest(end - start, F.lit(0)))

    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    psm = F.concat(between(p + 3, s), between(m + 3), between(s + 3, m))
    spm = F.concat(between(p + 3, m), between(m + 3), between(s + 3, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_report(docs: DataFrame, **options) -> DataFrame:
    """Digest columns of ``fill_in_middle`` and of the text rebuilt from each output."""
    done = fill_in_middle(docs, **options)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
