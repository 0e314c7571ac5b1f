"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a word between blanks in both directions and
labels every byte with language probabilities; a document's probabilities are the mean
over all its positions.  States start anew at each word, so a recurring word has
the same labels wherever it stands: each distinct word of a batch is read once and its
position labels are added up as often as it occurs.  Words are runs of letters,
lower-cased; digits, marks and blanks get no label.

The network is trained on the driver in numpy by backpropagation through time, on a
bounded sample (``docs_per_language`` documents of each language, ``words_per_doc`` words
spread evenly over each), and is a few thousand numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, slices

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Longer words are read in pieces of so many bytes.
PIECE = 48


def words_of(chunk: str) -> list[bytes]:
    """Lower-cased runs of letters as UTF-8, in pieces of ``PIECE`` bytes at most."""
    out = []
    for run in _WORD.findall(chunk.lower()):
        # the pattern also takes signs such as a half or a circled one for letters
        for w in [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split():
            w = w.encode("utf-8", "replace")
            out += [w] if len(w) <= PIECE else [w[i:i + PIECE] for i in range(0, len(w), PIECE)]
    return out


class BiGRU:
    """Byte embedding, one gated recurrent layer in each direction, a softmax at every position."""

    def __init__(self, n_labels: int, width: int = 12, hidden: int = 20, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"E": rng.standard_normal((256, width)).astype(np.float32) * 0.3,
                  "O": init(2 * hidden, n_labels), "ob": np.zeros(n_labels, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: init(width, 3 * hidden), "U" + d: init(hidden, 3 * hidden),
                       "c" + d: np.zeros(3 * hidden, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[list[np.ndarray], list]:
        """States over ``x`` (time, words, width) in the given order."""
        h, U, n = np.zeros((x.shape[1], self.hidden), np.float32), self.p["U" + d], self.hidden
        pre = x @ self.p["W" + d] + self.p["c" + d]
        states, tape = [], []
        for t in range(len(x)):
            hu = h @ U
            zr = 1 / (1 + np.exp(-(pre[t][:, :2 * n] + hu[:, :2 * n])))
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(pre[t][:, 2 * n:] + r * hu[:, 2 * n:])
            new = c + z * (h - c)
            if keep:
                tape.append((h, z, r, c, hu[:, 2 * n:]))
            states.append(new)
            h = new
        return states, tape

    def probabilities(self, seq: np.ndarray, keep: bool = False):
        """Label probabilities (time, words, labels) of equally long byte sequences (words, time)."""
        x = self.p["E"][seq.T]
        f, tf = self._run(x, "f", keep)
        b, tb = self._run(x[::-1], "b", keep)
        h = np.concatenate([np.stack(f), np.stack(b[::-1])], axis=2)
        s = h @ self.p["O"] + self.p["ob"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        return (s, (x, h, tf, tb)) if keep else s

    def gradients(self, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        s, (x, h, tf, tb) = self.probabilities(seq, True)
        steps, words, n = len(s), len(label), self.hidden
        at = s[:, np.arange(words), label]
        ds = s.copy()
        ds[:, np.arange(words), label] -= 1
        ds /= steps * words
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["O"] = np.einsum("tbh,tbl->hl", h, ds)
        g["ob"] = ds.sum(axis=(0, 1))
        dh_all, dx = ds @ self.p["O"].T, np.zeros_like(x)
        for d, tape, part in (("f", tf, dh_all[:, :, :n]), ("b", tb, dh_all[::-1, :, n:])):
            W, U, back = self.p["W" + d], self.p["U" + d], np.zeros((words, n), np.float32)
            inputs = x if d == "f" else x[::-1]
            for t in range(steps - 1, -1, -1):
                before, z, r, c, hc = tape[t]
                dh = part[t] + back
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (before - c) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                inner = np.concatenate([dz, dr, dc * r], axis=1)
                g["W" + d] += inputs[t].T @ gates
                g["c" + d] += gates.sum(axis=0)
                g["U" + d] += before.T @ inner
                back = dh * z + inner @ U.T
                dx[t if d == "f" else steps - 1 - t] += gates @ W.T
        np.add.at(g["E"], seq.T, dx)
        return float(-np.log(at + 1e-9).mean()), g


def train(samples: dict[str, list[bytes]], steps: int = 700, batch: int = 256, rate: float = 0.01,
          seed: int = 11) -> tuple[list[str], BiGRU]:
    """Fit the network to words by language, drawn evenly over languages; Adam, fixed seed."""
    labels = sorted(k for k, v in samples.items() if v)
    net, rng = BiGRU(len(labels)), np.random.default_rng(seed)
    by_len: dict[int, list[tuple[bytes, int]]] = {}
    for i, k in enumerate(labels):
        for j in rng.integers(0, len(samples[k]), steps * batch // len(labels)):
            w = samples[k][j]
            by_len.setdefault(len(w), []).append((w, i))
    batches = [v[lo:lo + batch] for v in by_len.values() for lo in range(0, len(v), batch)]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for t, at in enumerate(rng.permutation(len(batches)), 1):
        rows = batches[at]
        seq = np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(len(rows), -1)
        _, g = net.gradients(seq, np.array([i for _, i in rows]))
        lr = rate * min(1.0, 2 * (1 - t / (len(batches) + 1))) * min(1.0, len(rows) / 32)
        for k in net.p:
            m[k] += 0.1 * (g[k] - m[k])
            v2[k] += 0.01 * (g[k] ** 2 - v2[k])
            net.p[k] -= lr * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.99 ** t)) + 1e-6)
    return labels, net


class Reader:
    """Position labels of documents; distinct chunks and words are read once (forgotten beyond a bound)."""

    def __init__(self, net: BiGRU, n_labels: int, most: int = 1 << 19) -> None:
        self.net, self.n, self.most = net, n_labels, most
        self.chunks: dict[str, int] = {}
        self.sums = np.zeros((0, n_labels + 1))

    def _read(self, words: list[bytes]) -> np.ndarray:
        """Per word: its probabilities added up over its positions, and their number."""
        out = np.zeros((len(words), self.n + 1))
        by = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, at in by.items():
            for lo in range(0, len(at), 4096):
                rows = at[lo:lo + 4096]
                seq = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(len(rows), size)
                out[rows, :-1] = self.net.probabilities(seq).sum(axis=0)
                out[rows, -1] = size
        return out

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Per document: label probabilities added up over all positions, and the number of positions."""
        if len(self.chunks) > self.most:
            self.chunks.clear()
            self.sums = np.zeros((0, self.n + 1))
        seqs, new = [], []
        for text in texts:
            ids = []
            for x in (text or "").split():
                k = self.chunks.get(x)
                if k is None:
                    k = self.chunks[x] = len(self.chunks)
                    new.append(x)
                ids.append(k)
            seqs.append(ids)
        if new:
            words: dict[bytes, int] = {}
            of, owner = [], []
            for i, x in enumerate(new):
                for w in words_of(x):
                    of.append(words.setdefault(w, len(words)))
                    owner.append(i)
            add = np.zeros((len(new), self.n + 1))
            if of:
                np.add.at(add, owner, self._read(list(words))[of])
            self.sums = np.concatenate([self.sums, add])
        out = np.zeros((len(texts), self.n + 1))
        for i, ids in enumerate(seqs):
            if ids:
                out[i] = self.sums[ids].sum(axis=0)
        return out


def training_sample(rows: DataFrame, docs_per_language: int, words_per_doc: int) -> dict[str, list[bytes]]:
    """Words by language of a bounded, repeatable choice of labelled rows ``(doc_id, text, lang)``.

    Rows are chosen by a hash of their id; languages are few, so one count for each
    reaches the driver, and then at most ``docs_per_language * words_per_doc`` words for each.
    """
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.lit(0.0)
    for k, n in counts.items():
        limit = F.when(F.col("lang") == k, F.lit(min(1.0, 2.0 * docs_per_language / n))).otherwise(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            out = []
            for text in b.column("text").to_pylist():
                w = [x for c in text.split() for x in words_of(c)]
                step = max(1, -(-len(w) // words_per_doc))
                out.append(w[::step])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("u"), pa.array(out, pa.list_(pa.binary()))],
                                             names=["lang", "u", "words"])

    got = (rows.withColumn("u", unit).where((F.col("u") < limit) & F.col("text").isNotNull())
           .select("lang", "u", "text").mapInArrow(run, "lang string, u double, words array<binary>").collect())
    out: dict[str, list[bytes]] = {k: [] for k in counts}
    taken = dict.fromkeys(counts, 0)
    for r in sorted(got, key=lambda r: (r["lang"], r["u"], [bytes(w) for w in r["words"]])):
        if taken[r["lang"]] < docs_per_language:
            out[r["lang"]] += [bytes(w) for w in r["words"]]
            taken[r["lang"]] += 1
    return out


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      docs_per_language: int = 150, words_per_doc: int = 300, key_col: str | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per input row.

    Rows whose crc32 of the id as text leaves 2 modulo 4 are held out; the network learns
    from text and non-null language of the other rows only.  ``und`` with score 0 stands for
    a null text, one without letters, or a table with nothing to learn from.  Rows with a null
    id are not held out, but nothing is learnt from them either.  Ties go to the label that sorts first.
    With ``key_col``, that column stands for the id in the result; the split still goes by the id.
    """
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, key=key_col or id_col).withColumn(
        "fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4)
    labels, net = [], None
    sample = training_sample(d.where("fold <> 2 and lang is not null"), docs_per_language, words_per_doc)
    if any(sample.values()):
        labels, net = train(sample)
    schema = T.StructType([T.StructField("doc_id", d.schema["key"].dataType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net, len(labels)) if net else None
        for b in slices(batches, "text", 4 << 20):
            pred, score = [], []
            sums = reader.documents(b.column("text").to_pylist()) if reader else np.zeros((b.num_rows, 1))
            for row in sums:
                if row[-1] == 0:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                else:
                    p = row[:-1] / row[-1]
                    k = int(np.argmax(p))
                    pred.append(labels[k])
                    score.append(round(min(1.0, float(p[k])), 6))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()),
                                              pa.array(score, pa.float64())], names=schema.names)

    return d.select(F.col("key").alias("doc_id"), F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(run, schema)
