"""Fill-in-the-middle, nearest neighbours and whitening against brute force, on awkward rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tessera.llm import op11_fim, op12_neighbours, op13_whitening
from tessera.llm.common import ship
from tests.llm import data

ROWS = data.documents() + [(900 + i, t, "en", "a", 1, 7, "z", "q", "f") for i, t in enumerate([
    "\n", "\n\n\n", "a\nb\nc", "a\nb\nc\n", "é\n漢字\r\n😀\n" * 3, "has <P> mark\nx", "<S>", "x<M", "<\n<\n>\nP>\nS>\n<S\n",
    "\n".join("w" * (i % 97) for i in range(5000)), "no end" * 20000])]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(ROWS, data.SCHEMA).repartition(3)


def cut_by_hand(doc_id, text):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(u), "plain", None, None, t
    if h[3] % 100 < 50:
        return doc_id, len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_op11_cuts_and_restores(docs, spark):
    want = sorted((cut_by_hand(r[0], r[1]) for r in ROWS), key=repr)
    got = sorted((tuple(r) for r in op11_fim.fill_in_middle(docs).collect()), key=repr)
    assert got == want and {"plain", "spm", "psm"} == {r[2] for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    report = sorted((tuple(r) for r in op11_fim.fim_report(docs).collect()), key=repr)
    assert [r[:5] for r in report] == [r[:5] for r in sorted(want, key=lambda r: repr(r[:5] + (sha(r[5]),)))]
    assert sorted(r[6] for r in report) == sorted(sha(r[1] or "") for r in ROWS)
    assert sorted(r[5] for r in report) == sorted(sha(r[5]) for r in want)
    assert op11_fim.fim_report(spark.createDataFrame([], data.SCHEMA)).count() == 0


@pytest.mark.parametrize("error", [1, 16, 1024])
def test_op11_rank_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(0)
    for steps in (rng.integers(0, 5, 3000), rng.integers(1, 4000, 2000), np.full(500, 7), np.zeros(40, int), np.array([], int)):
        values = np.cumsum(steps)
        index = op11_fim.RankIndex(values, error)
        ranks = np.arange(len(values))
        assert np.array_equal(index.exact(ranks), values)
        assert np.abs(values - index.predict(ranks)).max(initial=0) <= error + 1
        assert index.residuals.itemsize <= (1 if error < 127 else 2)
    assert len(op11_fim.RankIndex(np.arange(0, 70000, 7), 4).starts) == 1  # an even text is one segment


def test_op11_marker_like_seams():
    """Pieces that end or begin with parts of markers restore too (checked by hand on strings)."""
    bits = ["<", "<P", "P>", ">", "S>", "<S", "", "x"]
    for pre, mid, suf in itertools.product(bits, repeat=3):
        if any(m in pre + mid + suf for m in ("<P>", "<S>", "<M>")):
            continue
        out = f"<P>{pre}<S>{suf}<M>{mid}"
        assert out.index("<S>") == 3 + len(pre) and out.index("<M>") == 6 + len(pre) + len(suf)


def vectors():
    rng = np.random.default_rng(5)
    rows, centres = [], rng.standard_normal((6, 12))
    for i in range(600):
        v = centres[i % 6] + 0.3 * rng.standard_normal(12)
        rows.append((i, [float(np.float32(c)) for c in v * (1 + i % 5)], 1))
    same = rows[0][1]
    rows += [(1000 + i, same, 2) for i in range(90)]  # a hot vector
    rows += [(1000, same, 2), (1020, [0.0] * 12, 1), (1040, None, 1), (1060, [float("nan")] + [1.0] * 11, 1),
             (1080, [None] + [1.0] * 11, 1), (1100, [float("inf")] * 12, 1), (1120, [], 1), (None, same, 3),
             (1140, [1.0, 2.0], 1), (1140, [2.0, -1.0], None), rows[20]]
    random.Random(1).shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, u long, vec string, `Embedding2` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 6) for r in rows], SCHEMA).repartition(4)


def nearest_by_hand(rows, k=20):
    good = [(i, np.pad(np.array(v, np.float64), (0, 12 - len(v)))) for i, v, _ in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for at, (i, q) in enumerate(good):
        if i % 20 == 0:
            others = sorted((-float((q * v).sum()), j) for n, (j, v) in enumerate(good) if n != at)
            out.setdefault((i, q.tobytes()), others[:k])
    return sorted(((i, rank, j, -s) for (i, _), found in out.items() for rank, (s, j) in enumerate(found, 1)))


def test_op12_is_exact_when_windows_cover_everything(spark):
    ship(spark)
    rows = vectors()
    got = sorted(tuple(r) for r in op12_neighbours.nearest(frame(spark, rows), curves=2, block=64, recall=1.0).collect())
    want = nearest_by_hand(rows)
    assert len(got) == len(want) and [r[:2] for r in got] == [r[:2] for r in want]
    hit = len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want})
    assert hit >= 0.95 * len({r[:1] + r[2:3] for r in want})
    wide = sorted(tuple(r) for r in op12_neighbours.nearest(frame(spark, rows), block=4096).collect())
    assert [r[:3] for r in wide] == [r[:3] for r in want]  # ties to the smaller id, copies as candidates of each other
    assert np.allclose([r[3] for r in wide], [r[3] for r in want], rtol=1e-13)
    hot = [r for r in wide if r[0] == 1000]
    assert [r[2] for r in hot][:3] != [1000, 1000, 1000]


def test_op12_recall_with_narrow_windows(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    rows = [(i, [float(c) for c in centres[i % 40] + 0.1 * rng.standard_normal(16)], 0) for i in range(4000)]
    got = {}
    for r in op12_neighbours.nearest(frame(spark, rows), block=64, sample=64).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {}
    for q, _, j, _ in nearest_by_hand_fast(rows):
        want.setdefault(q, set()).add(j)
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.9


def nearest_by_hand_fast(rows):
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    for i in range(0, len(rows), 20):
        s = x @ x[i]
        s[i] = -np.inf
        for rank, j in enumerate(np.lexsort((np.arange(len(rows)), -s))[:20], 1):
            yield i, rank, int(j), s[j]


def test_op12_few_rows_and_none(spark):
    two = [(0, [1.0, 0.0], 0), (7, [2.0, 0.0], 0), (8, [-1.0, 0.0], 0)]
    got = sorted(tuple(r) for r in op12_neighbours.nearest(frame(spark, two)).collect())
    assert got == [(0, 1, 7, 2.0), (0, 2, 8, -1.0)]
    assert op12_neighbours.nearest(frame(spark, [])).count() == 0
    assert op12_neighbours.nearest(frame(spark, [(0, None, 0), (20, [0.0], 1)])).count() == 0
    assert op12_neighbours.nearest(frame(spark, [(0, [3.0], 0)])).count() == 0


@pytest.mark.parametrize("axes,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_op12_hilbert_is_one_unbroken_path(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = op12_neighbours.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def whitened_by_hand(rows, most=4):
    good = [(i, v) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    width = max(len(v) for _, v in good)
    x = [[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[n * c - t for c, t in zip(v, s)] for v in fit], dtype=object)
    v = np.array([[float(int(a)) / n ** 3 for a in row] for row in z.T @ z])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u.T[::-1][:most]
    u *= np.sign(u[np.arange(len(u)), np.abs(u).argmax(axis=1)])[:, None]
    for (i, _), r in zip(good, x):
        own = [n * c - t for c, t in zip(r, s)]
        for k in range(len(e)):
            yield (i, k + 1, n, sum(t * t for t in own), float(np.dot([t / n for t in own], u[k]) / e[k] ** 0.5), e[k] / np.trace(v))


def test_op13_matches_brute_force(spark):
    ship(spark)
    rows = vectors()
    got = sorted((tuple(r) for r in op13_whitening.whiten(frame(spark, rows)).collect()), key=repr)
    want = sorted(whitened_by_hand(rows), key=repr)
    order = lambda r: (repr(r[0]), r[1], r[3], round(r[4], 6))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert max(r[6] for r in got) < 1e-9 and all(r[3] == r[7] for r in got)


def test_op13_edges(spark):
    flat = op13_whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)])).collect()
    assert len(flat) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in flat)
    assert op13_whitening.whiten(frame(spark, [])).count() == 0
    assert op13_whitening.whiten(frame(spark, [(1, None, 0), (2, [None], 0), (3, [], 0)])).count() == 0
    line = op13_whitening.whiten(frame(spark, [(i, [float(i), 0.0, 1.0], 0) for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-12
    huge = op13_whitening.whiten(frame(spark, [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.5, 3.0], 0)])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None and r["n"] == 3 for r in huge if r["vec_id"] < 3)


@pytest.mark.parametrize("most", [3, 1 << 23, 1 << 46, 1 << 60])
def test_op13_square_sums_are_exact(most):
    w = np.random.default_rng(1).integers(-most, most, (op13_whitening.ROWS, 3))
    assert op13_whitening.exact_square_sums(w) == [sum(v * v for v in c) for c in w.T.tolist()]
    assert op13_whitening.exact_column_sums(w) == [sum(c) for c in w.T.tolist()]
    assert op13_whitening.centred(w, 10 ** 6, [5, 6, 7]).tolist() == [[10 ** 6 * v - s for v, s in zip(r, (5, 6, 7))] for r in w.tolist()]
