"""The pipeline's stages against the operators' decisions and brute force, and the queries at the smallest scale."""

import random
import re

import pytest

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import op2_langid, op10_decontaminate
from tests.conftest import SF001
from tests.llm import data


def test_queries_are_registered():
    names = [k for k in E.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and len(corpus_pipeline.STAGES) == 5


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF001)
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        out[name] = got
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert out["language ID"] == {i: t for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    ids = sorted(out["language ID"])
    root = data.hamming_groups([data.simhash(rows[i]) for i in ids])
    assert sorted(out["SimHash near-dedup"]) == [i for k, i in enumerate(ids) if root[k] == k]
    items = [r["text"] for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    sh = lambda t: set(op10_decontaminate.shingles(data.PLAIN.findall(t.translate(data.LOWER)), 5))
    wanted = [sh(t) for t in items]
    clean = {i for i, t in out["SimHash near-dedup"].items()
             if not any(q and len(q & sh(t)) >= 0.8 * len(q) for q in wanted)}
    assert set(out["benchmark decontamination"]) == clean == set(out["secret scans"])
    assert not any(re.search(r"token = \"?[0-9a-f]{20}", t) for t in out["secret scans"].values())
    final = corpus_pipeline.run(spark, SF001)
    assert {r["doc_id"] for r in final.collect()} == clean and final.columns[0] == "doc_id"


@pytest.mark.parametrize("rows", [[], [(0, None, None, None, None), (None, "alpha beta", "en", "s", 10), (0, None, None, None, None)]])
def test_stages_take_empty_and_null_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF001).count() <= len(rows)


def test_rows_without_an_own_id_are_judged_one_by_one(spark):
    item = spark.read.parquet(f"{SF001}/benchmark.parquet").first()["text"]
    rng = random.Random(8)
    texts = [data.prose(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip([None] * 6 + [7] * 6, texts)]
    bad = [(i, t, None, "s", 3) for i in (None, 7) for t in ("123", f"before it {item} after it")]
    copies = [(None, texts[0], "en", "s", 1), (5, texts[1], "en", "s", 2), (9, texts[7], "en", "s", 3), rows[2], rows[8]]
    docs = spark.createDataFrame(rows + bad + copies, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["text"] for r in corpus_pipeline.language(spark, docs, SF001).collect()]
    assert sorted(got) == sorted(r[1] for r in rows + bad + copies if r[1] != "123")
    clean = corpus_pipeline.decontaminate(spark, docs, SF001)
    assert sorted(r["text"] for r in clean.collect()) == sorted(r[1] for r in rows + copies + [bad[0], bad[2]])
    kept = corpus_pipeline.near_dedup(spark, docs, SF001)
    assert kept.columns == docs.columns
    out = [(r["text"], r["doc_id"]) for r in kept.collect() if r["text"] in texts]
    assert len(out) == 12 and dict(out) == dict(zip(texts, [None, 5] + [None] * 4 + [7] * 6))


def test_held_out_accuracy(spark):
    sf = SF001.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op2_langid.identify_language(docs).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert n > 100 and right / n > 0.97
