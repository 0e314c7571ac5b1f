"""Rules over facts, group gaps, exact stratified splits and encoding detection."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import bi, eda, ml
from tessera.operators.domains import sales
from tessera.operators.rules import FACTS, RECOMMENDED, STATISTICS_RULES, Rule, facts, fired
from tessera.sources import files


@pytest.mark.parametrize("rule", [*STATISTICS_RULES, *RECOMMENDED], ids=lambda r: r.name)
def test_every_rule_fires_and_does_not(spark, rule):
    def subject(name, values):
        return [(rule.scope, name, f, float(v), None) for f, v in values.items()]

    met = {f: lo if lo > 0 else hi for f, lo, hi in rule.conditions}
    rows = subject("yes", met)
    for f, lo, hi in rule.conditions:  # one condition missed at a time, and one without the fact
        rows += subject(f"below {f}", {**met, f: lo - 1}) + subject(f"without {f}", {k: v for k, v in met.items() if k != f})
    rows += [("elsewhere", "yes", f, float(v), None) for f, v in met.items()]
    got = fired(spark.createDataFrame(rows, FACTS), [rule]).collect()
    assert [(r["rule"], r["scope"], r["column"]) for r in got] == [(rule.name, rule.scope, "yes")] and got[0]["text"]


def test_sentences_name_facts(spark):
    df = spark.createDataFrame([("a", 1.23456, "high"), ("b", 0.1, None)], "c string, x double, l string")
    known = facts(df, "s", F.col("c"), x=F.col("x"), level=F.col("l"))
    rules = [Rule("r", "s", (("x", 0, 9),), "{column}: {x} {x:4} {level.label} {nothing}"), Rule("never", "s", (("x", 10, 11),), "")]
    assert {r["text"] for r in fired(known, rules).collect()} == {"a: 1.23 1.2346 high ", "b: 0.10 0.1000  "}
    assert fired(spark.createDataFrame([], FACTS), rules).count() == 0


def test_statistics_insights_follow_the_table(spark):
    df = spark.range(6000).select(F.col("id").cast("double").alias("level"), (F.col("id") * 2.0 + F.col("id") % 3).alias("amount"),
                                  F.when(F.col("id") % 50 > 0, F.exp(F.col("id") / 900.0)).alias("cost"),
                                  F.concat(F.lit("c"), F.col("id").cast("string")).alias("label"))
    out = eda.stats_analyze(df)
    got = {(r["rule"], r["column"]) for r in out["insights"].collect()}
    assert {("skewed", "cost"), ("missing", "dataset"), ("high_cardinality", "dataset")} <= got
    assert not any(c == "amount" and rule == "skewed" for rule, c in got) and sum(rule == "linked" for rule, _ in got) >= 1
    assert {r["analysis"] for r in out["recommended_analyses"].collect()} >= {"regression", "rank tests", "group comparison"}
    words = spark.createDataFrame([("x",), ("y",)] * 5, "word string")
    plain = eda.stats_analyze(words)
    assert [r["analysis"] for r in plain["recommended_analyses"].collect()] == ["exploration"] and plain["insights"].count() == 0


def test_group_gap_with_one_group_two_groups_and_ties(spark):
    def gap(rows):
        got = bi.group_gap(spark.createDataFrame(rows, "name string, mean double")).collect()
        return tuple(got[0]) if got else None

    assert gap([]) is None and gap([("a", 1.0)]) is None and gap([("a", 1.0), ("b", None)]) is None
    assert gap([("a", 3.0), ("b", -2.0)]) == (2, "a", 3.0, "b", -2.0, 5.0, 250.0)
    assert gap([("b", 3.0), ("a", 3.0), ("c", 0.0), ("d", 0.0)]) == (4, "a", 3.0, "d", 0.0, 3.0, 0.0)
    assert gap([("b", 1.0), ("a", 1.0)])[:5] == (2, "a", 1.0, "b", 1.0)
    one = sales.margin_by_segment(spark.createDataFrame([("s", 2.0), (None, 9.0), ("s", None)], "g string, m double"), "g", "m").collect()
    assert [tuple(r) for r in one] == [("s", 1, 2.0, 0.0, "best")]
    assert sales.margin_by_segment(spark.createDataFrame([], "g string, m double"), "g", "m").count() == 0


def test_split_is_exact_in_every_class(spark):
    df = spark.range(5003).select("id", F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, "mid").when(F.col("id") < 60, "rare").otherwise("few").alias("y"))
    df = df.unionByName(df.where("id < 7")).unionByName(spark.createDataFrame([(9000, None)], "id long, y string"))
    split = ml._split_cols(df, ["id"], "y")
    assert split.count() == df.count() and set(split.columns) == {"id", "y", "is_test", "fold"}
    for r in split.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert abs(r["t"] - 0.2 * r["n"]) <= 0.5
    per = {}
    for r in split.where("not is_test").groupBy("y", "fold").count().collect():
        per.setdefault(r["y"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per.values()) and len(per["hot"]) == 5
    again = ml._split_cols(df.repartition(5), ["id"], "y")
    assert split.where("is_test").select("id", "y").exceptAll(again.where("is_test").select("id", "y")).count() == 0
    plain = ml._split_cols(df, ["id"], "id", stratify=False).agg(F.count_if("is_test").alias("t"), F.count(F.lit(1)).alias("n")).first()
    assert plain["t"] == round(0.2 * plain["n"])
    many = ml._split_cols(spark.range(1000), ["id"], "id")  # more classes than are split one by one
    assert many.where("is_test").count() == 200


@pytest.mark.parametrize("enc,mark,found", [("utf-8", b"", "UTF-8"), ("utf-8", b"\xef\xbb\xbf", "UTF-8"), ("latin-1", b"", "ISO-8859-1"),
                                            ("utf-16-le", b"\xff\xfe", "UTF-16"), ("utf-16-be", b"\xfe\xff", "UTF-16")])
def test_encodings_are_found_by_their_bytes(spark, tmp_path, enc, mark, found):
    path = tmp_path / "t.csv"
    path.write_bytes(mark + "name|size|sign\ncafé|12|ß\nnaïve|7|x\n".encode(enc))
    assert files.sniff_csv(spark, str(path)) == (found, "|")
    got = files.load_file(spark, str(path))
    assert got.columns == ["name", "size", "sign"] and [tuple(r) for r in got.orderBy("size").collect()] == [("naïve", 7, "x"), ("café", 12, "ß")]


def test_encoding_of_cut_and_empty_heads(spark, tmp_path):
    whole = ("a;b\n" + "é" * files.HEAD_BYTES).encode()
    assert files.detect_encoding(whole[:files.HEAD_BYTES]) == "UTF-8"  # cut within a letter or not
    assert files.detect_encoding((b"a" + whole)[:files.HEAD_BYTES]) == "UTF-8" and files.detect_encoding(b"ab\xc3") == "ISO-8859-1"
    empty = tmp_path / "e.csv"
    empty.write_bytes(b"")
    with pytest.raises(files.LoadError):
        files.sniff_csv(spark, str(empty))


class _Broken:
    def __init__(self, error):
        self.error = error

    def fit(self, rows):
        raise self.error


def test_a_failed_fit_is_no_result(spark, monkeypatch):
    """Lost work is raised; a model that the rows do not allow has its error and no scores, and stops reports without that column."""
    from pyspark.errors import IllegalArgumentException
    from tessera.plans import queries_extra2
    df = spark.createDataFrame([(i, "yes" if i % 3 else "no", float(i % 7)) for i in range(60)], "id long, y string, x double")
    sound = ml._models("classification", 2, 0.0)["Logistic Regression"]

    def train(error):
        monkeypatch.setattr(ml, "_models", lambda *a: {"Logistic Regression": sound, "Broken": _Broken(error)})
        return ml.train_models(df, "y", ["x"], ["id"], task="classification", folds=2)
    with pytest.raises(RuntimeError, match="Broken: fit"):
        train(RuntimeError("executor lost"))
    res = train(IllegalArgumentException("not for these rows"))[0]
    row = {r["name"]: r for r in res.collect()}
    assert row["Logistic Regression"]["is_best"] and row["Broken"]["train_error"] == "not for these rows"
    assert all(row["Broken"][c] is None for c in ("cv_score", "cv_std", "train_score", "test_score", "overfit_gap", "f1"))
    monkeypatch.setattr(queries_extra2, "_fit", lambda *a, **k: (res, None, None, None))
    for query in (queries_extra2.q_m9, queries_extra2.q_m10):
        with pytest.raises(ValueError, match="Broken was not fitted"):
            query(spark, "")
    assert ml.all_fitted(res.where("train_error IS NULL")).count() == 1
