"""Driver contract of __spark_entry__: consistent query / oracle keys, entry schema."""

import re

import __spark_entry__ as E


def test_every_oracle_has_a_query_and_keys_are_well_formed():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 240
    for k in q:
        if re.match(r"^op[0-9]+_|^pipeline$", k):  # training-data operators, present only with their folder
            continue
        assert re.match(r"^[A-Z][0-9]+(_[A-Za-z0-9]+)+$", k), k
        assert not k.lower().startswith("op"), k
    for sql in o.values():
        assert sql.strip()


def test_entry_returns_pareto_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "name", "value", "pct_of_total", "cumulative_pct", "in_top_20",
                          "top_groups_share", "pareto_holds"]
    assert df.count() > 0
