import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["at09_mart_attribution", "w06_flatten_events", "v07_first_last_touch", "d03_flag_adgroup", "g01_segment_features", "l03_chronological_split", "c08_blind_scorecard", "f04_pooled_lift",
          "r03_best_reply", "k06_gap_verdicts", "b02_bench_todo", "u02_usage_calls", "p06_find_claims", "e02_rule_score", "o01_best_run_per_day"]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200 and all(callable(f) for f in q.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["channel", "first_touch", "last_touch", "time_decay", "last_touch_nd"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.cross_check import rows
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_entry_without_the_optional_subpackage(monkeypatch):
    import importlib
    import sys
    for name in ("corpus_pipeline", "tidemark.llm", "tidemark.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    bare = importlib.reload(entry)
    try:
        assert bare.corpus is None and len(bare.queries()) > 200 and "pipeline" not in bare.queries() and set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
