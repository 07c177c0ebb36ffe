import importlib.util
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "original_id", "title", "registration_date", "restriction"] and df.count() > 0


@needs_data
def test_queries_give_the_same_as_their_sql(spark):
    """A handful here; all are compared by the driver at a larger size."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    for q in ("p1_found", "archive_years", "org_stats", "fts_phrase", "file_depths", "topic_components", "upsert_by_url"):
        df = entry.queries()[q](spark, DATA)
        order = sorted(df.columns)
        got = sorted(repr(tuple(str(r[c]) for c in order)) for r in df.collect())
        want = con.execute(f"select {', '.join(order)} from ({entry.oracle_sql()[q]})").fetchall()
        assert got == sorted(repr(tuple(str(v) for v in r)) for r in want), q


def test_core_stands_without_the_text_operators():
    for module in entry.MODULES:
        assert "llm" not in module
    root = os.path.dirname(importlib.util.find_spec("regispark").origin)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "regispark.llm" not in f.read(), n
