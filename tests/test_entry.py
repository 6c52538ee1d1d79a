"""The registry: names, guards, and each query's rows against its SQL on the smallest data."""

from __future__ import annotations

import importlib
import importlib.util
import sys

import pytest

import __spark_entry__ as entry
from siftlog.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    return "" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_match_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_training_data_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("siftlog.llm.queries", "corpus_pipeline") else find(n, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    bare = importlib.import_module("__spark_entry__")
    assert "pipeline" not in bare.queries() and not any(n.startswith("op") for n in bare.queries()) and "e1_confusion_metrics" in bare.queries()


def test_streamed_and_table_scores_agree(spark):
    streamed = registry.QUERIES["x1_streamed_scoring"](spark, SF)
    from siftlog.schema import security_events
    from siftlog.streaming.events import scored

    assert sorted(streamed.collect()) == sorted(scored(security_events(spark, SF)).collect())


def test_predictions_do_not_change_with_time(spark):
    rows = registry.QUERIES["k8_time_independence"](spark, SF).collect()
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert all(r["changed"] == 0 and r["n"] == r["shifted"] for r in rows)
