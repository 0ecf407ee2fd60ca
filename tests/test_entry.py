"""Driver contract: entry runs, every SQL oracle has a query."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r.model for r in rows} == {"syscall", "network", "hybrid"}
    assert df.columns[:5] == ["model", "tn", "fp", "fn", "tp"]


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40
