"""The entry module: names, oracles, and a few queries against their SQL on the smallest tables."""

import math
import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) > 100
    assert all(callable(q) for q in queries.values())


def _rows(rows):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 4) + 0.0 if isinstance(v, float) else str(v)
    return Counter(tuple(clean(v) for v in r) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["ic_summary", "ts_rank", "cs_resid", "factor_rsi_14", "group_return", "weight_returns", "risk_metrics", "positions", "blotter", "daily_book", "sell_fee"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(DATA / f"{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert _rows(df.select(*columns).collect()) == _rows([[r[i] for i in at] for r in found.fetchall()])


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 1
