"""Price paths against the benchmark on odd rows, as their SQL has them."""

import datetime
import math

import pytest

import __spark_entry__ as entry

DAY = datetime.datetime(2024, 1, 1)
#: l_suppkey, day, price (quantity 1); null prices and dates, first prices that are null, zero or negative.
ROWS = [
    (1, 0, 10.0), (1, 1, 12.0), (1, 2, 9.0), (1, None, 50.0),
    (2, 0, None), (2, 1, 5.0), (2, 2, 6.0),
    (3, 1, 0.0), (3, 2, 4.0), (3, 3, None), (3, 4, 8.0),
    (4, 0, -2.0), (4, 1, 3.0), (4, 4, 6.0),
    (5, None, 7.0),
]


def test_odd_first_values_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(n, n, key, 1, 1.0, price, None if day is None else DAY + datetime.timedelta(days=day)) for n, (key, day, price) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = entry.queries()["attach_benchmark"](spark, str(tmp_path))
    found = con.execute(entry.oracle_sql()["attach_benchmark"])
    names = [d[0] for d in found.description]
    clean = lambda row: tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)
    want = sorted((clean(r) for r in found.fetchall()), key=str)
    assert sorted((clean(r) for r in got.select(*names).collect()), key=str) == want
    assert len(want) == 13
