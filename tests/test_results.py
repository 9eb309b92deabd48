"""The store of results: whole runs or none, reruns, readers, and the research job on it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.jobs import research
from barloom.sources import panel as panels
from barloom.sources import results


def put(spark, base, run_id, nav, extra=None):
    with results.Run(spark, base, run_id) as run:
        run.put("nav", spark.createDataFrame([(dt.date(2020, 1, 1), v) for v in nav], "date date, nav double"))
        run.put("metrics", spark.createDataFrame([("n", float(len(nav)))], "metric string, value double") if extra is None else extra)
    return run


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    base = str(tmp_path / "r")
    assert results.runs(spark, base).count() == 0
    put(spark, base, "one", [1.0, 2.0])
    broken = results.Run(spark, base, "two")
    broken.put("nav", spark.createDataFrame([(dt.date(2020, 1, 1), 9.0)], "date date, nav double"))
    assert {r.run_id for r in results.read_results(spark, base, "nav").collect()} == {"one"}
    with pytest.raises(ValueError):
        results.read_results(spark, base, "nav", ["two"])
    broken.commit()
    assert {r.run_id for r in results.read_results(spark, base, "nav").collect()} == {"one", "two"}
    assert {r.table_name: r.n_rows for r in results.runs(spark, base).where("run_id = 'one'").collect()} == {"nav": 2, "metrics": 1}
    with pytest.raises(ValueError):
        broken.put("late", spark.range(1))


def test_an_error_inside_a_run_leaves_the_last_one(spark, tmp_path):
    base = str(tmp_path / "r")
    put(spark, base, "one", [1.0])
    with pytest.raises(RuntimeError), results.Run(spark, base, "one") as run:
        run.put("nav", spark.createDataFrame([(dt.date(2020, 1, 1), 5.0)], "date date, nav double"))
        raise RuntimeError("lost")
    assert [r.nav for r in results.read_results(spark, base, "nav").collect()] == [1.0]
    assert results.vacuum(spark, base, "one") == 1
    assert [r.nav for r in results.read_results(spark, base, "nav").collect()] == [1.0]


def test_a_rerun_takes_the_place_of_a_run_and_of_no_other(spark, tmp_path):
    base = str(tmp_path / "r")
    put(spark, base, "one", [1.0])
    put(spark, base, "two", [7.0])
    put(spark, base, "one", [2.0, 3.0])
    assert sorted((r.run_id, r.nav) for r in results.read_results(spark, base, "nav").collect()) == [("one", 2.0), ("one", 3.0), ("two", 7.0)]
    assert results.vacuum(spark, base, "one") == 2 and results.vacuum(spark, base, "one") == 0
    assert results.read_results(spark, base, "nav").count() == 3
    results.drop_run(spark, base, "one")
    assert {r.run_id for r in results.read_results(spark, base, "nav").collect()} == {"two"}


def test_tables_that_change(spark, tmp_path):
    base = str(tmp_path / "r")
    put(spark, base, "20200101", [1.0])
    put(spark, base, "20200102", [], spark.createDataFrame([("n", 1.0, "x")], "metric string, value double, note string"))
    got = {r.run_id: (r.metric, r.note) for r in results.read_results(spark, base, "metrics").collect()}
    assert got == {"20200101": ("n", None), "20200102": ("n", "x")}
    assert results.read_results(spark, base, "nav", ["20200102"]).count() == 0
    put(spark, base, "three", [1.0], spark.createDataFrame([("n", "much")], "metric string, value string"))
    with pytest.raises(ValueError):
        results.read_results(spark, base, "metrics")
    for name in ("a/b", "", "_x", "a=b"):
        with pytest.raises(ValueError):
            results.Run(spark, base, name)
    with results.Run(spark, base, "four") as run:
        run.put("nav", spark.range(1))
        for bad in (("nav", spark.range(1)), ("x", spark.range(1).withColumn("run_id", F.lit(1)))):
            with pytest.raises(ValueError):
                run.put(*bad)


def test_research_run(spark, tmp_path):
    base = str(tmp_path / "r")
    made = panels.synthetic_panel(spark, "2019-01-01", "2019-12-31", 15)
    research.research_run(made, base, "m", "momentum_20", capital=1e6)
    research.research_run(made, base, "v", "volatility_20", method="rank", groups=5, top_k=0.4, capital=1e6)
    tables = {(r.run_id, r.table_name): r.n_rows for r in results.runs(spark, base).collect()}
    assert {t for _, t in tables} == {"signals", *research.RUN_TABLES} and all(n > 0 for n in tables.values())
    nav = results.read_results(spark, base, "nav", ["m"])
    assert nav.orderBy("date").first().nav == 1.0 and nav.where("benchmark IS NULL").count() == 0
    metrics = {r.metric: r.value for r in results.read_results(spark, base, "metrics", ["m"]).collect()}
    assert {"sharpe", "var_95", "max_drawdown_days", "icir", "rank_ic_mean", "calmar", "beta"} <= set(metrics)
    first, last = nav.agg(F.min_by("nav", "date"), F.max_by("nav", "date")).first()
    assert metrics["total_return"] == pytest.approx(last / first - 1)
    assert "Group5" in results.read_results(spark, base, "layers", ["v"]).columns
    trades = results.read_results(spark, base, "trades", ["m"])
    assert trades.where("shares % 100 <> 0 OR fee < 5").count() == 0


def test_positions_of_a_run_are_folded_once_and_go_with_it(spark, tmp_path, monkeypatch):
    """Orders and book start from positions that are written: neither plan may hold their ranks and folds again."""
    base, plans = tmp_path / "r", {}
    put = results.Run.put

    def watched(run, table, df):
        plans[table] = df._jdf.queryExecution().optimizedPlan().toString()
        return put(run, table, df)

    monkeypatch.setattr(results.Run, "put", watched)
    research.research_run(panels.synthetic_panel(spark, "2019-01-01", "2019-03-31", 5), str(base), "m", "reversal_5", capital=1e6)
    for table in ("trades", "nav"):
        assert "collect_list" not in plans[table] and "row_number" not in plans[table]
    assert not list(base.rglob("*positions*/*/*/*.parquet"))


def test_rows_aside_are_no_table_and_go_after_an_error_too(spark, tmp_path):
    base = tmp_path / "r"
    with pytest.raises(ZeroDivisionError), results.Run(spark, str(base), "one") as run:
        assert run.aside("x", spark.range(3)).count() == 3
        assert list(base.rglob("_x/*/*/*.parquet"))
        1 / 0
    assert not list(base.rglob("_x/*/*/*.parquet")) and results.runs(spark, str(base)).count() == 0
