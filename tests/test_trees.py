"""Boosted trees with patience on the valid rows."""

import numpy as np
import pytest

from barloom.operators import models


def test_stop_round():
    assert models.stop_round([5, 4, 3, 4, 4, 2], 3) == 6
    assert models.stop_round([5, 4, 3, 4, 4, 2], 2) == 3
    assert models.stop_round([3, 3, 3], 1) == 1
    assert models.stop_round([], 2) == 1
    assert models.stop_round([float("nan"), 2.0], 5) == 2


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.3 * x[:, 1] + rng.normal(scale=1.5, size=900)
    days = [f"2024-01-{1 + i // 50:02d}" for i in range(900)]
    rows = [(d, f"s{i % 50}", *map(float, v), float(t)) for i, (d, v, t) in enumerate(zip(days, x, y))]
    df = spark.createDataFrame(rows, "date string, instrument string, a double, b double, c double, label double")
    return df.withColumn("date", df["date"].cast("date"))


def test_model_ends_at_the_least_loss(spark, panel):
    prepared = models.prepare(panel, ["a", "b", "c"], "2024-01-09", "2024-01-13").persist()
    whole = models.boosted_trees(rounds=12, depth=5).setStepSize(0.5)
    model = models.fit(prepared, whole, patience=12)
    losses = whole.fit(prepared.where("split = 'train'")).evaluateEachIteration(prepared.where("split = 'valid'"), "squared")
    n = model.getNumTrees
    assert n == int(np.argmin(losses)) + 1 < 12
    # its own predictions have that loss
    rows = model.transform(prepared.where("split = 'valid'")).select("label", "predict").collect()
    assert np.mean([(r.label - r.predict) ** 2 for r in rows]) == pytest.approx(min(losses))
    weight = {r.feature: r.importance for r in models.importances(model, ["a", "b", "c"], spark).collect()}
    assert max(weight, key=weight.get) == "a" and sum(weight.values()) == pytest.approx(1)
    assert models.first_trees(model, n + 3) is model
    prepared.unpersist()


def test_without_valid_rows(panel):
    got = models.fit_predict(panel, ["a", "b", "c"], "2024-01-13", "2024-01-13", models.boosted_trees(rounds=3, depth=2))
    assert got.count() == 250 and got.columns == ["date", "instrument", "predict"]


def test_unused_features_have_no_importance(spark, panel):
    flat = panel.selectExpr("date", "instrument", "a", "0D AS b", "0D AS c", "label")
    prepared = models.prepare(flat, ["a", "b", "c"], "2024-01-09", "2024-01-13")
    model = models.first_trees(models.fit(prepared, models.boosted_trees(rounds=3, depth=2), patience=3), 1)
    assert {r.feature: r.importance for r in models.importances(model, ["a", "b", "c"], spark).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_training_goes_on_while_patience_lasts(panel, monkeypatch):
    """Rounds are trained until patience runs out, not all of them, and the model is that of all rounds."""
    prepared = models.prepare(panel, ["a", "b", "c"], "2024-01-09", "2024-01-13").persist()
    whole = models.boosted_trees(rounds=40, depth=3).setStepSize(0.3)
    valid = prepared.where("split = 'valid'")
    losses = whole.fit(prepared.where("split = 'train'")).evaluateEachIteration(valid, "squared")
    trained, fit = [], models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, df: trained.append(self.getMaxIter()) or fit(self, df))
    for patience in (1, 4, 50):
        trained.clear()
        model = models.fit(prepared, whole, patience=patience)
        best = models.stop_round(losses, patience)
        assert model.getNumTrees == best
        assert models.stop_round(model.evaluateEachIteration(valid, "squared"), patience) == best
        assert trained[-1] == 40 or patience <= trained[-1] - best and trained[-1] <= 2 * (best + patience)
        assert trained == sorted(set(trained)) and trained[0] == min(40, 2 * patience)
    prepared.unpersist()


def test_queries_train_to_the_defaults(monkeypatch):
    """Neither rounds nor depth of the registered queries are cut, and patience is that of the model's own default."""
    from types import SimpleNamespace

    from barloom.jobs import research

    seen = []
    frame = SimpleNamespace(persist=lambda: frame, unpersist=lambda: None)
    monkeypatch.setattr(research, "features", lambda *a: None)
    monkeypatch.setattr(research, "bars", lambda *a: None)
    monkeypatch.setattr(research, "_bounds", lambda *a: ("2024-01-09", "2024-01-13"))
    monkeypatch.setattr(models, "prepare", lambda *a: frame)
    monkeypatch.setattr(models, "fit", lambda df, estimator: seen.append(estimator))
    monkeypatch.setattr(models, "fit_predict", lambda df, names, a, b, estimator: seen.append(estimator))
    monkeypatch.setattr(models, "importances", lambda *a: None)
    monkeypatch.setattr(models, "top_importances", lambda *a: None)
    research.tree_importances(None, "")
    research.trees(None, "")
    assert [(e.getMaxIter(), e.getMaxDepth()) for e in seen] == [(1000, 6)] * 2
