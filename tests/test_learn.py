from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import learn as L, stats as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 100, 600), rng.choice([10, 70, 90], 600)
    p = 1 / (1 + np.exp(-(0.06 * a + 0.01 * b - 4)))
    total = np.where(rng.random(600) < p, 150, 20)
    out = [(f"k{i}", int(x), int(y), int(x), int(t)) for i, (x, y, t) in enumerate(zip(a, b, total))]
    return spark.createDataFrame(out, "app_key string, a int, b int, viability int, total_purchases int"), a, b, (total >= 100).astype(float)


def newton(x, y):
    """Logistic fit with an L2 term of weight 1 on the slopes."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, pen = np.zeros(x1.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        w -= np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + pen, x1.T @ (p - y) + pen @ w)
    return w


def test_counted_fit_equals_the_fit_on_rows(rows):
    df, a, _, y = rows
    model = L.fit(L.counted(df, ["viability"]), ["viability"])
    want = newton(a[:, None].astype(float), y)
    assert model.coefficients[0] == pytest.approx(want[0], rel=1e-3) and model.intercept == pytest.approx(want[1], rel=1e-3)


def test_standardised_importance(rows):
    df, a, b, y = rows
    x = np.column_stack([(a - a.mean()) / a.std(), (b - b.mean()) / b.std()])
    want = newton(x, y)
    got = {r["component"]: r["coefficient"] for r in L.component_importance(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(want[0], rel=2e-3) and got["b"] == pytest.approx(want[1], abs=2e-3)


def test_auc_and_mann_whitney(rows):
    df, a, _, y = rows
    labelled = df.withColumn("label", (F.col("total_purchases") >= 100).cast("int"))
    pos, neg = a[y == 1], a[y == 0]
    u = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).sum()
    assert S.auc(labelled, {"a": F.col("a")}).first()["auc"] == pytest.approx(u / (len(pos) * len(neg)), abs=1e-6)
    assert S.mann_whitney(labelled, "a").first()["u"] == pytest.approx(u)


def test_cross_validation_covers_both_models(rows):
    got = {r["model"]: r["mean_auc"] for r in L.cv_auc(rows[0], ["a", "b"]).collect()}
    assert set(got) == {"single", "multi"} and all(0.7 < v < 1 for v in got.values())


def test_upper_tail(spark):
    z = [0.0, 1.959964, -1.0, 3.0]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in z], "z double").select(S.upper_tail(F.col("z"))).collect()]
    assert got == pytest.approx([0.5, 0.025, 0.841344746, 0.001349898], abs=1e-6)


def test_folds_are_those_of_an_unshuffled_stratified_split(spark):
    """Round robin over the sorted labels gives each fold's share of a class; a class fills the folds in order."""
    rng = np.random.default_rng(2)
    y = rng.choice([0, 1, 2], 83, p=[0.6, 0.3, 0.1]).tolist()
    rows = spark.createDataFrame([(f"k{i:03d}", v) for i, v in enumerate(y)], "app_key string, label int").repartition(4)
    seen = list(dict.fromkeys(y))
    coded = sorted(seen.index(v) for v in y)
    want = {}
    for c, v in enumerate(seen):
        sizes = [coded[i::5].count(c) for i in range(5)]
        folds = [i for i, s in enumerate(sizes) for _ in range(s)]
        want |= {f"k{i:03d}": f for i, f in zip([i for i, x in enumerate(y) if x == v], folds)}
    assert {r["app_key"]: r["fold"] for r in L.stratified_folds(rows).collect()} == want


def test_the_gradient_is_zero_at_the_fit(rows):
    w = L.standardised(L.counted(rows[0], ["a", "b"]), ["a", "b"])
    assert max(map(abs, L.gradient(w, L.fit(w, ["a", "b"])))) < 1e-8


def test_fit_without_one_class_and_with_constant_columns(spark):
    flat = spark.createDataFrame([("a", 1, 5, 0), ("b", 1, 5, 0)], "app_key string, a int, viability int, total_purchases int")
    model = L.fit(L.standardised(L.counted(flat, ["a"]), ["a"]), ["a"])
    assert model.coefficients == (0.0,) and model.intercept < -1
