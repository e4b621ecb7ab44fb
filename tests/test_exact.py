from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stallwise.functions import exact


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat, are negative, zero and large."""
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.integers(-50, 50, 400), rng.integers(0, 10**9, 300), np.zeros(100), rng.normal(0, 1, 200)]).astype(float)
    k = np.where(rng.random(v.size) < 0.7, "hot", rng.choice(["a", "b", "c"], v.size))
    pdf = pd.DataFrame({"k": k, "v": v})
    pdf.loc[5, "k"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("k", F.col("k")).union(spark.createDataFrame([("a", None)], "k string, v double"))


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: r for r in exact.quantiles(df, ["k"], "v", probs).collect()}
    for key, grp in pdf.groupby("k", dropna=False):
        row = got[None if pd.isna(key) else key]
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(grp["v"], p), rel=1e-12, abs=1e-12)


def test_global_quantile_and_position(skewed):
    pdf, df = skewed
    assert exact.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.quantile(pdf["v"], 0.5))
    upper = exact.positions(df, [], "v", {"u": F.floor(F.col("n") / 2)}).first()["u"]
    assert upper == np.sort(pdf["v"])[len(pdf) // 2]


def test_average_ranks_equal_pandas(skewed):
    pdf, df = skewed
    got = {(r["k"], r["v"]): r["avg_rank"] for r in exact.average_ranks(df, ["k"], "v").collect()}
    ranks = pdf.groupby("k", dropna=False)["v"].rank(method="average")
    for k, v, r in zip(pdf["k"], pdf["v"], ranks):
        assert got[(None if pd.isna(k) else k, v)] == r


def test_no_window_spans_a_key(skewed):
    _, df = skewed
    plan = exact.ranked(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan


def test_close_values_are_spread_over_many_tasks(spark):
    """A million distinct doubles between 0.5 and 0.51: no bucket holds more than a small share of them."""
    n = 1_000_000
    df = spark.range(n).select((F.lit(0.5) + F.pmod(F.col("id") * 7919, F.lit(n)) / F.lit(n * 100.0)).alias("v"))
    splits = df.agg(F.array_distinct(F.percentile_approx("v", exact._steps(exact.SPLITS), F.lit(exact.ACCURACY))).alias("s")).first()["s"]
    assert len(splits) > exact.SPLITS * 0.9
    values = 0.5 + np.arange(n) / (n * 100.0)
    assert np.bincount(np.searchsorted(np.array(splits), values)).max() < n / 50
    got = exact.quantiles(df, [], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_positions_outside_and_names_of_keys(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 2, None), (1, 3, 7.0)], "_x int, i int, v double")
    got = {r["i"]: (r["first"], r["none"]) for r in exact.positions(df, ["i"], "v", {"first": F.lit(0), "none": F.col("n")}).collect()}
    assert got == {2: (5.0, None), 3: (7.0, None)}
    assert exact.quantiles(df.limit(0), ["i"], "v", {"m": 0.5}).count() == 0
