"""Logistic models of success, fitted on counted feature combinations.

Sub-scores are small integers, so equal rows are combined first and the model
is fitted with their counts as weights: the optimum is that of all rows, while
the training table stays as small as the number of combinations.

The fit is iteratively reweighted least squares: each Newton step is one
aggregation (loss, gradient, curvature) and the solution of a system as small as
the number of columns.  It minimises the log loss plus half the squared
coefficients (an L2 term with C = 1, the intercept free), and ends where the
gradient does, which ``gradient`` returns for checking.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallwise.functions.columns import rnd, safe_div
from stallwise.session import fresh_path, shared_dir

# Viabilities the probability table is shown for.
GRID = [35, 40, 42, 44, 46, 47, 48, 50, 52, 55, 60, 65]
FOLDS = 5


def labelled(bt: DataFrame) -> DataFrame:
    return bt.withColumn("label", (F.col("total_purchases") >= 100).cast("int"))


def counted(bt: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Distinct rows with their number ``w``, cut from the back-test's lineage: every fit reads it many times."""
    shared_dir(bt.sparkSession)
    return labelled(bt).groupBy(*extra, *columns, "label").agg(F.count(F.lit(1)).cast("double").alias("w")).checkpoint()


def moments(weighted: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Weighted mean and population deviation of each column; deviations are summed from the mean, not from zero."""
    w = F.col("w")
    means = weighted.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns]).first()
    squares = weighted.agg(*[(F.sum(w * (F.col(c) - F.lit(means[c])) ** 2) / F.sum(w)).alias(c) for c in columns]).first()
    return {c: (means[c] or 0.0, (squares[c] or 0.0) ** 0.5) for c in columns}


def standardised(weighted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns shifted and scaled by mean and population deviation; a constant column becomes 0."""
    m = moments(weighted, columns)
    scaled = [((F.col(c) - F.lit(m[c][0])) / F.lit(m[c][1] if m[c][1] > 1e-9 else 1.0)).alias(c) for c in columns]
    return weighted.select(*[c for c in weighted.columns if c not in columns], *scaled)


@dataclass(frozen=True)
class Logit:
    """``p = 1 / (1 + exp(-(base + sum(coefficients * (columns - centres)))))``."""

    columns: tuple[str, ...]
    centres: tuple[float, ...]
    base: float
    coefficients: tuple[float, ...]

    @property
    def intercept(self) -> float:
        """The log-odds where all columns are zero."""
        return self.base - sum(b * m for b, m in zip(self.coefficients, self.centres))

    def terms(self) -> list[Column]:
        return [F.lit(1.0), *[F.col(c) - F.lit(m) for c, m in zip(self.columns, self.centres)]]

    def log_odds(self) -> Column:
        one, *terms = self.terms()
        return sum((F.lit(float(b)) * x for b, x in zip(self.coefficients, terms)), F.lit(float(self.base)))

    def p(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))


def _state(weighted: DataFrame, model: Logit) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised loss, gradient and curvature at a model, from one aggregation."""
    w, y, p, x, z = F.col("w"), F.col("label"), model.p(), model.terms(), model.log_odds()
    k = len(x)
    # log(1 + exp(z)) without overflow.
    loss = F.sum(w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z))
    rows = weighted.agg(loss.alias("loss"), *[F.sum(w * (p - y) * x[i]).alias(f"g{i}") for i in range(k)],
                        *[F.sum(w * p * (F.lit(1.0) - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    beta = np.array([0.0, *model.coefficients])
    g = np.array([rows[f"g{i}"] for i in range(k)]) + beta
    h = np.array([[rows[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag([1e-12, *[1.0] * (k - 1)])
    return rows["loss"] + float(beta @ beta) / 2, g, h


def fit(weighted: DataFrame, columns: Sequence[str], steps: int = 40, tolerance: float = 1e-9) -> Logit:
    """Newton steps from zero, each halved until the loss falls; ends when no gradient entry exceeds ``tolerance`` per row."""
    centres = tuple(m for m, _ in moments(weighted, columns).values())
    total, good = weighted.agg(F.sum("w"), F.sum(F.col("w") * F.col("label"))).first()
    share = (good + 0.5) / (total + 1.0)
    model = Logit(tuple(columns), centres, float(np.log(share / (1 - share))), (0.0,) * len(columns))
    loss, g, h = _state(weighted, model)
    for _ in range(steps):
        if np.abs(g).max() <= tolerance * total:
            break
        move = np.linalg.solve(h, g)
        for half in range(30):
            at = np.array([model.base, *model.coefficients]) - move / 2 ** half
            after = Logit(model.columns, centres, float(at[0]), tuple(map(float, at[1:])))
            new = _state(weighted, after)
            if new[0] <= loss + 1e-12 * abs(loss):
                break
        model, (loss, g, h) = after, new
    return model


def gradient(weighted: DataFrame, model: Logit) -> list[float]:
    """The penalised gradient per row at the model: zero at the optimum."""
    total = weighted.agg(F.sum("w")).first()[0]
    return (_state(weighted, model)[1] / total).tolist()


def predict(model: Logit, df: DataFrame) -> DataFrame:
    return df.withColumn("p", model.p())


def logistic_single(bt: DataFrame) -> DataFrame:
    """Success probability over the grid of viabilities."""
    model = fit(counted(bt, ["viability"]), ["viability"])
    grid = bt.sparkSession.createDataFrame([(v,) for v in GRID], "viability int")
    return predict(model, grid).select("viability", rnd(F.col("p"), 4).alias("p"))


def calibration(bt: DataFrame, bins: int = 6) -> DataFrame:
    """Mean predicted against observed rate in equal-width bins."""
    w = counted(bt, ["viability"])
    scored = predict(fit(w, ["viability"]), w)
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    agg = scored.groupBy(b.alias("bin")).agg(F.sum("w").alias("n"), F.sum(F.col("p") * F.col("w")).alias("_p"), F.sum(F.col("label") * F.col("w")).alias("_y"))
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return agg.select("bin", "n", rnd(safe_div(F.col("_p"), F.col("n")), 4).alias("predicted"), rnd(safe_div(F.col("_y"), F.col("n")), 4).alias("observed")).withColumn(
        "verdict", F.when(gap < 0.05, "WELL").otherwise("OFF"))


def running_number(df: DataFrame, by: str, order: str) -> DataFrame:
    """``nth``: the 0-based place of each row among those with the same ``by``, in the order of a unique column.

    Rows are dealt over ranges of ``order``; totals of the ranges give each one
    its first number, and rows are numbered inside their range, so no window spans a class.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "ranges")
    df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    upto = W.partitionBy("_by").orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row a range
    totals = dealt.groupBy(F.col("_range").alias("_r"), F.col(by).alias("_by")).agg(F.count("*").alias("_n")).withColumn("_first", F.sum("_n").over(upto) - F.col("_n"))
    inside = F.row_number().over(W.partitionBy("_range", by).orderBy(order)) - 1
    placed = dealt.withColumn("_inside", inside).join(totals, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return placed.withColumn("nth", F.col("_first") + F.col("_inside")).select(*df.columns, "nth")


def stratified_folds(rows: DataFrame, label: str = "label", order: str = "app_key", n: int = FOLDS) -> DataFrame:
    """``rows`` with ``fold``: the test folds of an unshuffled stratified split in the order of a unique column.

    All labels are laid out class by class, the class that comes first in front,
    and dealt round robin: that fixes how many rows of a class each fold gets.
    The rows of a class then fill the folds one after the other.
    """
    numbered = running_number(rows, label, order)
    classes = numbered.groupBy(label).agg(F.count("*").alias("size"), F.min(order).alias("first")).orderBy("first").collect()  # one row a class
    choice, start = F.lit(None).cast("int"), 0
    for c in classes:
        sizes = [sum(1 for p in range(start % n, start % n + c["size"] % n) if p % n == i) + c["size"] // n for i in range(n)]
        ends = np.cumsum(sizes).tolist()
        fold = F.lit(n - 1)
        for i in range(n - 2, -1, -1):
            fold = F.when(F.col("nth") < ends[i], i).otherwise(fold)
        choice = F.when(F.col(label).eqNullSafe(F.lit(c[label])), fold).otherwise(choice)
        start += c["size"]
    return numbered.withColumn("fold", choice.cast("int")).drop("nth")


def cv_auc(bt: DataFrame, components: Sequence[str]) -> DataFrame:
    """Mean and deviation of the held-out AUC, viability alone against all components."""
    folds = stratified_folds(labelled(bt).select("app_key", "label", "viability", "total_purchases", *components))
    base = counted(folds.drop("label"), [*components, "viability"], ["fold"])
    single = base.groupBy("fold", "viability", "label").agg(F.sum("w").alias("w"))
    out = []
    for name, cols, w in (("single", ["viability"], single), ("multi", list(components), standardised(base, components))):
        scores = []
        for k in range(FOLDS):
            model = fit(w.filter(F.col("fold") != k), cols)
            scores.append(_weighted_auc(predict(model, w.filter(F.col("fold") == k))))
        mean = sum(scores) / len(scores)
        out.append((name, mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5))
    return bt.sparkSession.createDataFrame(out, "model string, mean_auc double, std_auc double")


def _weighted_auc(scored: DataFrame) -> float:
    """AUC of counted predictions; one row per distinct prediction, ranked by running totals."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    with_raw = scored.withColumnRenamed("p", "rawPrediction")
    return BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label", weightCol="w", numBins=0).evaluate(with_raw)


def component_importance(bt: DataFrame, components: Sequence[str]) -> DataFrame:
    model = fit(standardised(counted(bt, components), components), components)
    rows = [(c, float(v)) for c, v in zip(components, model.coefficients)]
    return bt.sparkSession.createDataFrame(rows, "component string, coefficient double").select("component", rnd(F.col("coefficient"), 4).alias("coefficient")).orderBy(F.col("coefficient").desc())


def point_estimate(bt: DataFrame, components: Sequence[str], row: Sequence[int]) -> DataFrame:
    """Probability and lift of one feature row under the standardised model."""
    w = counted(bt, components)
    # The probe carries no weight, so it is scaled like the rest and moves nothing.
    probe = bt.sparkSession.createDataFrame([(*row, 0, 0.0)], ", ".join(f"{c} int" for c in components) + ", label int, w double")
    both = standardised(w.withColumn("probe", F.lit(False)).unionByName(probe.withColumn("probe", F.lit(True))), components)
    model = fit(both.filter("NOT probe"), components)
    base = w.agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("b")).first()[0]
    return predict(model, both.filter("probe")).select(
        rnd(F.col("p"), 4).alias("p"), rnd(F.lit(base), 4).alias("base_rate"), rnd(safe_div(F.col("p"), F.lit(base)), 3).alias("lift"))
