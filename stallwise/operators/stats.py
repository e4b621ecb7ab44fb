"""Rank statistics from counted values; rows are never sorted as a whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import exact
from stallwise.functions.columns import rnd, safe_div
from stallwise.session import fresh_path


def long_form(df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """(component, value, keep...) rows, one per column."""
    cells = [F.struct(F.lit(n).alias("component"), c.cast("double").alias("value")) for n, c in columns.items()]
    return df.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.*")


def winners_losers(bt: DataFrame) -> DataFrame:
    return bt.filter(F.col("tier").isin("WINNER", "LOSER")).withColumn("label", (F.col("tier") == "WINNER").cast("int"))


def pearson_log(bt: DataFrame, components: Sequence[str]) -> DataFrame:
    """Correlation with log(1 + sales) over the rows that sold."""
    sold = bt.filter("total_purchases > 0")
    long = long_form(sold, {c: F.col(c) for c in components}, ["total_purchases"])
    y = F.log1p("total_purchases")
    agg = long.groupBy("component").agg(F.covar_pop("value", y).alias("c"), F.stddev_pop("value").alias("sx"), F.stddev_pop(y).alias("sy"))
    return agg.select("component", rnd(safe_div(F.col("c"), F.col("sx") * F.col("sy")) + 1.0, 6).alias("r_plus_1"))


def spearman(bt: DataFrame, components: Sequence[str], against: str) -> DataFrame:
    """Rank correlation per component with significance stars.

    Rows are first combined to (component, value, target) counts.  Average ranks
    have mean (n + 1) / 2, so centred products need no second pass.
    """
    long = long_form(bt, {c: F.col(c) for c in components}, [against])
    pairs = long.groupBy("component", "value", against).agg(F.count(F.lit(1)).alias("w"))
    path = fresh_path(bt.sparkSession, "pairs")
    pairs.write.parquet(path)
    pairs = bt.sparkSession.read.parquet(path)
    # Every component has the same rows, so the target is ranked once, from the pairs of one of them.
    rx = exact.average_ranks(pairs, ["component"], "value", weight="w").select("component", "value", F.col("avg_rank").alias("rx"), "n")
    ry = exact.average_ranks(pairs.filter(F.col("component") == components[0]), [], against, weight="w").select(against, F.col("avg_rank").alias("ry"))
    joined = pairs.join(rx, ["component", "value"]).join(ry, against)
    x, y, w = F.col("rx") - (F.col("n") + 1) / 2.0, F.col("ry") - (F.col("n") + 1) / 2.0, F.col("w")
    agg = joined.groupBy("component").agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.max("n").alias("n"))
    r = safe_div(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    out = agg.select("component", "n", r.alias("r"))
    df = F.col("n") - 2.0
    t2 = safe_div(F.col("r") * F.col("r") * df, F.lit(1.0) - F.col("r") * F.col("r"))
    # Normal score of a t value (Wallace's approximation).
    z = (df * 8.0 + 1.0) / (df * 8.0 + 3.0) * F.sqrt(df * F.log1p(t2 / df))
    stars = F.when(z > 3.290527, "***").when(z > 2.575829, "**").when(z > 1.959964, "*").otherwise("ns")
    return out.select("component", "n", rnd(F.col("r") + 1.0, 6).alias("r_plus_1"), stars.alias("stars"))


def rank_sums(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Per component: U of label 1 over label 0, both sizes, and the tie sum."""
    long = long_form(df, columns, ["label"])
    r = exact.average_ranks(long, ["component"], "value", {"pos": F.sum("label")})
    c = F.col("cnt").cast("double")
    agg = r.groupBy("component").agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("rs"), F.sum("pos").cast("double").alias("n1"),
                                     F.max("n").cast("double").alias("n"), F.sum(c * c * c - c).alias("ties"))
    n1 = F.col("n1")
    return agg.select("component", "n1", (F.col("n") - n1).alias("n0"), "n", "ties", (F.col("rs") - n1 * (n1 + 1.0) / 2.0).alias("u"))


def auc(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Area under the ROC curve per column; ties count one half."""
    return rank_sums(df, columns).select("component", rnd(safe_div(F.col("u"), F.col("n1") * F.col("n0")), 6).alias("auc"))


def formula_compare(df: DataFrame, earlier: Column, current: Column) -> DataFrame:
    a = auc(df, {"earlier": earlier, "current": current})
    return a.agg(F.max(F.when(F.col("component") == "earlier", F.col("auc"))).alias("auc_earlier"),
                 F.max(F.when(F.col("component") == "current", F.col("auc"))).alias("auc_current")).select(
        "*", rnd(F.col("auc_current") - F.col("auc_earlier") + 1.0, 6).alias("delta_plus_1"))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-(a * a) / 2.0) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def mann_whitney(df: DataFrame, column: str) -> DataFrame:
    """One-sided test (label 1 greater): U, tie-corrected normal p, rank-biserial 1 - 2U / (n1 n0)."""
    r = rank_sums(df, {column: F.col(column)})
    n1, n0, n = F.col("n1"), F.col("n0"), F.col("n")
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1.0) - safe_div(F.col("ties"), n * (n - 1.0))))
    z = safe_div(F.col("u") - n1 * n0 / 2.0 - 0.5, sd)
    return r.select("component", "u", "n1", "n0", rnd(upper_tail(z), 6).alias("p"),
                    rnd(F.lit(2.0) - safe_div(F.col("u") * 2.0, n1 * n0), 6).alias("rank_biserial_plus_1"))


def threshold_f1(df: DataFrame, column: str = "viability", lo: int = 30, hi: int = 74) -> DataFrame:
    """First threshold with the best F1.  A score of v counts for every threshold up to v."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("p"))
    positives = df.agg(F.sum("label").alias("p")).scalar()
    each = counts.filter(F.col("v") >= lo).select(F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("v")))).alias("t"), "c", "p")
    agg = each.groupBy("t").agg(F.sum("c").alias("predicted"), F.sum("p").alias("tp"))
    f1 = safe_div(F.col("tp") * 2.0, F.col("predicted") + positives)
    best = agg.withColumn("f1", f1).agg(F.max_by(F.struct("t", "predicted", "tp", "f1"), F.struct(F.col("f1"), -F.col("t"))).alias("b")).select("b.*")
    return best.select(F.col("t").alias("threshold"), rnd(F.col("f1"), 6).alias("f1"),
                       rnd(safe_div(F.col("tp"), F.col("predicted")), 6).alias("precision"), rnd(safe_div(F.col("tp"), positives), 6).alias("recall"))
