"""Back-test of the viability score against what listings really sold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import columns as C, exact, match as M
from stallwise.functions.columns import rnd, safe_div, zero
from stallwise.operators.market import desc, top, total
from stallwise.operators.validate import Words, gap_moat, sub_scores

COMPONENTS = ["sat", "demand", "dead_health", "momentum", "forced_buyer", "rating_score"]
# Viability bands (label, lowest, highest).
BANDS = [("SCREEN OUT", 0, 41), ("INVESTIGATE", 42, 46), ("CONSIDER", 47, 51), ("LAUNCH", 52, 100)]


def tier() -> Column:
    """WINNER from 100 sales, MID from 5, LOSER at none; other paid listings have no tier."""
    t = zero("total_purchases")
    return F.when(C.paid() & (t >= 100), "WINNER").when(C.paid() & t.between(5, 99), "MID").when(C.paid() & (t == 0), "LOSER")


def tiered(listings: DataFrame, limits: Mapping[str, int] | None = None) -> DataFrame:
    """Listings with a tier: all of them, or the best-selling ``limits`` of each tier."""
    rows = listings.withColumn("tier", tier()).filter(F.col("tier").isNotNull())
    if not limits:
        return rows
    parts = [top(rows.filter(F.col("tier") == t), [desc("total_purchases"), F.col("app_key")], n) for t, n in limits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def word_stats(words: DataFrame, listings: DataFrame) -> DataFrame:
    """Stats over all listings whose name contains a word, for every word of a table.

    Facts are combined per distinct name first; only distinct names meet words.
    """
    t, lm, paid = zero("total_purchases"), zero("last_month_purchases"), C.paid()
    good = F.when(F.col("rating_stars") > 0, F.col("rating_stars"))
    facts = listings.groupBy(F.lower("display_name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).alias("total"), F.sum(lm).alias("velocity"), F.count_if(t == 0).alias("dead"),
        F.count_if(lm > 0).alias("active"), F.count_if(paid).alias("paid"), F.count_if(F.col("price_cents") == 0).alias("free"),
        F.count_if(paid & (F.col("price_cents") <= 3000)).alias("low"),
        F.count_if(paid & (t > 50) & F.coalesce(F.col("last_month_purchases") == 0, F.lit(False))).alias("stale"),
        total(F.when(paid, F.col("price_cents"))).alias("cents"), F.max(t).alias("best"), F.sum(good).alias("stars"), F.count(good).alias("rated"))
    pairs = M.contains_join(facts, "name", words.select("word").distinct(), "word")
    s = [F.sum(c).alias(c) for c in ("n", "total", "velocity", "dead", "active", "paid", "free", "low", "stale", "cents", "stars", "rated")]
    agg = pairs.groupBy("word").agg(*s, F.max("best").alias("best"))
    return agg.select(
        "word", "n", "total", "velocity", "dead", "active", "paid", "free", "low", "stale",
        F.coalesce(safe_div(F.col("cents"), F.col("paid")) / 100.0, F.lit(0.0)).alias("avg_price"),
        F.coalesce(safe_div(F.col("best") * 100.0, F.col("total")), F.lit(50.0)).alias("top_share"),
        F.coalesce(safe_div(F.col("stars"), F.col("rated")), F.lit(0.0)).alias("avg_rating"))


def backtest(listings: DataFrame, words: Words = Words(), limits: Mapping[str, int] | None = None) -> DataFrame:
    """Scored rows: the niche of a listing is its first name word, its text is name and summary."""
    rows = tiered(listings, limits).select(
        "app_key", "display_name", "author", "tier", zero("total_purchases").alias("total_purchases"), zero("last_month_purchases").alias("last_month"),
        F.coalesce(F.nullif(F.split_part(F.trim(F.lower("display_name")), F.lit(" "), F.lit(1)), F.lit("")), F.lit("x")).alias("word"),
        M.joined_text(["display_name", "summary"]).alias("text"))
    stats = gap_moat(word_stats(rows, listings))
    return sub_scores(rows.join(stats, "word"), F.col("text"), words)


def tier_stats(bt: DataFrame) -> DataFrame:
    agg = bt.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("viability"), 3).alias("mean"), rnd(F.stddev_samp("viability"), 3).alias("std"),
        *[rnd(F.avg(c), 3).alias(c) for c in COMPONENTS])
    return agg.join(exact.quantiles(bt, ["tier"], "viability", {"median": .5}), "tier", "left")


def launch_rate(bt: DataFrame, threshold: int = 70) -> DataFrame:
    hit = F.count_if(F.col("viability") >= threshold)
    return bt.groupBy("tier").agg(hit.alias("ready"), F.count(F.lit(1)).alias("n"), rnd(safe_div(hit * 100.0, F.count(F.lit(1))), 1).alias("pct"))


def false_positives(bt: DataFrame, threshold: int = 60, n: int = 15) -> DataFrame:
    return top(bt.filter((F.col("tier") == "LOSER") & (F.col("viability") >= threshold)), [desc("viability"), F.col("app_key")], n)


def false_negatives(bt: DataFrame, threshold: int = 50, n: int = 15) -> DataFrame:
    return top(bt.filter((F.col("tier") == "WINNER") & (F.col("viability") < threshold)), [F.col("viability"), F.col("app_key")], n)


def migrator_bias(bt: DataFrame) -> DataFrame:
    return bt.groupBy("is_migrator", "tier").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("viability"), 3).alias("mean"))


def band(v: Column) -> Column:
    out = None
    for label, lo, hi in BANDS:
        out = F.when(v.between(lo, hi), label) if out is None else out.when(v.between(lo, hi), label)
    return out


def band_rates(bt: DataFrame) -> DataFrame:
    """Share of winners among winners and losers, hit rate and lift over the base rate, per band."""
    hit = F.col("total_purchases") >= 100
    base = bt.agg(safe_div(F.count_if(hit), F.count(F.lit(1))).alias("b")).scalar()
    wl = F.col("tier").isin("WINNER", "LOSER")
    agg = bt.groupBy(band(F.col("viability")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wl).alias("n_wl"), F.count_if(F.col("tier") == "WINNER").alias("_w"), F.count_if(hit).alias("_h"))
    rate = safe_div(F.col("_h"), F.col("n"))
    return agg.select("band", "n", "n_wl", rnd(safe_div(F.col("_w") * 100.0, F.col("n_wl")), 1).alias("win_pct"), rnd(rate, 4).alias("hit_rate"),
                      rnd(safe_div(rate, base), 4).alias("lift"))


def base_rate(bt: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("total_purchases") >= 100)
    return bt.agg(hit.alias("hits"), F.count(F.lit(1)).alias("n"), rnd(safe_div(hit, F.count(F.lit(1))), 6).alias("base_rate"))
