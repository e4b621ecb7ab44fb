"""Listing scores, cards and the day-one gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import columns as C, exact, match as M, tokens as T
from stallwise.functions.columns import rnd, safe_div, zero
from stallwise.operators.market import desc, rank_within, top, total


def _norm(value: Column, p90: Column) -> Column:
    # greatest/least skip NULLs, so unknown values are settled first.
    ratio = F.coalesce(safe_div(value, p90), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))


def run_p90(listings: DataFrame, metrics: tuple[str, ...]) -> dict[str, Column]:
    """90th percentile of each metric as scalar columns, from one ranked pass."""
    long = listings.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select("m.*")
    q = exact.quantiles(long, ["metric"], "v", {"p90": .9})
    packed = q.agg(F.map_from_entries(F.collect_list(F.struct("metric", "p90"))).alias("m")).scalar()  # one entry per metric
    return {m: F.try_element_at(packed, F.lit(m)) for m in metrics}


def score_apps(listings: DataFrame) -> DataFrame:
    """trend_score and opportunity_score (0-100) of every listing of a run."""
    metrics = ("last_month_purchases", "review_count", "total_purchases")
    packed = run_p90(listings, metrics)
    base = listings.select("*", *[packed[m].alias(f"_p_{m}") for m in metrics])
    last, totals, reviews = F.col(metrics[0]), F.col(metrics[2]), F.col(metrics[1])
    norm = lambda m: _norm(F.col(m), F.col(f"_p_{m}"))
    pace = safe_div(last, totals)
    bonus = F.when((last > 0) & (totals > 0) & (pace > 0.05),
                   F.least(F.lit(1.0), F.log(F.lit(1.0) + F.lit(20.0) * pace))).otherwise(F.lit(0.0))
    price = F.least(F.lit(1.0), F.coalesce(F.col("price_cents") / 100.0 / 500.0, F.lit(0.1)))
    stars = F.coalesce("rating_stars", F.lit(0.0)) / 5.0
    sat = F.when((reviews > 0) & (totals > 0), F.least(F.lit(0.4), F.lit(5.0) * safe_div(reviews, totals))).otherwise(F.lit(0.0))
    trend = F.lit(0.6) * norm(metrics[0]) + F.lit(0.3) * norm(metrics[1]) + F.lit(0.1) * bonus
    opp = F.lit(0.4) * norm(metrics[2]) + F.lit(0.3) * price + F.lit(0.2) * stars + F.lit(0.1) * (F.lit(1.0) - sat)
    return base.select(*listings.columns, rnd(F.lit(100.0) * trend, 2).alias("trend_score"),
                       rnd(F.lit(100.0) * opp, 2).alias("opportunity_score"))


def three_way(scores: DataFrame, apps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Scores with their listing dimension and facts."""
    s = scores.select("run_id", "app_key", "trend_score", "opportunity_score")
    a = apps.select("app_key", "version", "first_seen")
    return s.join(snapshots.drop("version", "first_seen"), ["run_id", "app_key"]).join(a, "app_key")


def top_trends(scored: DataFrame, n: int = 20) -> DataFrame:
    return top(scored, [desc("trend_score"), F.col("app_key")], n)


def niche_apps(scored: DataFrame, keyword: str, n: int = 20) -> DataFrame:
    return top(scored.filter(M.contains(["display_name", "summary"], [keyword])), [desc("opportunity_score"), F.col("app_key")], n)


def day1_gate(niche_rows: DataFrame, n: int = 10) -> DataFrame:
    """Verdict on a niche from its top listings by opportunity (n rows after the top-k)."""
    picked = top(niche_rows, [desc("opportunity_score"), F.col("app_key")], n)
    packed = picked.agg(F.array_sort(F.collect_list(F.struct(  # at most n rows
        (-F.col("opportunity_score")).alias("o"), "app_key", "author", "rating_stars", "last_month_purchases", "price_cents"))).alias("t"))
    rows = F.col("t")
    first3 = F.filter(F.transform(F.slice(rows, 1, 3), lambda r: r["author"]), lambda a: a.isNotNull())
    weak = F.filter(F.slice(rows, 1, 5), lambda r: F.coalesce(r["rating_stars"] < 4, F.lit(False)) | (zero(r["last_month_purchases"]) == 0))
    cents = F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, r: acc + zero(r["last_month_purchases"]) * zero(r["price_cents"]))
    out = packed.select(
        rnd(cents / 100.0 * 0.7, 2).alias("net_revenue"),
        ((F.size(first3) == 3) & (F.size(F.array_distinct(first3)) == 3)).alias("authors_differ"), F.size(weak).alias("weak"))
    passed = (F.col("net_revenue") > 2500) & F.col("authors_differ") & (F.col("weak") >= 2)
    return out.withColumn("verdict", F.when(passed, "PASS").otherwise("FAIL"))


def competitors(cards: DataFrame, listings: DataFrame, k: int = 3) -> DataFrame:
    """Per card the k best-selling other listings whose name holds its keyword.

    Keywords meet distinct names through ``contains_join``; each keyword keeps
    its k + 1 best listings before cards are joined, so a popular keyword never
    multiplies cards by listings.
    """
    cards = cards.select("app_key", F.lower(T.primary_keyword()).alias("keyword")).filter(F.col("keyword").isNotNull())
    named = listings.withColumn("_name", F.lower("display_name"))
    pairs = M.contains_join(named.select("_name").distinct(), "_name", cards.select("keyword").distinct(), "keyword")
    hits = named.join(pairs, "_name").select("keyword", F.col("app_key").alias("comp_key"), F.col("display_name").alias("comp_name"),
                                             "author", "rating_stars", "total_purchases")
    best = rank_within(hits, ["keyword"], [desc("total_purchases"), F.col("comp_key")], k + 1, "_r")
    others = cards.join(best, "keyword").filter(F.col("comp_key") != F.col("app_key"))
    return rank_within(others, ["app_key"], [F.col("_r")], k).drop("_r")


def cards(scored: DataFrame, n: int = 10) -> DataFrame:
    """Card fields of the n best listings by opportunity, with their competitors."""
    picked = top(scored, [desc("opportunity_score"), F.col("app_key")], n)
    comp = competitors(picked, scored).groupBy("app_key").agg(F.array_sort(F.collect_list(F.struct(  # at most 3 per card
        "rank", F.col("comp_name").alias("name"), "author", F.col("rating_stars").alias("stars"),
        zero("total_purchases").alias("total")))).alias("competitors"))
    last = zero("last_month_purchases")
    usd = F.when(C.paid(), F.col("price_cents") / 100.0).otherwise(F.lit(0.0))
    return picked.join(comp, "app_key", "left").select(
        "app_key", F.col("display_name").alias("title"), "author", "version", "summary", F.col("detail_url").alias("url"),
        C.badges().alias("badges"),
        F.struct(rnd(F.col("opportunity_score") / 10.0, 1).alias("opportunity"), rnd(F.col("trend_score") / 10.0, 1).alias("trend"),
                 rnd(F.least(F.lit(10.0), C.momentum_pct()), 1).alias("timing")).alias("scores"),
        F.struct(zero("total_purchases").alias("total"), last.alias("last_month"), rnd(C.momentum_pct(), 2).alias("momentum_pct"),
                 zero("review_count").alias("reviews"), F.col("rating_stars").alias("stars")).alias("demand"),
        F.struct(usd.alias("price_usd"), "currency", rnd(zero("price_cents") * last / 100.0, 2).alias("monthly_revenue")).alias("pricing"),
        "competitors")
