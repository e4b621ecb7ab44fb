"""Keyword niches: fan-out aggregates, gap labels and niche scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import columns as C, exact, match as M, tokens as T
from stallwise.functions.columns import rnd, safe_div, zero
from stallwise.functions.match import Niche
from stallwise.operators.market import desc, rank_within, top, total

BOTH = ("display_name", "summary")


def _frame(df: DataFrame, dim: Sequence[Niche], **types: str) -> DataFrame:
    return M.to_frame(df.sparkSession, dim, **types)


def rollup(listings: DataFrame, dim: Sequence[Niche], fields: Sequence[str] = BOTH, mode: str = "contains",
           where: Column | None = None, by: Sequence[str] = ("label",), extra: Sequence[Column] = ()) -> DataFrame:
    """Listings, sales and last-month sales per niche, with any further aggregates."""
    hits = M.fan_out(listings if where is None else listings.filter(where), dim, fields, mode)
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("listings"), total("total_purchases").alias("sales"),
                                 total("last_month_purchases").alias("last_month"), *extra)


def niche_velocity(listings: DataFrame, dim: Sequence[Niche]) -> DataFrame:
    per_author = rollup(listings, dim, by=("label", "author"))
    agg = per_author.groupBy("label").agg(F.sum("listings").alias("listings"), F.sum("sales").alias("sales"),
                                          F.sum("last_month").alias("last_month"), F.count("author").alias("publishers"))
    return agg.withColumn("velocity_per_listing", rnd(safe_div(F.col("last_month"), F.col("listings")), 2))


def counts_keep_zero(listings: DataFrame, dim: Sequence[Niche], fields: Sequence[str] = BOTH, **types: str) -> DataFrame:
    """Counts and sales for every niche of the dimension, matched or not."""
    return M.keep_zero(rollup(listings, dim, fields), _frame(listings, dim, **types), zeros=["listings", "sales", "last_month"])


def thin_niches(listings: DataFrame, dim: Sequence[Niche], max_apps: int = 5) -> DataFrame:
    return counts_keep_zero(listings, dim).filter(F.col("listings") <= max_apps)


def signal_label(n: Column) -> Column:
    return F.when(n == 0, "ZERO").when(n <= 3, "THIN").when(n <= 15, "OK").otherwise("CROWDED")


def _rank(c: str, values: Sequence[str]) -> Column:
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(c) == v, F.lit(i)).otherwise(out)
    return out


def gap_scan(listings: DataFrame, dim: Sequence[Niche]) -> DataFrame:
    """Signal per capability, thin ones first."""
    out = counts_keep_zero(listings, dim, source="string").withColumn("signal", signal_label(F.col("listings")))
    return out.orderBy(_rank("signal", ["ZERO", "THIN", "OK", "CROWDED"]), desc("sales"), "label")


def signal_summary(scan: DataFrame, per_source: int = 3) -> DataFrame:
    """Count per signal, and the first ZERO capabilities of each source as one joined text."""
    counts = scan.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.lit("").alias("items"))
    first = rank_within(scan.filter("signal = 'ZERO'"), ["source"], [F.col("label")], per_source)
    zeros = first.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("items"))
    return counts.unionByName(zeros.select(F.concat(F.lit("ZERO:"), "source").alias("signal"), "n", "items"))


def tam(scan: DataFrame, base: DataFrame, rate: float = 0.005) -> DataFrame:
    """Yearly switchers from the installed base of a capability's source."""
    out = scan.join(base, "source", "left")
    return out.withColumn("tam", zero(F.floor(F.col("installs") * F.col("churn") * F.lit(rate))))


def radar_score(sales: Column, n: Column) -> Column:
    d = safe_div(sales, n)
    return F.when(n <= 30, F.least(F.lit(100), F.floor(d / 5.0))).otherwise(F.greatest(F.lit(0), F.floor(d / 20.0)))


def gap_radar(listings: DataFrame, dim: Sequence[Niche]) -> DataFrame:
    agg = rollup(listings, dim, where=C.paid(), extra=[rnd(F.avg("price_cents") / 100.0, 2).alias("avg_price")])
    n = F.col("listings")
    return agg.select("label", "listings", rnd(safe_div(F.col("sales"), n), 1).alias("sales_per_listing"),
                      rnd(safe_div(F.col("last_month"), n), 2).alias("velocity_per_listing"), "avg_price",
                      radar_score(F.col("sales"), n).alias("gap_score"))


def speed_to_dollar(listings: DataFrame, dim: Sequence[Niche]) -> DataFrame:
    """Per niche dead share, velocity and revenue, with the medians that split the quadrants."""
    agg = M.keep_zero(
        rollup(listings, dim, extra=[F.count_if(C.dead()).alias("dead"), F.sum(F.when(C.paid(), F.col("price_cents"))).alias("_c"),
                                     F.count_if(C.paid()).alias("_p")]),
        _frame(listings, dim), zeros=["listings", "sales", "last_month", "dead", "_c", "_p"])
    avg = F.coalesce(safe_div(F.col("_c"), F.col("_p")) / 100.0, F.lit(0.0))
    out = agg.select(
        "label", "listings", F.coalesce(rnd(safe_div(F.col("dead") * 100.0, F.col("listings")), 1), F.lit(0.0)).alias("dead_pct"),
        F.coalesce(rnd(safe_div(F.col("last_month"), F.col("listings")), 2), F.lit(0.0)).alias("velocity_per_listing"),
        F.floor(F.col("last_month") * avg).alias("monthly_revenue"), rnd(avg).alias("avg_price"))
    # Medians over niche rows, whose number is that of the literal dimension.
    med = lambda c: out.agg(F.percentile(c, F.lit(0.5)).alias("m")).scalar()
    return out.withColumn("med_dead", med("dead_pct")).withColumn("med_velocity", med("velocity_per_listing"))


def keyword_probe(listings: DataFrame, words: Sequence[Niche], rare: Sequence[Niche], rare_max: int = 10) -> DataFrame:
    """Words in use at all, and paid words with few listings that still sell."""
    used = rollup(listings, words).select(F.lit("used").alias("probe"), "label", "listings", "sales")
    few = rollup(listings, rare, where=C.paid()).filter((F.col("listings") < rare_max) & (F.col("sales") > 0))
    return used.unionByName(few.select(F.lit("rare").alias("probe"), "label", "listings", "sales"))


# ---- wedges ------------------------------------------------------------------

def wedge_rows(rows: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """One row per (listing, wedge); predicates are SQL conditions, all tested in one scan."""
    tests = [F.when(F.coalesce(F.expr(p), F.lit(False)), F.lit(name)) for name, p in predicates.items()]
    return M.explode_once(rows, "wedge", F.array_compact(F.array(*tests)))


def wedges(rows: DataFrame, predicates: dict[str, str]) -> DataFrame:
    hits = wedge_rows(rows, predicates)
    agg = hits.groupBy("wedge").agg(
        F.count(F.lit(1)).alias("listings"), F.countDistinct("author").alias("publishers"), total("total_purchases").alias("lifetime"),
        total("last_month_purchases").alias("last_month"), rnd(total(C.gross()), 2).alias("lifetime_gross"),
        rnd(total(C.gross("last_month_purchases")), 2).alias("last_month_gross"))
    med = exact.quantiles(hits.filter("price_cents <> 0"), ["wedge"], "price_cents", {"m": .5})
    return agg.join(med, "wedge", "left").withColumn("median_paid_price", rnd(F.col("m") / 100.0, 2)).drop("m")


def wedge_leaders(rows: DataFrame, predicates: dict[str, str], n: int = 10) -> DataFrame:
    hits = wedge_rows(rows.filter(C.paid()), predicates).withColumn("gross", rnd(C.gross(), 2))
    return rank_within(hits, ["wedge"], [desc("gross"), desc("total_purchases"), F.col("app_key")], n)


# ---- decisions ---------------------------------------------------------------

def decision(n: Column, last: Column, top_price: Column) -> Column:
    return (F.when(n < 5, "BUILD").when(last < 3, "SKIP").when(top_price >= 300, "UNDERCUT")
            .when(last >= 5, "UNDERCUT").otherwise("WATCH"))


def decision_reason(n: Column, last: Column, top_price: Column) -> Column:
    return (F.when(n == 0, "no competition").when(n < 5, "few listings").when(last == 0, "no demand")
            .when(last < 3, "weak demand").when(top_price >= 300, "top price high")
            .when((last >= 5) & (top_price < 100), "busy, cheap leader").when(last >= 5, "busy").otherwise("marginal"))


def suite_decisions(listings: DataFrame, dim: Sequence[Niche], edition: str = "edition") -> DataFrame:
    """Build, undercut, watch or skip per regex niche, from its totals and its first listing."""
    agg = M.keep_zero(rollup(listings, dim, ("display_name",), "regex"), _frame(listings, dim, **{edition: "string"}),
                      zeros=["listings", "sales", "last_month"])
    lead = niche_topk(listings, dim, 1, ("display_name",), "regex", ("last_month_purchases", "total_purchases"))
    lead = lead.select("label", F.col("display_name").alias("top_name"), (zero("price_cents") / 100.0).alias("_tp"),
                       zero("last_month_purchases").alias("_tl"))
    out = agg.join(lead, "label", "left").withColumn("top_price", F.coalesce("_tp", F.lit(0.0)))
    n, last = F.col("listings"), F.col("last_month")
    out = out.withColumn("decision", decision(n, last, F.col("top_price"))).withColumn("reason", decision_reason(n, last, F.col("top_price")))
    return out.drop("_tp", "_tl").orderBy(_rank("decision", ["BUILD", "UNDERCUT", "WATCH", "SKIP"]), desc("last_month"), "label")


def niche_topk(listings: DataFrame, dim: Sequence[Niche], k: int, fields: Sequence[str] = BOTH, mode: str = "contains",
               order: Sequence[str] = ("total_purchases",)) -> DataFrame:
    """The k leading listings of each niche."""
    hits = M.fan_out(listings, dim, fields, mode)
    return rank_within(hits, ["label"], [*[zero(c).desc() for c in order], F.col("app_key")], k)


# ---- token niches ------------------------------------------------------------

def token_niches(listings: DataFrame, min_apps: int = 3) -> DataFrame:
    """Listings grouped by the niche word of their name."""
    rows = listings.withColumn("_tok", T.niche_keyword()).filter(F.col("_tok").isNotNull()).withColumn("niche", F.lower("_tok"))
    reviewed = (zero("review_count") >= 5) & F.col("rating_stars").isNotNull()
    agg = rows.groupBy("niche").agg(
        F.min_by("_tok", "app_key").alias("keyword"), F.count(F.lit(1)).alias("n_apps"), total("total_purchases").alias("sum_total"),
        total("last_month_purchases").alias("sum_last_month"), F.max(zero("total_purchases")).alias("_top"),
        F.count_if(reviewed).alias("_rev"), F.count_if(reviewed & (F.col("rating_stars") < 4)).alias("_low"),
        F.avg(F.when(reviewed, F.col("rating_stars"))).alias("avg_rating"), F.count_if(C.paid()).alias("_paid"))
    agg = agg.filter(F.col("n_apps") >= min_apps)
    # Upper median: the element at floor(n / 2) of the sorted paid prices.
    med = exact.positions(rows.filter(C.paid()), ["niche"], "price_cents", {"_med": F.floor(F.col("n") / 2)})
    return agg.join(med, "niche", "left").select(
        "niche", "keyword", "n_apps", "sum_total", "sum_last_month",
        F.coalesce(safe_div(F.col("_top"), F.col("sum_total")), F.lit(1.0)).alias("top1_share"), "avg_rating",
        F.coalesce(safe_div(F.col("_low"), F.col("_rev")), F.lit(0.5)).alias("quality_gap"),
        safe_div(F.col("_paid"), F.col("n_apps")).alias("paid_share"),
        (zero("_med") / 100.0).alias("median_price_usd"),
        F.coalesce(safe_div(F.col("sum_last_month"), F.col("sum_total")), F.lit(0.0)).alias("momentum"))


def nearest_rank_p90(df: DataFrame, values: Sequence[Column]) -> list[Column]:
    """Scalars at sorted position half-even(0.9 * (n - 1)), one per value, from one ranked pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.cast("double").alias("v")) for i, v in enumerate(values)])).alias("e")).select("e.*")
    p = exact.positions(long, ["i"], "v", {"p": F.bround(F.lit(0.9) * (F.col("n") - 1))})
    packed = p.agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("m")).scalar()  # one entry per value
    return [F.coalesce(F.nullif(F.try_element_at(packed, F.lit(i)), F.lit(0.0)), F.lit(1.0)) for i in range(len(values))]


def score_niches(niches: DataFrame) -> DataFrame:
    """Opportunity 0-100 of token niches against the 90th-percentile niche."""
    demand_log = F.log10(F.col("sum_total") + F.lit(1.0))
    p_log, p_price = nearest_rank_p90(niches, [demand_log, F.col("median_price_usd")])
    share = F.col("top1_share")
    base = niches.select("*", p_log.alias("_pl"), p_price.alias("_pp"))
    frag = F.when(share >= 0.8, F.lit(0.0)).when(share <= 0.2, F.lit(1.0)).otherwise((F.lit(0.8) - share) / 0.6)
    score = (F.lit(0.30) * F.least(F.lit(1.0), demand_log / F.col("_pl")) + F.lit(0.25) * frag + F.lit(0.20) * F.col("quality_gap")
             + F.lit(0.15) * F.least(F.lit(1.0), F.col("median_price_usd") / F.col("_pp"))
             + F.lit(0.10) * F.least(F.lit(1.0), F.col("momentum") / 0.1))
    return base.withColumn("opportunity", rnd(F.lit(100.0) * score, 1)).drop("_pl", "_pp")


# ---- recommended niches ------------------------------------------------------

def recommend_stats(listings: DataFrame, dim: Sequence[Niche]) -> DataFrame:
    """Market facts per word-matched niche with at least two listings; publishers are combined first."""
    hits = M.fan_out(listings, dim, BOTH, "word").withColumn("_author", F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")))
    t, lm, stars = zero("total_purchases"), zero("last_month_purchases"), F.col("rating_stars")
    per_author = hits.groupBy("label", "_author").agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).alias("t"), F.sum(lm).alias("lm"), F.count(stars).alias("rated"),
        F.sum(stars).alias("stars"), F.count_if(stars < 4).alias("low"),
        F.count_if((t > 0) & (safe_div(lm, t) < 0.005)).alias("stale"), F.sum(lm * zero("price_cents")).alias("cents"))
    s = lambda c: F.sum(c)
    agg = per_author.groupBy("label").agg(
        s("n").alias("n_apps"), s("t").alias("total_purchases"), s("lm").alias("last_month"), F.count(F.lit(1)).alias("author_count"),
        F.max("t").alias("_top"), s("rated").alias("_rated"), s("stars").alias("_stars"), s("low").alias("_low"),
        s("stale").alias("_stale"), s("cents").alias("_cents")).filter("n_apps >= 2")
    med = exact.quantiles(hits.filter("price_cents > 0"), ["label"], "price_cents", {"_med": .5})
    attrs = _frame(listings, dim, category="string", complexity="string").drop("pos")
    return agg.join(med, "label", "left").join(attrs, "label").select(
        "label", "category", "complexity", "n_apps", "total_purchases", "last_month", "author_count",
        F.floor("_med").alias("median_price_cents"), safe_div(F.col("_stars"), F.col("_rated")).alias("avg_rating"),
        F.coalesce(safe_div(F.col("_low"), F.col("_rated")), F.lit(0.0)).alias("pct_low_rating"),
        safe_div(F.col("n_apps") - F.col("_rated"), F.col("n_apps")).alias("pct_unrated"),
        safe_div(F.col("_stale"), F.col("n_apps")).alias("pct_stale"),
        F.coalesce(safe_div(F.col("_top"), F.col("total_purchases")), F.lit(1.0)).alias("top_author_share"),
        (F.col("_cents") / 100.0 * 0.7).alias("est_monthly_revenue"))


def score_recommend(stats: DataFrame) -> DataFrame:
    n, rev = F.col("n_apps"), F.col("est_monthly_revenue")
    raw = (F.lit(0.30) * F.least(F.lit(1.0), F.log10(F.greatest(rev, F.lit(1.0))) / 5.0) + F.lit(0.20) * F.col("pct_low_rating")
           + F.lit(0.20) * (F.lit(1.0) - F.col("top_author_share")) + F.lit(0.10) * F.col("pct_stale")
           + F.lit(0.10) * (F.lit(1.0) - F.abs(F.least(n, F.lit(30)) - 10) / 30.0)
           + F.lit(0.10) * F.least(F.lit(1.0), zero("median_price_cents") / 30000.0))
    factor = (F.when(n > 50, 0.6).otherwise(1.0) * F.when(n < 4, 0.7).otherwise(1.0) * F.when(rev < 5000, 0.5).otherwise(1.0))
    return stats.withColumn("score", rnd(raw * factor * 100.0, 1))


# Categories where the platform owner is itself a seller.
OWNER_CATEGORIES = ["crm", "hr", "manufacturing", "analytics", "billing"]


def failure_modes() -> Column:
    found = F.array_compact(F.array(
        F.when(F.col("category").isin(OWNER_CATEGORIES), "platform owner competes"),
        F.when(F.col("complexity") == "L", "scope too large"),
        F.when(F.col("top_author_share") > 0.5, "dominant publisher"),
        F.when(F.col("n_apps") > 25, "saturated"),
        F.when(F.col("est_monthly_revenue") < 15000, "small revenue pool")))
    return F.when(F.size(found) == 0, F.array(F.lit("patience"))).otherwise(F.slice(found, 1, 3))


def angle_figure() -> Column:
    """The whole percentage or the price in cents that an angle's text names; NULL for the last one."""
    percent = lambda c: F.floor(F.col(c) * 100)
    return (F.when(F.col("pct_stale") > 0.3, percent("pct_stale")).when(F.col("pct_low_rating") > 0.4, percent("pct_low_rating"))
            .when(F.col("pct_unrated") > 0.5, percent("pct_unrated"))
            .when((F.col("top_author_share") > 0.5) & (F.col("author_count") > 1), percent("top_author_share"))
            .when(F.col("median_price_cents") > 30000, F.floor("median_price_cents")))


def angle() -> Column:
    return (F.when(F.col("pct_stale") > 0.3, "maintained").when(F.col("pct_low_rating") > 0.4, "quality")
            .when(F.col("pct_unrated") > 0.5, "under-marketed")
            .when((F.col("top_author_share") > 0.5) & (F.col("author_count") > 1), "sub-segment")
            .when(F.col("median_price_cents") > 30000, "mid-market price").otherwise("read reviews"))
