"""Market-wide sizing, distributions, leaderboards and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallwise.functions import columns as C, exact
from stallwise.functions.columns import rnd, safe_div, zero


def latest_run(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the run that started last; a scalar subquery prunes run partitions."""
    newest = runs.agg(F.max_by("run_id", "started_at").alias("run_id")).scalar()
    return snapshots.filter(F.col("run_id") == newest)


def total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First n rows per key; Spark drops the rest of a hot key before the shuffle."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)


def desc(c: str) -> Column:
    return F.col(c).desc_nulls_last()


def best_rows(df: DataFrame, keys: Sequence[str], best: Column) -> DataFrame:
    """One whole row per key, the one with the greatest ``best``; combined map-side."""
    return (df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
            .agg(F.max_by(F.struct(*df.columns), best).alias("_row")).select("_row.*"))


# ---- sizing and distributions ------------------------------------------------

def market_sizing(snapshots: DataFrame, version: str) -> DataFrame:
    """Totals of the market; combined per publisher first, so distinct counts need no copies of the rows."""
    per_author = snapshots.groupBy("author").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C.paid()).alias("p"), F.count_if(F.col("version") == version).alias("v"),
        F.count_if(C.active()).alias("s"), F.count_if(C.dead()).alias("d"))
    return per_author.agg(
        total("n").alias("listings"), total("p").alias("paid"), (total("n") - total("p")).alias("free"), F.count("author").alias("publishers"),
        F.count_if(F.col("author").isNotNull() & (F.col("p") > 0)).alias("paid_publishers"), total("v").alias("version_listings"),
        total("s").alias("sold_last_month"), total("d").alias("never_sold"))


PRICE_POINTS = {"p10": .10, "p25": .25, "p50": .50, "p75": .75, "p90": .90, "p95": .95, "p99": .99}


def price_percentiles(snapshots: DataFrame) -> DataFrame:
    """Exact percentiles and mean of paid prices, in dollars."""
    paid = snapshots.filter(C.paid())
    q = exact.quantiles(paid, [], "price_cents", PRICE_POINTS)
    mean = paid.agg(rnd(F.avg("price_cents") / 100.0, 2).alias("mean")).scalar()
    return q.select(*[rnd(F.col(n) / 100.0, 2).alias(n) for n in PRICE_POINTS], mean.alias("mean"))


def run_percentiles(snapshots: DataFrame, columns: Sequence[str]) -> DataFrame:
    """p50, p90 and max of several columns in one pass over long form."""
    long = snapshots.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select("m.*")
    return exact.quantiles(long, ["metric"], "v", {"p50": .5, "p90": .9, "max": 1.0})


def bucket_counts(snapshots: DataFrame, bucket: Column, labels: Sequence[str]) -> DataFrame:
    """Rows and share per bucket; buckets without rows stay with 0."""
    counts = snapshots.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))
    dim = snapshots.sparkSession.createDataFrame([(i, b) for i, b in enumerate(labels)], "pos int, bucket string")
    filled = dim.join(counts, "bucket", "left").withColumn("cnt", zero("cnt"))
    whole = F.sum("cnt").over(W.partitionBy(F.lit(0)))  # a handful of bucket rows
    return filled.select("pos", "bucket", "cnt", rnd(safe_div(F.col("cnt") * 100.0, whole), 1).alias("pct"))


def price_tiers(snapshots: DataFrame, tier: Column, floor: int) -> DataFrame:
    """Per tier, ordered by its lowest price; ``floor`` stands in for an unknown price."""
    return snapshots.groupBy(tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("listings"), total("total_purchases").alias("sales"),
        rnd(safe_div(total("total_purchases"), F.count(F.lit(1))), 1).alias("sales_per_listing"),
        total("last_month_purchases").alias("last_month"),
        F.min(F.coalesce("price_cents", F.lit(floor))).alias("min_price")).orderBy("min_price", "tier")


def price_bins(snapshots: DataFrame) -> DataFrame:
    agg = snapshots.filter(C.paid()).groupBy(C.price_bin().alias("bin")).agg(
        F.count(F.lit(1)).alias("listings"), total("total_purchases").alias("sales"))
    dim = snapshots.sparkSession.createDataFrame(list(enumerate(C.PRICE_BIN_LABELS)), "pos int, bin string")
    return dim.join(agg, "bin", "left").fillna(0, ["listings", "sales"])


def author_price_histogram(snapshots: DataFrame, author: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the author's lowest and highest paid price."""
    own = snapshots.filter((F.col("author") == author) & C.paid()).select((F.col("price_cents") / 100.0).alias("p"))
    lo, hi = own.agg(F.min("p")).scalar(), own.agg(F.max("p")).scalar()
    width = (hi - lo) / float(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("p") - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return own.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("listings"))


# ---- publishers --------------------------------------------------------------

def publishers_portfolio(snapshots: DataFrame, n: int = 20) -> DataFrame:
    agg = snapshots.filter(F.col("author").isNotNull()).groupBy("author").agg(
        F.count(F.lit(1)).alias("listings"), total("last_month_purchases").alias("last_month"),
        total("total_purchases").alias("lifetime"), rnd(total(C.gross("last_month_purchases")), 2).alias("last_month_gross"))
    return top(agg, [desc("listings"), F.col("author")], n)


def latest_per_app(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot of each listing (ties: greatest run id)."""
    return best_rows(snapshots, ["app_key"], F.struct("captured_at", "run_id"))


def best_per_app(latest: DataFrame) -> DataFrame:
    """One row per (author, tech_name): most sales, then greatest version string, then key."""
    return best_rows(latest, ["author", "tech_name"],
                     F.struct(F.coalesce("total_purchases", F.lit(-1)), "version", "app_key"))


def publishers_gross(best: DataFrame, units: str, n: int = 25) -> DataFrame:
    """Publishers by gross over their best rows; only those that earned something."""
    agg = best.filter(F.col("author").isNotNull()).groupBy("author").agg(
        F.count(F.lit(1)).alias("apps"), total(units).alias("units"), rnd(total(C.gross(units)), 2).alias("gross"),
        rnd(F.avg(F.nullif("price_cents", F.lit(0))) / 100.0, 2).alias("avg_paid_price"))
    return top(agg.filter(F.col("gross") > 0), [desc("gross"), F.col("author")], n)


def author_leaderboard(snapshots: DataFrame, n: int = 40) -> DataFrame:
    agg = snapshots.filter(F.col("author").isNotNull()).groupBy("author").agg(
        F.count(F.lit(1)).alias("listings"),
        rnd(F.avg(F.when(C.paid(), F.col("price_cents"))) / 100.0, 2).alias("avg_price"),
        total("total_purchases").alias("sales"), total("last_month_purchases").alias("last_month"),
        rnd(F.avg("rating_stars"), 2).alias("avg_rating"), total("review_count").alias("reviews"))
    return top(agg.filter("sales > 0"), [desc("sales"), F.col("author")], n)


def author_drill(snapshots: DataFrame, part: str) -> DataFrame:
    """Listings of the authors whose name contains ``part``, with the match totals."""
    hit = snapshots.filter(F.lower("author").contains(part.lower()))
    facts = hit.agg(F.struct(F.count(F.lit(1)).alias("n"), total("total_purchases").alias("t")).alias("s")).scalar()
    return hit.select("app_key", "author", C.price_usd().alias("price_usd"), zero("total_purchases").alias("sales"),
                      C.velocity_pct(True).alias("velocity_pct"), facts.getField("n").alias("match_count"),
                      facts.getField("t").alias("match_sales"))


def portfolios(best: DataFrame, authors: int = 25, per_author: int = 15) -> DataFrame:
    """The best listings of the biggest publishers."""
    leaders = publishers_gross(best, "total_purchases", authors).select("author")
    own = best.join(leaders, "author", "left_semi").withColumn("gross", rnd(C.gross(), 2))
    return rank_within(own, ["author"], [desc("gross"), desc("total_purchases"), F.col("app_key")], per_author)


def region_position(snapshots: DataFrame, is_region: Column) -> DataFrame:
    """Regional publishers against the rest; listings without an author are on neither side."""
    sided = snapshots.filter(F.col("author").isNotNull()).withColumn("side", F.when(is_region, "region").otherwise("rest"))
    agg = sided.groupBy("side").agg(
        F.count(F.lit(1)).alias("listings"), F.countDistinct("author").alias("publishers"),
        total("total_purchases").alias("units"), rnd(total(C.gross()), 2).alias("gross"))
    med = exact.quantiles(sided.filter(C.paid()), ["side"], "price_cents", {"m": .5})
    return agg.join(med, "side", "left").withColumn("median_price", rnd(F.col("m") / 100.0, 2)).drop("m")


def region_publishers(snapshots: DataFrame, is_region: Column) -> DataFrame:
    return snapshots.filter(is_region).groupBy("author").agg(
        F.count(F.lit(1)).alias("listings"), total("total_purchases").alias("units"), rnd(total(C.gross()), 2).alias("gross")
    ).orderBy(desc("gross"), desc("listings"), "author")


# ---- first-word niches -------------------------------------------------------

def first_word() -> Column:
    return F.split_part(F.lower("display_name"), F.lit(" "), F.lit(1))


def hotspots(snapshots: DataFrame, n: int = 20) -> DataFrame:
    agg = snapshots.filter(C.paid()).groupBy(first_word().alias("word")).agg(
        F.count(F.lit(1)).alias("listings"), total("last_month_purchases").alias("last_month"),
        rnd(safe_div(total("last_month_purchases"), F.count(F.lit(1))), 2).alias("velocity_per_listing"),
        rnd(F.avg("price_cents") / 100.0, 2).alias("avg_price"),
        rnd(F.avg(F.when(F.col("rating_stars") > 0, F.col("rating_stars"))), 2).alias("avg_rating"),
        rnd(safe_div(F.count_if(C.dead()) * 100.0, F.count(F.lit(1))), 1).alias("dead_pct"))
    return top(agg.filter("listings >= 3 AND last_month > 0"), [desc("velocity_per_listing"), F.col("word")], n)


def hidden_gems(snapshots: DataFrame, lo: int = 2, hi: int = 5, min_sales: int = 100, n: int = 25) -> DataFrame:
    agg = snapshots.filter(C.paid()).groupBy(first_word().alias("word")).agg(
        F.count(F.lit(1)).alias("listings"), total("total_purchases").alias("sales"),
        rnd(safe_div(total("total_purchases"), F.count(F.lit(1))), 1).alias("sales_per_listing"))
    keep = F.col("listings").between(lo, hi) & (F.col("sales") > min_sales)
    return top(agg.filter(keep), [desc("sales_per_listing"), F.col("word")], n)


def monopolies(snapshots: DataFrame, niche: Column, share: float = 70.0, min_sales: int = 50) -> DataFrame:
    """Authors above ``share`` percent of a niche; the niche total is a window over author sums."""
    per_author = snapshots.filter(C.paid() & F.col("author").isNotNull()).groupBy(niche.alias("niche"), "author").agg(
        total("total_purchases").alias("author_sales"))
    niche_sales = per_author.groupBy("niche").agg(F.sum("author_sales").alias("niche_sales")).filter(F.col("niche_sales") > min_sales)
    out = per_author.join(niche_sales, "niche").withColumn("share", rnd(safe_div(F.col("author_sales") * 100.0, F.col("niche_sales")), 1))
    return out.filter(F.col("author_sales") * 100.0 > F.col("niche_sales") * share)


def price_gap(snapshots: DataFrame, n: int = 20) -> DataFrame:
    agg = snapshots.filter(F.col("price_cents") > 5000).groupBy(first_word().alias("word")).agg(
        F.count(F.lit(1)).alias("listings"), rnd(F.min("price_cents") / 100.0, 2).alias("min_price"),
        rnd(F.max("price_cents") / 100.0, 2).alias("max_price"), total("total_purchases").alias("sales"))
    return top(agg.filter("listings >= 3 AND sales > 50"), [desc("sales"), F.col("word")], n)


# ---- top lists ---------------------------------------------------------------

def stale_incumbents(snapshots: DataFrame, n: int = 20) -> DataFrame:
    hit = snapshots.filter(C.paid() & (F.col("total_purchases") > 100) & (zero("last_month_purchases") == 0))
    return top(hit.select("app_key", "author", C.price_usd(places=0).alias("price"), "total_purchases"),
               [desc("total_purchases"), F.col("app_key")], n)


def velocity_leaders(snapshots: DataFrame, n: int = 25) -> DataFrame:
    hit = snapshots.filter((F.col("total_purchases") > 50) & (F.col("last_month_purchases") > 0))
    return top(hit.select("app_key", "total_purchases", "last_month_purchases", C.velocity_pct(True).alias("velocity_pct")),
               [desc("velocity_pct"), F.col("app_key")], n)


def top_gross(rows: DataFrame, n: int = 20) -> DataFrame:
    hit = rows.filter(C.paid() & (F.col("total_purchases") > 0))
    return top(hit.select("app_key", "author", rnd(C.gross(), 2).alias("gross")), [desc("gross"), F.col("app_key")], n)


def run_delta(snapshots: DataFrame) -> DataFrame:
    """Change in lifetime sales since the listing's previous run (an extension)."""
    by_app = W.partitionBy("app_key").orderBy("captured_at")
    prev = F.lag("total_purchases").over(by_app)
    return snapshots.select("app_key", "run_id", "total_purchases", (F.col("total_purchases") - prev).alias("delta"))
