"""Market sizing, publishers, first-word niches and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C, match as M
from stallwise.operators import market as K
from stallwise.plans import views as V
from stallwise.plans.q_columns import BINS, LIFE, TIER8, TIER9, VEL
from stallwise.plans.registry import query
from stallwise.plans.sqlviews import rnd

REGION = ["brand#1"]  # substring of an author name, as a publisher list would be
PAID = "coalesce(price_cents > 0, false)"
GROSS = "coalesce(price_cents, 0) * coalesce(total_purchases, 0) / 1e2"
GROSS_LM = "coalesce(price_cents, 0) * coalesce(last_month_purchases, 0) / 1e2"
SUM = lambda c: f"coalesce(sum({c}), 0)::BIGINT"
BEST = {
    "latest": "SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY app_key ORDER BY captured_at DESC) = 1",
    "best": """SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY author, tech_name
        ORDER BY total_purchases DESC NULLS LAST, version DESC, app_key DESC) = 1""",
}
FW = {"fw": "SELECT *, split_part(lower(display_name), ' ', 1) AS word FROM listings"}


def best(spark, sf):
    return K.best_per_app(K.latest_per_app(V.snapshots(spark, sf)))


@query("flt_latest_run", "SELECT app_key, run_id FROM listings")
def flt_latest_run(spark, sf):
    return K.latest_run(V.snapshots(spark, sf), V.runs(spark, sf)).select("app_key", "run_id")


@query("agg_market_sizing", f"""SELECT count(*) AS listings, count_if({PAID}) AS paid, count(*) - count_if({PAID}) AS free,
    count(DISTINCT author) AS publishers, count(DISTINCT CASE WHEN {PAID} THEN author END) AS paid_publishers,
    count_if(version = '17.0') AS version_listings, count_if(coalesce(last_month_purchases, 0) > 0) AS sold_last_month,
    count_if(coalesce(total_purchases, 0) = 0) AS never_sold FROM snapshots""")
def agg_market_sizing(spark, sf):
    return K.market_sizing(V.snapshots(spark, sf), "17.0")


@query("agg_price_percentiles", "SELECT " + ", ".join(
    rnd(f"quantile_cont(price_cents, {p}) / 1e2", 2) + f" AS {n}" for n, p in K.PRICE_POINTS.items())
    + f", {rnd('avg(price_cents) / 1e2', 2)} AS mean FROM listings WHERE price_cents > 0")
def agg_price_percentiles(spark, sf):
    return K.price_percentiles(V.listings(spark, sf))


_METRICS = ("last_month_purchases", "review_count", "total_purchases")


@query("agg_run_percentiles", " UNION ALL ".join(
    f"SELECT '{c}' AS metric, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.9) AS p90, max({c})::DOUBLE AS max FROM listings"
    for c in _METRICS))
def agg_run_percentiles(spark, sf):
    return K.run_percentiles(V.listings(spark, sf), _METRICS)


def _buckets_sql(labels, expr):
    values = ", ".join(f"({i}, '{b}')" for i, b in enumerate(labels))
    return f"""SELECT pos, bucket, cnt, {rnd('cnt * 1e2 / nullif(sum(cnt) OVER (), 0)', 1)} AS pct FROM (
        SELECT d.pos, d.bucket, count(b.bucket) AS cnt FROM (VALUES {values}) d(pos, bucket)
        LEFT JOIN (SELECT {expr} AS bucket FROM listings) b USING (bucket) GROUP BY 1, 2)"""


@query("agg_velocity_buckets", _buckets_sql(C.VELOCITY_BUCKETS, VEL))
def agg_velocity_buckets(spark, sf):
    return K.bucket_counts(V.listings(spark, sf), C.velocity_bucket(), C.VELOCITY_BUCKETS)


@query("agg_lifetime_buckets", _buckets_sql(C.LIFETIME_BUCKETS, LIFE))
def agg_lifetime_buckets(spark, sf):
    return K.bucket_counts(V.listings(spark, sf), C.lifetime_bucket(), C.LIFETIME_BUCKETS)


_TIER_SQL = lambda expr, floor: f"""SELECT {expr} AS tier, count(*) AS listings, {SUM('total_purchases')} AS sales,
    {rnd('coalesce(sum(total_purchases), 0) / count(*)', 1)} AS sales_per_listing, {SUM('last_month_purchases')} AS last_month,
    min(coalesce(price_cents, {floor})) AS min_price FROM listings GROUP BY 1"""


@query("agg_price_tiers", _TIER_SQL(TIER8, 0))
def agg_price_tiers(spark, sf):
    return K.price_tiers(V.listings(spark, sf), C.price_tier(), 0)


@query("sort_tier_min_price", _TIER_SQL(TIER9, -1))
def sort_tier_min_price(spark, sf):
    return K.price_tiers(V.listings(spark, sf), C.price_tier("Unknown"), -1)


@query("agg_price_bins", f"""SELECT d.pos, d.bin, count(l.app_key) AS listings, {SUM('l.total_purchases')} AS sales
    FROM (VALUES {', '.join(f"({i}, '{b}')" for i, b in enumerate(C.PRICE_BIN_LABELS))}) d(pos, bin)
    LEFT JOIN (SELECT *, {BINS} AS bin FROM listings WHERE price_cents > 0) l USING (bin) GROUP BY 1, 2""")
def agg_price_bins(spark, sf):
    return K.price_bins(V.listings(spark, sf))


@query("agg_publishers_portfolio", f"""SELECT author, count(*) AS listings, {SUM('last_month_purchases')} AS last_month,
    {SUM('total_purchases')} AS lifetime, {rnd(f'sum({GROSS_LM})', 2)} AS last_month_gross FROM listings WHERE author IS NOT NULL
    GROUP BY 1 ORDER BY listings DESC, author LIMIT 20""")
def agg_publishers_portfolio(spark, sf):
    return K.publishers_portfolio(V.listings(spark, sf))


@query("win_latest_snapshot", "SELECT app_key, run_id, total_purchases FROM latest", BEST)
def win_latest_snapshot(spark, sf):
    return K.latest_per_app(V.snapshots(spark, sf)).select("app_key", "run_id", "total_purchases")


@query("win_best_version", "SELECT author, tech_name, version, app_key, total_purchases FROM best", BEST)
def win_best_version(spark, sf):
    return best(spark, sf).select("author", "tech_name", "version", "app_key", "total_purchases")


def _gross_sql(units, gross):
    return f"""SELECT author, count(*) AS apps, {SUM(units)} AS units, {rnd(f'sum({gross})', 2)} AS gross,
        {rnd('avg(nullif(price_cents, 0)) / 1e2', 2)} AS avg_paid_price FROM best WHERE author IS NOT NULL
        GROUP BY 1 HAVING sum({gross}) > 0 ORDER BY gross DESC, author LIMIT 25"""


@query("agg_publishers_lifetime", _gross_sql("total_purchases", GROSS), BEST)
def agg_publishers_lifetime(spark, sf):
    return K.publishers_gross(best(spark, sf), "total_purchases")


@query("agg_publishers_lastmo", _gross_sql("last_month_purchases", GROSS_LM), BEST)
def agg_publishers_lastmo(spark, sf):
    return K.publishers_gross(best(spark, sf), "last_month_purchases")


@query("agg_author_leaderboard", f"""SELECT author, count(*) AS listings,
    {rnd('avg(CASE WHEN price_cents > 0 THEN price_cents END) / 1e2', 2)} AS avg_price, {SUM('total_purchases')} AS sales,
    {SUM('last_month_purchases')} AS last_month, {rnd('avg(rating_stars)', 2)} AS avg_rating, {SUM('review_count')} AS reviews
    FROM listings WHERE author IS NOT NULL GROUP BY 1 HAVING sum(total_purchases) > 0 ORDER BY sales DESC, author LIMIT 40""")
def agg_author_leaderboard(spark, sf):
    return K.author_leaderboard(V.listings(spark, sf))


@query("agg_author_drill", f"""SELECT app_key, author, {rnd('price_cents / 1e2', 2)} AS price_usd, coalesce(total_purchases, 0) AS sales,
    {rnd('coalesce(last_month_purchases, 0) * 1e2 / nullif(total_purchases, 0)', 1)} AS velocity_pct,
    count(*) OVER () AS match_count, (sum(total_purchases) OVER ())::BIGINT AS match_sales
    FROM listings WHERE lower(author) LIKE '%brand#7%'""")
def agg_author_drill(spark, sf):
    return K.author_drill(V.listings(spark, sf), "Brand#7")


@query("flt_author_partial", "SELECT app_key, author FROM listings WHERE author ILIKE '%rand#2%'")
def flt_author_partial(spark, sf):
    return V.listings(spark, sf).filter(M.contains(["author"], ["rand#2"])).select("app_key", "author")


@query("flt_author_like_list", """SELECT author LIKE '%Brand#1%' AS listed, count(*) AS listings FROM listings
    WHERE author IS NOT NULL GROUP BY 1""")
def flt_author_like_list(spark, sf):
    return (V.listings(spark, sf).filter(F.col("author").isNotNull()).groupBy(M.contains(["author"], REGION).alias("listed"))
            .agg(F.count(F.lit(1)).alias("listings")))


@query("agg_price_histogram", """SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((p - lo) / ((hi - lo) / 20e0)), 19) END::INT AS bin,
    count(*) AS listings FROM (SELECT price_cents / 1e2 AS p, min(price_cents / 1e2) OVER () AS lo, max(price_cents / 1e2) OVER () AS hi
    FROM listings WHERE author = 'Brand#7' AND price_cents > 0) GROUP BY 1""")
def agg_price_histogram(spark, sf):
    return K.author_price_histogram(V.listings(spark, sf), "Brand#7")


@query("join_portfolios", f"""SELECT author, app_key, gross, rank FROM (SELECT author, app_key, {rnd(GROSS, 2)} AS gross,
    row_number() OVER (PARTITION BY author ORDER BY {rnd(GROSS, 2)} DESC, total_purchases DESC NULLS LAST, app_key) AS rank FROM best
    WHERE author IN (SELECT author FROM best WHERE author IS NOT NULL GROUP BY 1 HAVING sum({GROSS}) > 0
                     ORDER BY {rnd(f'sum({GROSS})', 2)} DESC, author LIMIT 25)) WHERE rank <= 15""", BEST)
def join_portfolios(spark, sf):
    return K.portfolios(best(spark, sf)).select("author", "app_key", "gross", "rank")


@query("agg_region_position", f"""SELECT CASE WHEN author LIKE '%Brand#1%' THEN 'region' ELSE 'rest' END AS side, count(*) AS listings,
    count(DISTINCT author) AS publishers, {SUM('total_purchases')} AS units, {rnd(f'sum({GROSS})', 2)} AS gross,
    {rnd('quantile_cont(CASE WHEN price_cents > 0 THEN price_cents END, 0.5) / 1e2', 2)} AS median_price
    FROM listings WHERE author IS NOT NULL GROUP BY 1""")
def agg_region_position(spark, sf):
    return K.region_position(V.listings(spark, sf), M.contains(["author"], REGION))


@query("agg_region_publishers", f"""SELECT author, count(*) AS listings, {SUM('total_purchases')} AS units, {rnd(f'sum({GROSS})', 2)} AS gross
    FROM listings WHERE author LIKE '%Brand#1%' GROUP BY 1""")
def agg_region_publishers(spark, sf):
    return K.region_publishers(V.listings(spark, sf), M.contains(["author"], REGION))


@query("agg_hotspots", f"""SELECT word, count(*) AS listings, {SUM('last_month_purchases')} AS last_month,
    {rnd('coalesce(sum(last_month_purchases), 0) / count(*)', 2)} AS velocity_per_listing, {rnd('avg(price_cents) / 1e2', 2)} AS avg_price,
    {rnd('avg(CASE WHEN rating_stars > 0 THEN rating_stars END)', 2)} AS avg_rating,
    {rnd('count_if(coalesce(total_purchases, 0) = 0) * 1e2 / count(*)', 1)} AS dead_pct FROM fw WHERE price_cents > 0
    GROUP BY 1 HAVING count(*) >= 3 AND sum(last_month_purchases) > 0 ORDER BY velocity_per_listing DESC, word LIMIT 20""", FW)
def agg_hotspots(spark, sf):
    return K.hotspots(V.listings(spark, sf))


@query("agg_hidden_gems", f"""SELECT tech_name AS word, count(*) AS listings, {SUM('total_purchases')} AS sales,
    {rnd('coalesce(sum(total_purchases), 0) / count(*)', 1)} AS sales_per_listing FROM listings WHERE price_cents > 0 GROUP BY 1
    HAVING count(*) BETWEEN 2 AND 25 AND sum(total_purchases) > 100 ORDER BY sales_per_listing DESC, word LIMIT 25""")
def agg_hidden_gems(spark, sf):
    # One-word names, so that niches are thin enough to hold gems at this scale.
    rows = V.listings(spark, sf).withColumn("display_name", F.col("tech_name"))
    return K.hidden_gems(rows, 2, 25)


@query("agg_monopolies", f"""SELECT niche, author, author_sales, niche_sales, {rnd('author_sales * 1e2 / nullif(niche_sales, 0)', 1)} AS share FROM (
    SELECT *, (sum(author_sales) OVER (PARTITION BY niche))::BIGINT AS niche_sales FROM (SELECT word || '|' || version || '|' || summary AS niche, author,
    {SUM('total_purchases')} AS author_sales FROM fw WHERE price_cents > 0 AND author IS NOT NULL GROUP BY 1, 2))
    WHERE niche_sales > 50 AND author_sales * 1e2 > niche_sales * 70""", FW)
def agg_monopolies(spark, sf):
    return K.monopolies(V.listings(spark, sf), F.concat_ws("|", K.first_word(), "version", "summary"))


@query("join_author_share", f"""SELECT niche, author, author_sales, niche_sales, {rnd('author_sales * 1e2 / nullif(niche_sales, 0)', 1)} AS share FROM (
    SELECT *, (sum(author_sales) OVER (PARTITION BY niche))::BIGINT AS niche_sales FROM (SELECT word AS niche, author,
    {SUM('total_purchases')} AS author_sales FROM fw WHERE price_cents > 0 AND author IS NOT NULL GROUP BY 1, 2))
    WHERE niche_sales > 50 AND author_sales * 1e2 > niche_sales * 5""", FW)
def join_author_share(spark, sf):
    return K.monopolies(V.listings(spark, sf), K.first_word(), share=5.0)


@query("agg_price_gap", f"""SELECT word, count(*) AS listings, {rnd('min(price_cents) / 1e2', 2)} AS min_price,
    {rnd('max(price_cents) / 1e2', 2)} AS max_price, {SUM('total_purchases')} AS sales FROM fw WHERE price_cents > 5000
    GROUP BY 1 HAVING count(*) >= 3 AND sum(total_purchases) > 50 ORDER BY sales DESC, word LIMIT 20""", FW)
def agg_price_gap(spark, sf):
    return K.price_gap(V.listings(spark, sf))


@query("flt_stale_incumbents", f"""SELECT app_key, author, {rnd('price_cents / 1e2')} AS price, total_purchases FROM snapshots
    WHERE price_cents > 0 AND total_purchases > 100 AND coalesce(last_month_purchases, 0) = 0 ORDER BY total_purchases DESC, app_key, price LIMIT 20""")
def flt_stale_incumbents(spark, sf):
    return K.stale_incumbents(V.snapshots(spark, sf))


@query("flt_activity_classes", f"""SELECT count_if(price_cents > 0) AS paid, count_if(price_cents = 0) AS free,
    count_if(coalesce(total_purchases, 0) = 0) AS dead, count_if(last_month_purchases > 0) AS active FROM listings""")
def flt_activity_classes(spark, sf):
    return V.listings(spark, sf).agg(F.count_if(C.paid()).alias("paid"), F.count_if(F.col("price_cents") == 0).alias("free"),
                                     F.count_if(C.dead()).alias("dead"), F.count_if(C.active()).alias("active"))


@query("flt_min_purchases", "SELECT app_key FROM listings WHERE coalesce(total_purchases, 0) >= 30")
def flt_min_purchases(spark, sf):
    return V.listings(spark, sf).filter(C.zero("total_purchases") >= 30).select("app_key")


@query("top_velocity_leaders", f"""SELECT app_key, total_purchases, last_month_purchases,
    {rnd('last_month_purchases * 1e2 / nullif(total_purchases, 0)', 1)} AS velocity_pct FROM listings
    WHERE total_purchases > 50 AND last_month_purchases > 0 ORDER BY velocity_pct DESC NULLS LAST, app_key LIMIT 25""")
def top_velocity_leaders(spark, sf):
    return K.velocity_leaders(V.listings(spark, sf))


@query("top_apps_gross", f"""SELECT app_key, author, {rnd(GROSS, 2)} AS gross FROM best
    WHERE price_cents > 0 AND total_purchases > 0 ORDER BY gross DESC, app_key LIMIT 60""", BEST)
def top_apps_gross(spark, sf):
    return K.top_gross(best(spark, sf), 60)


@query("top_apps_gross_raw", f"""SELECT app_key, author, {rnd(GROSS, 2)} AS gross FROM listings
    WHERE price_cents > 0 AND total_purchases > 0 ORDER BY gross DESC, app_key LIMIT 20""")
def top_apps_gross_raw(spark, sf):
    return K.top_gross(V.listings(spark, sf), 20)


@query("win_run_delta", """SELECT app_key, run_id, total_purchases,
    total_purchases - lag(total_purchases) OVER (PARTITION BY app_key ORDER BY captured_at) AS delta FROM snapshots""")
def win_run_delta(spark, sf):
    return K.run_delta(V.snapshots(spark, sf))


@query("win_share_of_total", f"""SELECT author, sales, {rnd('sales * 1e2 / nullif(sum(sales) OVER (), 0)', 3)} AS share FROM (
    SELECT author, {SUM('total_purchases')} AS sales FROM listings GROUP BY 1)""")
def win_share_of_total(spark, sf):
    rows = V.listings(spark, sf)
    whole = rows.agg(K.total("total_purchases").alias("t")).scalar()
    return rows.groupBy("author").agg(K.total("total_purchases").alias("sales")).select(
        "author", "sales", C.rnd(C.safe_div(F.col("sales") * 100.0, whole), 3).alias("share"))


@query("join_snapshots_apps", """SELECT s.app_key, a.version, s.total_purchases FROM listings s JOIN apps a USING (app_key)
    WHERE a.version IN ('17.0', '18.0')""")
def join_snapshots_apps(spark, sf):
    apps = V.apps(spark, sf).select("app_key", "version").filter(F.col("version").isin("17.0", "18.0"))
    return V.listings(spark, sf).drop("version").join(apps, "app_key").select("app_key", "version", "total_purchases")
