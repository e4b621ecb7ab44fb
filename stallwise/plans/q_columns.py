"""Derived columns over listings and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C
from stallwise.plans import views as V
from stallwise.plans.registry import query
from stallwise.plans.sqlviews import rnd

TIER8 = """CASE WHEN price_cents = 0 THEN 'Free' WHEN price_cents < 1000 THEN '$1-9' WHEN price_cents < 2000 THEN '$10-19'
    WHEN price_cents < 3000 THEN '$20-29' WHEN price_cents < 5000 THEN '$30-49' WHEN price_cents < 10000 THEN '$50-99'
    WHEN price_cents < 20000 THEN '$100-199' WHEN price_cents < 50000 THEN '$200-499' ELSE '$500+' END"""
TIER9 = TIER8.replace("CASE WHEN", "CASE WHEN price_cents IS NULL OR price_cents < 0 THEN 'Unknown' WHEN", 1)
BINS = """CASE WHEN price_cents <= 0 OR price_cents IS NULL OR price_cents > 9999900 THEN NULL WHEN price_cents <= 1000 THEN '$1-10'
    WHEN price_cents <= 2000 THEN '$11-20' WHEN price_cents <= 3000 THEN '$21-30' WHEN price_cents <= 5000 THEN '$31-50'
    WHEN price_cents <= 10000 THEN '$51-100' WHEN price_cents <= 20000 THEN '$101-200'
    WHEN price_cents <= 50000 THEN '$201-500' ELSE '$500+' END"""
VEL = """CASE WHEN coalesce(last_month_purchases, 0) = 0 THEN '0' WHEN last_month_purchases = 1 THEN '1'
    WHEN last_month_purchases <= 5 THEN '2-5' WHEN last_month_purchases <= 20 THEN '6-20' ELSE '>20' END"""
LIFE = """CASE WHEN coalesce(total_purchases, 0) = 0 THEN '0' WHEN total_purchases < 10 THEN '1-9' WHEN total_purchases < 50 THEN '10-49'
    WHEN total_purchases < 200 THEN '50-199' WHEN total_purchases < 1000 THEN '200-999' ELSE '1000+' END"""
MOMENTUM = "coalesce(coalesce(last_month_purchases, 0) * 1e2 / nullif(coalesce(total_purchases, 0), 0), 0e0)"


def _column(name, sql, column):
    query(name, f"SELECT app_key, {sql} AS value FROM listings")(
        lambda spark, sf: V.listings(spark, sf).select("app_key", column().alias("value")))


_column("col_price_usd", rnd("price_cents / 1e2", 2), lambda: C.price_usd())
_column("col_velocity_pct", f"coalesce({rnd('coalesce(last_month_purchases, 0) * 1e2 / nullif(total_purchases, 0)', 1)}, 0e0)", lambda: C.velocity_pct())
_column("col_gross", "coalesce(price_cents, 0) * coalesce(total_purchases, 0) / 1e2", lambda: C.gross())
_column("col_stale_flag", "coalesce(total_purchases, 0) > 50 AND coalesce(last_month_purchases, 0) = 0", lambda: C.stale_flag())
_column("col_tier8", TIER8, lambda: C.price_tier())
_column("col_tier9", TIER9, lambda: C.price_tier(unknown="Unknown"))
_column("col_tier_bins", BINS, lambda: C.price_bin())
_column("col_velocity_bucket", VEL, lambda: C.velocity_bucket())
_column("col_lifetime_bucket", LIFE, lambda: C.lifetime_bucket())
_column("col_badges", f"""array_to_string(list_filter(['v' || version, 'B2B', CASE WHEN price_cents > 0 THEN 'Paid' ELSE 'Free' END,
    CASE WHEN rating_stars >= 4.5 THEN 'Top-rated' END, CASE WHEN {MOMENTUM} >= 5 THEN 'Accelerating' END], lambda x: x IS NOT NULL), ',')""",
        lambda: F.array_join(C.badges(), ","))
_column("col_safe_trunc", "substring(display_name, 1, 5) || '|' || substring(summary, 1, 8)",
        lambda: F.concat(C.safe_trunc("display_name", 5), F.lit("|"), C.safe_trunc("summary", 8)))
_column("col_number_fmt", f"""format('{{:,}}', coalesce(total_purchases, 0)) || ' ' ||
    CASE WHEN coalesce(price_cents, 0) = 0 THEN 'Free' ELSE '$' || format('{{:,}}', {rnd('price_cents / 1e2')}::BIGINT) END || ' ' ||
    {rnd(MOMENTUM)}::BIGINT || '%'""",
        lambda: F.concat_ws(" ", C.fmt_int(C.zero("total_purchases")), C.fmt_price(), C.fmt_pct(C.momentum_pct())))


@query("col_app_key", "SELECT file_pos, version || '/' || tech_name AS app_key FROM listings")
def col_app_key(spark, sf):
    return V.listings(spark, sf).select("file_pos", C.app_key().alias("app_key"))


@query("col_engagement", "SELECT id, score + 2 * num_comments AS engagement FROM posts")
def col_engagement(spark, sf):
    return V.posts(spark, sf).select("id", C.engagement().alias("engagement"))


@query("col_md_link", """SELECT id, '[' || substring(trim(replace(translate(title, '[]', '()'), chr(10), ' ')), 1, 120)
    || '](' || permalink || ')' AS link FROM posts""")
def col_md_link(spark, sf):
    return V.posts(spark, sf).select("id", C.md_link().alias("link"))
