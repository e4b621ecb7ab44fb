"""Listing scores, cards and the day-one gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C, tokens as T
from stallwise.operators import scoring as S
from stallwise.plans import views as V
from stallwise.plans.q_niches import _KEPT, _TOKS
from stallwise.plans.registry import query
from stallwise.plans.sqlviews import rnd


def scored(spark, sf):
    return S.score_apps(V.listings(spark, sf))


@query("score_apps", "SELECT run_id, app_key, trend_score, opportunity_score FROM scored")
def score_apps(spark, sf):
    return scored(spark, sf).select("run_id", "app_key", "trend_score", "opportunity_score")


_JOINED = """SELECT s.app_key, a.version, s.display_name, s.trend_score, s.opportunity_score FROM scored s JOIN apps a USING (app_key)"""


@query("join_scores_3way", _JOINED)
def join_scores_3way(spark, sf):
    rows = V.listings(spark, sf)
    return S.three_way(S.score_apps(rows), V.apps(spark, sf), rows).select("app_key", "version", "display_name", "trend_score", "opportunity_score")


@query("join_scores_left", """SELECT l.app_key, CASE WHEN l.price_cents > 0 THEN s.opportunity_score END AS opportunity_score
    FROM listings l LEFT JOIN scored s USING (app_key)""")
def join_scores_left(spark, sf):
    rows = V.listings(spark, sf)
    some = S.score_apps(rows).filter(C.paid()).select("run_id", "app_key", "opportunity_score")
    return rows.join(some, ["run_id", "app_key"], "left").select("app_key", "opportunity_score")


@query("top_trends", "SELECT app_key, display_name, author, trend_score, opportunity_score FROM scored ORDER BY trend_score DESC, app_key LIMIT 20")
def top_trends(spark, sf):
    return S.top_trends(scored(spark, sf)).select("app_key", "display_name", "author", "trend_score", "opportunity_score")


@query("top_niche_apps", """SELECT app_key, opportunity_score FROM scored WHERE contains(lower(display_name), 'bolt') OR contains(lower(summary), 'bolt')
    ORDER BY opportunity_score DESC, app_key LIMIT 20""")
def top_niche_apps(spark, sf):
    return S.niche_apps(scored(spark, sf), "bolt").select("app_key", "opportunity_score")


@query("top_cards", "SELECT app_key FROM scored ORDER BY opportunity_score DESC, app_key LIMIT 10")
def top_cards(spark, sf):
    return S.top(scored(spark, sf), [S.desc("opportunity_score"), F.col("app_key")], 10).select("app_key")


@query("score_day1_gate", f"""SELECT net_revenue, authors_differ, weak::INT AS weak,
    CASE WHEN net_revenue > 2500 AND authors_differ AND weak >= 2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
    SELECT {rnd('sum(coalesce(last_month_purchases, 0) * coalesce(price_cents, 0)) / 1e2 * 0.7e0', 2)} AS net_revenue,
    count(author) FILTER (rn <= 3) = 3 AND count(DISTINCT author) FILTER (rn <= 3) = 3 AS authors_differ,
    count_if(rn <= 5 AND (coalesce(rating_stars < 4, false) OR coalesce(last_month_purchases, 0) = 0)) AS weak
    FROM (SELECT *, row_number() OVER (ORDER BY opportunity_score DESC, app_key) AS rn FROM scored WHERE contains(lower(display_name), 'ring')) WHERE rn <= 10)""")
def score_day1_gate(spark, sf):
    return S.day1_gate(scored(spark, sf).filter(F.lower("display_name").contains("ring")))


_CARDS = {"picked": "SELECT * FROM scored ORDER BY opportunity_score DESC, app_key LIMIT 10",
          "comp": f"""SELECT c.app_key, l.app_key AS comp_key, l.display_name AS comp_name, l.total_purchases, row_number() OVER (PARTITION BY c.app_key
            ORDER BY l.total_purchases DESC NULLS LAST, l.app_key) AS rank FROM (SELECT app_key, lower(coalesce({_KEPT(T.CARD_STOPWORDS, 3)}, {_TOKS}[1])) AS kw
            FROM picked) c JOIN listings l ON contains(lower(l.display_name), c.kw) AND l.app_key <> c.app_key QUALIFY rank <= 3"""}


@query("join_competitors", "SELECT app_key, comp_key, rank FROM comp", _CARDS)
def join_competitors(spark, sf):
    rows = scored(spark, sf)
    return S.competitors(S.top(rows, [S.desc("opportunity_score"), F.col("app_key")], 10), rows).select("app_key", "comp_key", "rank")


_MOM = "coalesce(coalesce(last_month_purchases, 0) * 1e2 / nullif(total_purchases, 0), 0e0)"


@query("score_card", f"""SELECT app_key, {rnd('opportunity_score / 10', 1)} AS opportunity, {rnd('trend_score / 10', 1)} AS trend,
    {rnd(f'least(10, {_MOM})', 1)} AS timing, {rnd(_MOM, 2)} AS momentum_pct,
    {rnd('coalesce(price_cents, 0) * coalesce(last_month_purchases, 0) / 1e2', 2)} AS monthly_revenue,
    (SELECT string_agg(comp_name || ':' || coalesce(total_purchases, 0), ';' ORDER BY rank) FROM comp WHERE comp.app_key = picked.app_key) AS competitors
    FROM picked""", _CARDS)
def score_card(spark, sf):
    c = S.cards(scored(spark, sf))
    joined = F.array_join(F.transform("competitors", lambda r: F.concat(r["name"], F.lit(":"), r["total"].cast("string"))), ";")
    return c.select("app_key", "scores.opportunity", "scores.trend", "scores.timing", "demand.momentum_pct", "pricing.monthly_revenue", joined.alias("competitors"))
