"""Idea validation, labels and planning numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C, match as M
from stallwise.functions.match import niche
from stallwise.operators import market as K, validate as X
from stallwise.plans import views as V
from stallwise.plans.registry import query
from stallwise.plans.sqlviews import rnd

WORDS = X.Words(deadline=("widget",), migration=("anvil", "rod"), migrators={"anvil": 80, "cold": 65, "gizmo": 50})
IDEAS = [niche("bolts", "bolt", "rod"), niche("widgets", "widget"), niche("anvils", "anvil"), niche("gear pair", "cold gear", "hot gear"),
         niche("small plate", "small plate"), niche("old", "old "), niche("airships", "zeppelin")]
HIGH, MEDIUM = ["anvil", "rod"], ["widget", "gear"]
EFFORTS = [(["gear"], 3, "connector", "3-4"), (["old", "plate"], 1, "report", "1-2")]
OWN = {"widget": "widgets", "old": "archive"}

_ORS = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def sub_sql(src: str, text: str) -> str:
    """The sub-scores in DuckDB, over a relation with the niche facts."""
    proxy = "greatest(0, " + ", ".join(f"CASE WHEN contains({text}, '{w}') THEN {v} ELSE 0 END" for w, v in WORDS.migrators.items()) + ")"
    return f"""SELECT *, trunc(sat * 0.10e0 + demand * 0.20e0 + dead_health * 0.12e0 + momentum * 0.28e0 + forced_buyer * 0.13e0 + rating_score * 0.17e0)::INT AS viability
    FROM (SELECT *, CASE WHEN dead_pct >= 0.80e0 AND n > 3 THEN least(sat0, 35) ELSE sat0 END AS sat, least(90, pace + bonus) AS momentum FROM (
    SELECT *, CASE WHEN n = 0 THEN 50 WHEN n <= 3 THEN 90 WHEN n <= 8 THEN 75 WHEN n <= 20 THEN 55 WHEN n <= 50 THEN 35 ELSE 15 END AS sat0,
      CASE WHEN is_migrator THEN {proxy} WHEN avg_s > 500 THEN 90 WHEN avg_s > 200 THEN 75 WHEN avg_s > 80 THEN 60 WHEN avg_s > 20 THEN 40 WHEN avg_s > 5 THEN 25 ELSE 10 END AS demand,
      CASE WHEN is_migrator THEN 70 WHEN velocity_per_app > 10 THEN 90 WHEN velocity_per_app > 5 THEN 80 WHEN velocity_per_app > 2 THEN 65 WHEN velocity_per_app > 0.5 THEN 45 WHEN velocity_per_app > 0.1 THEN 25 ELSE 10 END AS pace,
      least(20, trunc(velocity / greatest(total, 1) * 200e0)::INT) AS bonus,
      CASE WHEN n <= 3 THEN 50 WHEN dead_pct <= 0.40 THEN 85 WHEN dead_pct <= 0.55 THEN 65 WHEN dead_pct <= 0.70 THEN 45 WHEN dead_pct <= 0.85 THEN 25 ELSE 10 END AS dead_health,
      CASE WHEN {_ORS(text, WORDS.deadline)} THEN 90 WHEN {_ORS(text, WORDS.migration)} THEN 70 ELSE 10 END AS forced_buyer,
      CASE WHEN avg_rating > 0 THEN trunc(avg_rating / 5e0 * 1e2)::INT ELSE 50 END AS rating_score
    FROM (SELECT *, dead / n AS dead_pct, {_ORS(text, WORDS.migrators)} AS is_migrator, total / greatest(active, 1) AS avg_s, velocity / greatest(active, 1) AS velocity_per_app FROM {src})))"""


IDEA = {
    "ideas": "SELECT * FROM (VALUES " + ", ".join(f"('{i.label}', '{k}', '{', '.join(i.keywords)}')" for i in IDEAS for k in i.keywords) + ") t(label, kw, idea)",
    "idea_hits": """SELECT n.label, n.idea, l.*, coalesce(total_purchases, 0) AS t, coalesce(last_month_purchases, 0) AS lm FROM (SELECT DISTINCT label, idea FROM ideas) n
        JOIN listings l ON EXISTS (SELECT 1 FROM ideas k WHERE k.label = n.label AND contains(lower(l.display_name), k.kw))""",
    "idea_top": "SELECT label, max(s) AS best FROM (SELECT label, author, sum(t) AS s FROM idea_hits WHERE author IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "idea_facts": f"""SELECT label, idea, count(*) AS n, sum(t)::BIGINT AS total, sum(lm)::BIGINT AS velocity, count_if(t = 0) AS dead, count_if(lm > 0) AS active,
        count_if(price_cents > 0) AS paid, count_if(price_cents > 0 AND price_cents <= 3000) AS low, coalesce(sum(t) FILTER (price_cents > 0), 0)::BIGINT AS paid_total,
        coalesce(sum(lm) FILTER (price_cents > 0), 0)::BIGINT AS paid_velocity, count_if(price_cents > 0 AND t > 50 AND lm = 0) AS stale,
        coalesce(sum(t) FILTER (price_cents > 0 AND t > 50 AND lm = 0), 0)::BIGINT AS stranded,
        coalesce(sum(price_cents) FILTER (price_cents > 0) / nullif(count_if(price_cents > 0), 0) / 1e2, 0e0) AS avg_price,
        coalesce((SELECT best FROM idea_top x WHERE x.label = h.label) * 1e2 / nullif(sum(t), 0), 0e0) AS top_share,
        sum(coalesce(rating_stars, 0e0)) / count(*) AS avg_rating, {rnd('sum(lm) / greatest(sum(t), 1) * 1e2', 1)} AS recency_pct FROM idea_hits h GROUP BY 1, 2""",
    "idea_scores": sub_sql("idea_facts", "idea"),
}


def facts(spark, sf):
    return X.idea_metrics(V.listings(spark, sf), IDEAS)


def scores(spark, sf):
    return X.sub_scores(facts(spark, sf), F.col("idea"), WORDS)


_FC = "label, n, total, velocity, dead, active, paid, low, paid_total, paid_velocity, stale, stranded"


@query("agg_validate_metrics", f"SELECT {_FC}, recency_pct, {rnd('avg_price', 4)} AS avg_price, {rnd('top_share', 4)} AS top_share, {rnd('avg_rating', 4)} AS avg_rating FROM idea_facts", IDEA)
def agg_validate_metrics(spark, sf):
    return facts(spark, sf).select(*_FC.split(", "), "recency_pct", *[C.rnd(F.col(c), 4).alias(c) for c in ("avg_price", "top_share", "avg_rating")])


_SC = "label, sat, demand, dead_health, momentum, forced_buyer, rating_score, viability, is_migrator"


@query("score_viability", f"SELECT {_SC} FROM idea_scores", IDEA)
def score_viability(spark, sf):
    return scores(spark, sf).select(*_SC.split(", "))


@query("score_gap_moat", """SELECT label, CASE WHEN paid = 0 THEN 50 WHEN low = 0 THEN 80 WHEN low <= 3 THEN 60 WHEN low <= 8 THEN 40 ELSE 20 END AS gap,
    CASE WHEN stale >= 2 AND paid > 0 AND stale / paid >= 0.5 THEN least(95, m + 15) ELSE m END AS moat FROM (SELECT *,
    CASE WHEN top_share > 60 THEN 20 WHEN top_share > 40 THEN 45 WHEN top_share > 20 THEN 65 ELSE 85 END AS m FROM idea_facts)""", IDEA)
def score_gap_moat(spark, sf):
    return X.gap_moat(facts(spark, sf)).select("label", "gap", "moat")


@query("label_verdict", """SELECT label, CASE WHEN viability >= 52 THEN 'LAUNCH CANDIDATE' WHEN viability >= 47 THEN 'CONSIDER' WHEN viability >= 42 THEN 'INVESTIGATE'
    ELSE 'SCREEN OUT' END AS verdict FROM idea_scores""", IDEA)
def label_verdict(spark, sf):
    return scores(spark, sf).select("label", X.verdict(F.col("viability")).alias("verdict"))


@query("score_success_prob", f"SELECT label, {rnd('1e2 / (1e0 + exp(-(0.1515e0 * viability + -8.519e0)))', 1)} AS p FROM idea_scores", IDEA)
def score_success_prob(spark, sf):
    return scores(spark, sf).select("label", X.success_probability(F.col("viability")).alias("p"))


@query("score_sizing", """SELECT label, floor(paid_total * avg_price)::BIGINT AS sam, floor(paid_velocity * avg_price)::BIGINT AS monthly_revenue,
    floor(floor(paid_velocity * avg_price) * 12 * 0.05e0)::BIGINT AS som_year1 FROM idea_facts""", IDEA)
def score_sizing(spark, sf):
    return X.sizing(facts(spark, sf)).select("label", "sam", "monthly_revenue", "som_year1")


_TEXT = "lower(display_name || ' ' || summary)"


@query("label_reg_risk", f"SELECT app_key, CASE WHEN {_ORS(_TEXT, HIGH)} THEN 'HIGH' WHEN {_ORS(_TEXT, MEDIUM)} THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM listings")
def label_reg_risk(spark, sf):
    return V.listings(spark, sf).select("app_key", X.regulatory_risk(M.joined_text(["display_name", "summary"]), HIGH, MEDIUM).alias("risk"))


@query("label_effort", f"""SELECT app_key, CASE WHEN {_ORS(_TEXT, ['gear'])} THEN '3 connector 3-4' WHEN {_ORS(_TEXT, ['old', 'plate'])} THEN '1 report 1-2'
    ELSE '2 standard 2-3' END AS effort FROM listings""")
def label_effort(spark, sf):
    e = X.effort(M.joined_text(["display_name", "summary"]), EFFORTS)
    return V.listings(spark, sf).select("app_key", e.alias("e")).select("app_key", F.concat_ws(" ", F.col("e.effort").cast("string"), "e.kind", "e.weeks").alias("effort"))


@query("label_owned", f"SELECT app_key, CASE WHEN contains({_TEXT}, 'widget') THEN 'widgets' WHEN contains({_TEXT}, 'old') THEN 'archive' END AS owned FROM listings")
def label_owned(spark, sf):
    return V.listings(spark, sf).select("app_key", X.owned(M.joined_text(["display_name", "summary"]), OWN).alias("owned"))


@query("label_gtm", """SELECT label, CASE WHEN avg_price > 100 THEN 'partner outreach' WHEN avg_price > 30 THEN 'marketplace and forum' ELSE 'free then paid' END AS channel,
    CASE WHEN avg_price > 100 THEN greatest(49, floor(avg_price * 0.6e0)) WHEN avg_price > 30 THEN greatest(15, floor(avg_price * 0.5e0)) ELSE 15 END::INT AS low,
    CASE WHEN avg_price > 100 THEN floor(avg_price * 0.8e0) WHEN avg_price > 30 THEN floor(avg_price * 0.75e0) ELSE 25 END::INT AS high FROM idea_facts""", IDEA)
def label_gtm(spark, sf):
    return facts(spark, sf).select("label", X.go_to_market(F.col("avg_price")).alias("g")).select("label", "g.*")


@query("label_pivots", """SELECT label, CASE WHEN len(p) = 0 THEN 'Green Light' ELSE array_to_string(p[1:4], ', ') END AS pivots FROM (SELECT label, list_filter([
    CASE WHEN momentum >= 80 THEN 'Hot Right Now' WHEN momentum <= 25 THEN 'Cold Market' END, CASE WHEN n > 60 THEN 'Niche Down' END,
    CASE WHEN low = 0 AND paid > 0 THEN 'Price Wedge' END, CASE WHEN top_share > 50 THEN 'UX Flanking' END, CASE WHEN demand < 30 AND n > 5 THEN 'Validate Demand First' END,
    CASE WHEN dead_pct > 0.6 THEN 'Quality Gap' END, CASE WHEN n <= 3 AND momentum < 30 THEN 'Blue Ocean' END, CASE WHEN stale >= 2 THEN 'Attack Window' END,
    CASE WHEN forced_buyer >= 70 THEN 'Forced Buyer Market' END], lambda x: x IS NOT NULL) AS p FROM idea_scores)""", IDEA)
def label_pivots(spark, sf):
    return scores(spark, sf).select("label", F.array_join(X.pivots(), ", ").alias("pivots"))


@query("label_actions", "SELECT label, CASE WHEN viability >= 47 THEN '" + "; ".join(X.ACTIONS["build"]) + "' WHEN viability >= 42 THEN '"
       + "; ".join(X.ACTIONS["probe"]) + "' ELSE '" + "; ".join(X.ACTIONS["stop"]) + "' END AS actions FROM idea_scores", IDEA)
def label_actions(spark, sf):
    return scores(spark, sf).select("label", F.array_join(X.actions(F.col("viability")), "; ").alias("actions"))


@query("score_break_even", f"""SELECT label, launch_price::BIGINT AS launch_price, build_cost, {rnd('build_cost / launch_price', 1)} AS sales_needed, capture,
    {rnd('build_cost / launch_price / greatest(1e0, velocity * capture) * 30e0', 1)} AS days, {rnd('build_cost / launch_price / greatest(1e0, velocity * 0.01e0) * 30e0', 1)} AS days_worst
    FROM (SELECT *, CASE WHEN avg_price > 0 THEN greatest(19, floor(avg_price * 0.6e0)) ELSE 29 END AS launch_price,
    CASE WHEN {_ORS('idea', ['gear'])} THEN 3 WHEN {_ORS('idea', ['old', 'plate'])} THEN 1 ELSE 2 END * 30 * 15e0 AS build_cost,
    CASE WHEN top_share > 50 OR n > 30 THEN 0.02e0 WHEN n <= 10 THEN 0.08e0 ELSE 0.05e0 END AS capture FROM idea_facts)""", IDEA)
def score_break_even(spark, sf):
    e = X.effort(F.col("idea"), EFFORTS).getField("effort")
    return X.break_even(facts(spark, sf), e).select("label", "launch_price", "build_cost", "sales_needed", "capture", "days", "days_worst")


@query("top_validate_matches", f"""SELECT app_key, author, {rnd('price_cents / 1e2', 2)} AS price_usd, coalesce(total_purchases, 0) AS total,
    coalesce({rnd('coalesce(last_month_purchases, 0) * 1e2 / nullif(total_purchases, 0)', 1)}, 0e0) AS velocity_pct FROM listings
    WHERE contains(lower(display_name), 'bolt') ORDER BY total DESC, app_key LIMIT 20""")
def top_validate_matches(spark, sf):
    hit = V.listings(spark, sf).filter(M.contains(["display_name"], ["bolt"]))
    rows = hit.select("app_key", "author", C.price_usd().alias("price_usd"), C.zero("total_purchases").alias("total"), C.velocity_pct().alias("velocity_pct"))
    return K.top(rows, [K.desc("total"), F.col("app_key")], 20)
