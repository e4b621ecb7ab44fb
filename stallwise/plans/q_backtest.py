"""Back-test, statistics and models over all listings with a tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C
from stallwise.operators import backtest as B, learn as L, stats as S, validate as X
from stallwise.plans import views as V
from stallwise.plans.q_validate import WORDS, sub_sql
from stallwise.plans.registry import query
from stallwise.plans.sqlviews import rnd
from stallwise.session import fresh_path

BT = {
    "tiered": """SELECT *, lower(display_name || ' ' || summary) AS text, split_part(lower(display_name), ' ', 1) AS word FROM (SELECT *,
        CASE WHEN price_cents > 0 AND total_purchases >= 100 THEN 'WINNER' WHEN price_cents > 0 AND total_purchases BETWEEN 5 AND 99 THEN 'MID'
        WHEN price_cents > 0 AND total_purchases = 0 THEN 'LOSER' END AS tier FROM listings) WHERE tier IS NOT NULL""",
    "words": "SELECT DISTINCT word FROM tiered",
    "word_facts": """SELECT w.word, count(*) AS n, sum(coalesce(total_purchases, 0))::BIGINT AS total, sum(coalesce(last_month_purchases, 0))::BIGINT AS velocity,
        count_if(coalesce(total_purchases, 0) = 0) AS dead, count_if(coalesce(last_month_purchases, 0) > 0) AS active, count_if(price_cents > 0) AS paid,
        count_if(price_cents = 0) AS free, count_if(price_cents > 0 AND price_cents <= 3000) AS low,
        count_if(price_cents > 0 AND total_purchases > 50 AND last_month_purchases = 0) AS stale,
        coalesce(sum(price_cents) FILTER (price_cents > 0) / nullif(count_if(price_cents > 0), 0) / 1e2, 0e0) AS avg_price,
        coalesce(max(total_purchases) * 1e2 / nullif(sum(total_purchases), 0), 50e0) AS top_share,
        coalesce(sum(rating_stars) FILTER (rating_stars > 0) / nullif(count(rating_stars) FILTER (rating_stars > 0), 0), 0e0) AS avg_rating
        FROM words w JOIN listings l ON contains(lower(l.display_name), w.word) GROUP BY 1""",
    "joined": """SELECT t.app_key, t.tier, t.text, t.total_purchases, f.* FROM tiered t JOIN word_facts f USING (word)""",
    "scoredbt": sub_sql("joined", "text"),
    "bt": """SELECT *, CASE WHEN stale >= 2 AND paid > 0 AND stale / paid >= 0.5 THEN least(95, m + 15) ELSE m END AS moat FROM (SELECT *,
        CASE WHEN paid = 0 THEN 50 WHEN low = 0 THEN 80 WHEN low <= 3 THEN 60 WHEN low <= 8 THEN 40 ELSE 20 END AS gap,
        CASE WHEN top_share > 60 THEN 20 WHEN top_share > 40 THEN 45 WHEN top_share > 20 THEN 65 ELSE 85 END AS m FROM scoredbt)""",
    "wl": "SELECT *, (tier = 'WINNER')::INT AS y FROM bt WHERE tier IN ('WINNER', 'LOSER')",
}
ALL = [*B.COMPONENTS, "viability"]
OLD_SUM = " + ".join(f"{c} * {w}e0" for c, w in X.EARLIER_WEIGHTS.items())
NEW_SUM = " + ".join(f"{c} * {w}e0" for c, w in X.WEIGHTS.items())


def bt(spark, sf):
    return B.backtest(V.listings(spark, sf), WORDS)


def wl(spark, sf):
    return S.winners_losers(bt(spark, sf))


_LIM = {"WINNER": 200, "MID": 150, "LOSER": 200}


@query("set_union_tiers", " UNION ALL ".join(f"(SELECT app_key, tier FROM tiered WHERE tier = '{t}' ORDER BY total_purchases DESC, app_key LIMIT {n})" for t, n in _LIM.items()), BT)
def set_union_tiers(spark, sf):
    return B.tiered(V.listings(spark, sf), _LIM).select("app_key", "tier")


@query("src_backtest_csv", "SELECT app_key, tier, viability FROM bt", BT)
def src_backtest_csv(spark, sf):
    """The scored rows handed to the statistics through a stored table."""
    path = fresh_path(spark, "backtest")
    bt(spark, sf).select("app_key", "tier", "viability").write.parquet(path)
    return spark.read.parquet(path)


_NS = ["word", "n", "total", "velocity", "dead", "active", "paid", "free", "low", "stale"]


@query("agg_niche_stats12", f"SELECT {', '.join(_NS)}, {rnd('avg_price', 4)} AS avg_price, {rnd('top_share', 4)} AS top_share, {rnd('avg_rating', 4)} AS avg_rating FROM word_facts", BT)
def agg_niche_stats12(spark, sf):
    rows = V.listings(spark, sf)
    words = B.tiered(rows).select(F.split_part(F.lower("display_name"), F.lit(" "), F.lit(1)).alias("word"))
    return B.word_stats(words, rows).select(*_NS, *[C.rnd(F.col(c), 4).alias(c) for c in ("avg_price", "top_share", "avg_rating")])


@query("join_correlated_niche_stats", f"SELECT app_key, tier, n, total, velocity, {', '.join(B.COMPONENTS)}, gap, moat, viability, is_migrator FROM bt", BT)
def join_correlated_niche_stats(spark, sf):
    return bt(spark, sf).select("app_key", "tier", "n", "total", "velocity", *B.COMPONENTS, "gap", "moat", "viability", "is_migrator")


@query("agg_tier_stats", f"""SELECT tier, count(*) AS n, {rnd('avg(viability)', 3)} AS mean, {rnd('stddev_samp(viability)', 3)} AS std,
    {', '.join(f"{rnd(f'avg({c})', 3)} AS {c}" for c in B.COMPONENTS)}, quantile_cont(viability, 0.5)::DOUBLE AS median FROM bt GROUP BY 1""", BT)
def agg_tier_stats(spark, sf):
    return B.tier_stats(bt(spark, sf))


@query("agg_launch_rate", f"SELECT tier, count_if(viability >= 50) AS ready, count(*) AS n, {rnd('count_if(viability >= 50) * 1e2 / count(*)', 1)} AS pct FROM bt GROUP BY 1", BT)
def agg_launch_rate(spark, sf):
    return B.launch_rate(bt(spark, sf), 50)


@query("agg_false_pos", "SELECT app_key, viability FROM bt WHERE tier = 'LOSER' AND viability >= 45 ORDER BY viability DESC, app_key LIMIT 15", BT)
def agg_false_pos(spark, sf):
    return B.false_positives(bt(spark, sf), 45).select("app_key", "viability")


@query("agg_false_neg", "SELECT app_key, viability FROM bt WHERE tier = 'WINNER' AND viability < 60 ORDER BY viability, app_key LIMIT 15", BT)
def agg_false_neg(spark, sf):
    return B.false_negatives(bt(spark, sf), 60).select("app_key", "viability")


@query("agg_migrator_bias", f"SELECT is_migrator, tier, count(*) AS n, {rnd('avg(viability)', 3)} AS mean FROM bt GROUP BY 1, 2", BT)
def agg_migrator_bias(spark, sf):
    return B.migrator_bias(bt(spark, sf))


@query("agg_band_rates", f"""SELECT CASE WHEN viability <= 41 THEN 'SCREEN OUT' WHEN viability <= 46 THEN 'INVESTIGATE' WHEN viability <= 51 THEN 'CONSIDER' ELSE 'LAUNCH' END AS band,
    count(*) AS n, count_if(tier IN ('WINNER', 'LOSER')) AS n_wl, {rnd("count_if(tier = 'WINNER') * 1e2 / nullif(count_if(tier IN ('WINNER', 'LOSER')), 0)", 1)} AS win_pct,
    {rnd('count_if(total_purchases >= 100) / count(*)', 4)} AS hit_rate,
    {rnd('count_if(total_purchases >= 100) / count(*) / (SELECT count_if(total_purchases >= 100) / count(*) FROM bt)', 4)} AS lift FROM bt GROUP BY 1""", BT)
def agg_band_rates(spark, sf):
    return B.band_rates(bt(spark, sf))


@query("ml_base_rate", f"SELECT count_if(total_purchases >= 100) AS hits, count(*) AS n, {rnd('count_if(total_purchases >= 100) / count(*)', 6)} AS base_rate FROM bt", BT)
def ml_base_rate(spark, sf):
    return B.base_rate(bt(spark, sf))


@query("stat_pearson_log", " UNION ALL ".join(
    f"SELECT '{c}' AS component, CASE WHEN stddev_pop({c}) > 0 THEN {rnd(f'corr({c}, ln(1e0 + total_purchases)) + 1e0', 6)} END AS r_plus_1 FROM bt WHERE total_purchases > 0"
    for c in ALL), BT)
def stat_pearson_log(spark, sf):
    return S.pearson_log(bt(spark, sf), ALL)


_AVG_RANK = lambda c, part="": f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0)"


def _spearman_sql(c):
    return f"""SELECT '{c}' AS component, n, {rnd('r + 1e0', 6)} AS r_plus_1, CASE WHEN z > 3.290527 THEN '***' WHEN z > 2.575829 THEN '**' WHEN z > 1.959964 THEN '*' ELSE 'ns' END AS stars
    FROM (SELECT *, (8e0 * (n - 2) + 1) / (8e0 * (n - 2) + 3) * sqrt((n - 2) * ln(1e0 + r * r * (n - 2) / nullif(1e0 - r * r, 0) / (n - 2))) AS z
    FROM (SELECT count(*) AS n, CASE WHEN stddev_pop(x) > 0 THEN corr(x, y) END AS r FROM (SELECT {_AVG_RANK(c)} AS x, {_AVG_RANK('total_purchases')} AS y FROM bt)))"""


@query("stat_spearman", " UNION ALL ".join(_spearman_sql(c) for c in ALL), BT)
def stat_spearman(spark, sf):
    return S.spearman(bt(spark, sf), ALL, "total_purchases")


def _u(c, src="wl"):
    return f"""SELECT sum(y * x) - sum(y) * (sum(y) + 1e0) / 2e0 AS u, sum(y)::DOUBLE AS n1, count(*) - sum(y)::DOUBLE AS n0, count(*) AS n
        FROM (SELECT y, {_AVG_RANK('v')} AS x FROM (SELECT y, ({c})::DOUBLE AS v FROM {src}))"""


@query("stat_auc", " UNION ALL ".join(f"SELECT '{c}' AS component, {rnd('u / (n1 * n0)', 6)} AS auc FROM ({_u(c)})" for c in ALL), BT)
def stat_auc(spark, sf):
    return S.auc(wl(spark, sf), {c: F.col(c) for c in ALL})


@query("stat_formula_compare", f"""SELECT a AS auc_earlier, b AS auc_current, {rnd('b - a + 1e0', 6)} AS delta_plus_1 FROM (SELECT {rnd('u / (n1 * n0)', 6)} AS a FROM ({_u(OLD_SUM)})),
    (SELECT {rnd('u / (n1 * n0)', 6)} AS b FROM ({_u(NEW_SUM)}))""", BT)
def stat_formula_compare(spark, sf):
    return S.formula_compare(wl(spark, sf), X.weighted(X.EARLIER_WEIGHTS), X.weighted(X.WEIGHTS))


_TAIL = """exp(-(z * z) / 2e0) * 0.3989422804014327e0 * t * (0.319381530e0 + t * (-0.356563782e0 + t * (1.781477937e0 + t * (-1.821255978e0 + t * 1.330274429e0))))"""


@query("stat_mannwhitney", f"""SELECT 'viability' AS component, u, n1, n0, {rnd(f'CASE WHEN z >= 0 THEN {_TAIL} ELSE 1e0 - {_TAIL} END', 6)} AS p,
    {rnd('2e0 - u * 2e0 / (n1 * n0)', 6)} AS rank_biserial_plus_1 FROM (SELECT *, 1e0 / (1e0 + 0.2316419e0 * abs(z)) AS t FROM (
    SELECT *, (u - n1 * n0 / 2e0 - 0.5e0) / sqrt(n1 * n0 / 12e0 * ((n + 1e0) - ties / (n * (n - 1e0)))) AS z FROM ({_u('viability')}),
    (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM wl GROUP BY viability))))""", BT)
def stat_mannwhitney(spark, sf):
    return S.mann_whitney(wl(spark, sf), "viability")


@query("stat_threshold_f1", f"""SELECT t AS threshold, {rnd('f1', 6)} AS f1, {rnd('tp / predicted', 6)} AS precision, {rnd('tp / p', 6)} AS recall FROM (
    SELECT *, tp * 2e0 / (predicted + p) AS f1 FROM (SELECT t, count_if(viability >= t) AS predicted, sum(CASE WHEN viability >= t THEN y ELSE 0 END) AS tp, sum(y) AS p
    FROM wl, range(30, 75) r(t) GROUP BY t)) ORDER BY f1 DESC, t LIMIT 1""", BT)
def stat_threshold_f1(spark, sf):
    return S.threshold_f1(wl(spark, sf))


# The same optimum by one coordinate at a time: each step of the recursion moves one weight by its own Newton step.
def _logit(data: str, k: int, steps: int) -> str:
    return f"""(WITH RECURSIVE it(i, b) AS (SELECT 0, list_transform(range({k}), lambda j: 0e0)
    UNION ALL SELECT i + 1, list_transform(range({k}), lambda j: b[j + 1] - CASE WHEN j = i % {k} THEN g / h ELSE 0e0 END) FROM (
    SELECT i, b, sum(w * (p - y) * xj) + CASE WHEN i % {k} = 0 THEN 0e0 ELSE b[i % {k} + 1] END AS g, sum(w * p * (1e0 - p) * xj * xj) + CASE WHEN i % {k} = 0 THEN 1e-12 ELSE 1e0 END AS h
    FROM (SELECT it.i, it.b, d.w, d.y, d.x[it.i % {k} + 1] AS xj, 1e0 / (1e0 + exp(-list_dot_product(d.x, it.b))) AS p FROM it, {data} d WHERE it.i < {steps}) GROUP BY i, b))
    SELECT b FROM it ORDER BY i DESC LIMIT 1)"""


def _centred(source: str, columns, extra: str) -> str:
    """Rows of ``source`` with columns shifted by their mean (``m_``) and their deviation (``s_``)."""
    means = ", ".join(f"sum(w * {c}) OVER () / sum(w) OVER () AS m_{c}" for c in columns)
    devs = ", ".join(f"sqrt(sum(w * ({c} - m_{c}) * ({c} - m_{c})) OVER () / sum(w) OVER ()) AS s_{c}" for c in columns)
    return f"SELECT *, {extra} AS x FROM (SELECT *, {devs} FROM (SELECT *, {means} FROM {source}))"


_scaled = lambda c, v: f"({v} - m_{c}) / CASE WHEN s_{c} > 1e-9 THEN s_{c} ELSE 1e0 END"
ML = {
    **BT,
    "ones": "SELECT viability, (total_purchases >= 100)::INT AS y, count(*)::DOUBLE AS w FROM bt GROUP BY ALL",
    "onesx": _centred("ones", ["viability"], "[1e0, viability - m_viability]"),
    "onesb": f"SELECT b, (SELECT any_value(m_viability) FROM onesx) AS m FROM {_logit('onesx', 2, 60)}",
    "sixes": f"SELECT {', '.join(B.COMPONENTS)}, (total_purchases >= 100)::INT AS y, count(*)::DOUBLE AS w FROM bt GROUP BY ALL",
    "sixesx": _centred("sixes", B.COMPONENTS, f"[1e0, {', '.join(_scaled(c, c) for c in B.COMPONENTS)}]"),
    "sixesb": f"SELECT b FROM {_logit('sixesx', len(B.COMPONENTS) + 1, 700)}",
}
PROBE = [90, 60, 50, 70, 70, 50]


@query("ml_logistic_single", f"SELECT v AS viability, {rnd('1e0 / (1e0 + exp(-(b[1] + b[2] * (v - m))))', 4)} AS p FROM onesb, (SELECT unnest({L.GRID}) AS v)", ML)
def ml_logistic_single(spark, sf):
    return L.logistic_single(bt(spark, sf))


@query("ml_calibration", f"""SELECT *, CASE WHEN abs(predicted - observed) < 0.05e0 THEN 'WELL' ELSE 'OFF' END AS verdict FROM (
    SELECT bin, sum(w) AS n, {rnd('sum(p * w) / sum(w)', 4)} AS predicted, {rnd('sum(y * w) / sum(w)', 4)} AS observed FROM (
    SELECT least(floor(p * 6), 5)::INT AS bin, * FROM (SELECT y, w, 1e0 / (1e0 + exp(-(b[1] + b[2] * (viability - m)))) AS p FROM ones, onesb)) GROUP BY bin)""", ML)
def ml_calibration(spark, sf):
    return L.calibration(bt(spark, sf))


@query("ml_cv_auc")
def ml_cv_auc(spark, sf):
    return L.cv_auc(bt(spark, sf), B.COMPONENTS)


@query("ml_folds", """SELECT app_key, y AS label, (len(list_filter(ends, lambda e: e <= nth)))::INT AS fold FROM (
    SELECT app_key, y, row_number() OVER (PARTITION BY y ORDER BY app_key) - 1 AS nth FROM (SELECT app_key, (total_purchases >= 100)::INT AS y FROM bt)) JOIN (
    SELECT y, list_transform(range(1, 6), lambda k: list_sum(list_transform(range(k), lambda i: (start + size - i + 4) // 5 - (start - i + 4) // 5))) AS ends FROM (
    SELECT y, size, (sum(size) OVER (ORDER BY first) - size)::BIGINT AS start FROM (
    SELECT y, count(*) AS size, min(app_key) AS first FROM (SELECT app_key, (total_purchases >= 100)::INT AS y FROM bt) GROUP BY y))) USING (y)""", BT)
def ml_folds(spark, sf):
    """Test folds of the cross-validation: unshuffled and stratified."""
    return L.stratified_folds(L.labelled(bt(spark, sf)).select("app_key", "label"))


@query("ml_component_importance", f"SELECT unnest({B.COMPONENTS}) AS component, unnest(list_transform(b[2:], lambda v: {rnd('v', 4)})) AS coefficient FROM sixesb", ML)
def ml_component_importance(spark, sf):
    return L.component_importance(bt(spark, sf), B.COMPONENTS)


@query("ml_point_estimate", f"""SELECT {rnd('p', 4)} AS p, {rnd('base', 4)} AS base_rate, {rnd('p / base', 3)} AS lift FROM (
    SELECT 1e0 / (1e0 + exp(-list_dot_product(b, [1e0, {', '.join(_scaled(c, v) for c, v in zip(B.COMPONENTS, PROBE))}]))) AS p, (SELECT sum(w * y) / sum(w) FROM sixes) AS base
    FROM sixesb, (SELECT * FROM sixesx LIMIT 1))""", ML)
def ml_point_estimate(spark, sf):
    return L.point_estimate(bt(spark, sf), B.COMPONENTS, PROBE)
