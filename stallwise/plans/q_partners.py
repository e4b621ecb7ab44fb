"""Partner directory, client references and check-in verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C
from stallwise.operators import checkin as H, market as K, partners as P
from stallwise.plans import views as V
from stallwise.plans.registry import query
from stallwise.plans.sqlviews import rnd
from stallwise.sources import writers as O

FIT = ["economy", "#000000007", "nation_1", "serves", "supplier", "medium"]
READY = ["economy", "standard", "large"]
_TEXT = "lower(name || ' ' || description || ' ' || array_to_string(industries, ' ') || ' ' || array_to_string(clients, ' '))"
FITSQL = {"fits": f"""SELECT *, least(100, keyword_match + industry_match + certification_points + employee_count + contact_quality)::INT AS fit FROM (SELECT *,
    least(30, 5 * ({' + '.join(f"contains({_TEXT}, '{w}')::INT" for w in FIT)}))::INT AS keyword_match,
    least(20, 5 * len(list_filter(industries, lambda x: contains(lower(x), 'economy') OR contains(lower(x), 'standard') OR contains(lower(x), 'large'))))::INT AS industry_match,
    CASE grade WHEN 'Gold' THEN 30 WHEN 'Silver' THEN 20 ELSE 0 END AS certification_points,
    CASE WHEN mid BETWEEN 20 AND 200 THEN 15 WHEN mid BETWEEN 10 AND 500 THEN 10 ELSE 0 END AS employee_count,
    (email IS NOT NULL)::INT * 5 + (phone IS NOT NULL)::INT * 5 + (website IS NOT NULL)::INT * 5 AS contact_quality
    FROM (SELECT *, (split_part(employees, '-', 1)::INT + split_part(employees, '-', 2)::INT) / 2 AS mid FROM partners))"""}


def fit(spark, sf):
    return P.score_fit(V.partners(spark, sf), FIT, READY, V.client_refs(spark, sf))


@query("score_partner_fit", f"SELECT partner_id, fit, {', '.join(P.PARTS)} FROM fits", FITSQL)
def score_partner_fit(spark, sf):
    return fit(spark, sf).select("partner_id", "fit", *P.PARTS)


@query("flt_score_min", "SELECT partner_id FROM fits WHERE fit >= 60", FITSQL)
def flt_score_min(spark, sf):
    return fit(spark, sf).filter("fit >= 60").select("partner_id")


@query("flt_cert_min", "SELECT partner_id FROM partners WHERE grade IN ('Gold', 'Silver')")
def flt_cert_min(spark, sf):
    return V.partners(spark, sf).filter(P.level() >= 2).select("partner_id")


@query("top_partners", "SELECT partner_id, fit FROM fits WHERE fit >= 50 ORDER BY fit DESC, partner_id LIMIT 50", FITSQL)
def top_partners(spark, sf):
    return P.top_partners(fit(spark, sf), 50).select("partner_id", "fit")


@query("snk_outreach_csv", """SELECT rank, name AS partner, country AS location, coalesce(email, 'N/A') AS email, coalesce(phone, 'N/A') AS phone, coalesce(website, 'N/A') AS website,
    array_to_string(industries[1:3], '; ') AS industries, grade AS certification, fit::VARCHAR AS score,
    '{"keyword_match":' || keyword_match || ',"industry_match":' || industry_match || ',"certification_points":' || certification_points || ',"employee_count":' || employee_count ||
    ',"contact_quality":' || contact_quality || '}' AS breakdown FROM (SELECT *, row_number() OVER (ORDER BY fit DESC, partner_id) AS rank FROM fits WHERE fit >= 50) WHERE rank <= 50""", FITSQL)
def snk_outreach_csv(spark, sf):
    order = [K.desc("fit"), F.col("partner_id")]
    best = K.rank_within(P.top_partners(fit(spark, sf), 50).withColumn("_one", F.lit(1)), ["_one"], order, 50)
    return O.outreach_rows(best, P.PARTS)


@query("agg_score_bands", f"""SELECT CASE WHEN fit >= 90 THEN '90-100' WHEN fit >= 70 THEN '70-89' WHEN fit >= 50 THEN '50-69' WHEN fit >= 30 THEN '30-49' ELSE '0-29' END AS band, count(*) AS n,
    {rnd('count(*) * 1e2 / (SELECT count(*) FROM fits)', 1)} AS pct FROM fits GROUP BY 1""", FITSQL)
def agg_score_bands(spark, sf):
    return P.share_by(fit(spark, sf), P.band(), "band")


@query("agg_cert_breakdown", f"SELECT grade AS certification, count(*) AS n, {rnd('count(*) * 1e2 / (SELECT count(*) FROM partners)', 1)} AS pct FROM partners GROUP BY 1")
def agg_cert_breakdown(spark, sf):
    return P.share_by(V.partners(spark, sf), F.col("grade"), "certification")


@query("agg_industry_top10", "SELECT industry, count(*) AS n FROM (SELECT unnest(industries) AS industry FROM partners) GROUP BY 1 ORDER BY n DESC, industry LIMIT 10")
def agg_industry_top10(spark, sf):
    rows = V.partners(spark, sf).select(F.explode("industries").alias("industry"))
    return K.top(rows.groupBy("industry").agg(F.count(F.lit(1)).alias("n")), [K.desc("n"), F.col("industry")], 10)


@query("agg_industry_explode", "SELECT industry, count(*) AS n FROM (SELECT unnest(industries) AS industry FROM partners) GROUP BY 1 ORDER BY n DESC, industry LIMIT 25")
def agg_industry_explode(spark, sf):
    rows = V.partners(spark, sf).select(F.array_join("industries", " ; ").alias("industries"))
    return P.industries(rows, "industries")


@query("flt_partner_keyword", f"SELECT partner_id FROM partners WHERE contains({_TEXT}, '#00000000') OR contains({_TEXT}, 'nation_2')")
def flt_partner_keyword(spark, sf):
    return P.keyword_filter(V.partners(spark, sf), ["#00000000", "nation_2"], V.client_refs(spark, sf)).select("partner_id")


@query("flt_industry_contains", "SELECT partner_id, client_name FROM client_refs WHERE contains(lower(client_industry), 'auto') ORDER BY client_name, partner_id LIMIT 200")
def flt_industry_contains(spark, sf):
    return P.industry_contains(V.client_refs(spark, sf), "auto").select("partner_id", "client_name")


_REGION_TEXT = "lower(name || ' ' || country || ' ' || description)"


@query("flt_region_company", f"""SELECT partner_id FROM partners WHERE contains({_REGION_TEXT}, 'nation_7') OR contains({_REGION_TEXT}, 'nation_12') OR contains({_REGION_TEXT}, 'serves nation_3')
    OR ends_with(lower(name), '9') OR contains(name || ' ' || country || ' ' || description, ' NATION_5')""")
def flt_region_company(spark, sf):
    hit = P.in_region("name", ["country", "description"], ["nation_7", "nation_12"], ["9"], ["serves nation_3"], ["NATION_5"])
    return V.partners(spark, sf).filter(hit).select("partner_id")


@query("agg_partner_kpis", "SELECT count(*) AS partners, count(DISTINCT country) AS countries, count_if(grade = 'Gold') AS gold, (SELECT count(*) FROM client_refs) AS client_refs FROM partners")
def agg_partner_kpis(spark, sf):
    return P.kpis(V.partners(spark, sf), V.client_refs(spark, sf))


@query("agg_partner_country", "SELECT country, count(*) AS partners FROM partners GROUP BY 1 ORDER BY partners DESC, country LIMIT 20")
def agg_partner_country(spark, sf):
    return P.by_country(V.partners(spark, sf))


@query("agg_partner_grade", "SELECT d.pos, d.grade, count(p.partner_id) AS partners FROM (VALUES (0, 'Gold'), (1, 'Silver'), (2, 'Ready'), (3, 'Unknown')) d(pos, grade) LEFT JOIN partners p USING (grade) GROUP BY 1, 2")
def agg_partner_grade(spark, sf):
    return P.by_grade(V.partners(spark, sf))


@query("set_dedupe_refs", "SELECT l_suppkey AS partner_id, lower(c_name) AS client, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def set_dedupe_refs(spark, sf):
    line = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("partner_id"))
    o, c = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), V.table(spark, sf, "customer").select("c_custkey", "c_name")
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "partner_id", F.when(F.col("l_linenumber") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("client_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return P.dedupe_refs(rows, F.col("pos")).select("partner_id", F.lower("client_name").alias("client"), "pos")


@query("agg_client_db", """SELECT client_name, count(DISTINCT partner_id) AS partner_count, string_agg(DISTINCT client_industry, ',' ORDER BY client_industry) AS industries,
    'ref ' || min(partner_id) AS description FROM client_refs GROUP BY 1""")
def agg_client_db(spark, sf):
    refs = V.client_refs(spark, sf).withColumn("description", F.concat(F.lit("ref "), F.col("partner_id").cast("string")))
    return P.client_facts(refs).select("client_name", "partner_count", F.array_join("industries", ",").alias("industries"), "description")


@query("agg_client_partners", "SELECT client_name, partner_id // 1000 AS page, array_to_string(list_sort(list(DISTINCT partner_id)), ',') AS partners FROM client_refs GROUP BY 1, 2")
def agg_client_partners(spark, sf):
    rows = P.client_partners(V.client_refs(spark, sf))
    return rows.select("client_name", "page", F.array_join(F.transform("partners", lambda p: p.cast("string")), ",").alias("partners"))


@query("agg_crawl_progress", f"""SELECT done, seconds, {rnd('done * 6e1 / seconds', 6)} AS per_minute, greatest(0, 11850 - done) AS remaining, {rnd('greatest(0, 11850 - done) / (done * 6e1 / seconds)', 3)} AS minutes_left,
    {rnd('done * 1e2 / 11850e0', 2)} AS pct FROM (SELECT count(DISTINCT user_id) AS done, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds FROM events)""")
def agg_crawl_progress(spark, sf):
    return P.crawl_progress(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 11850)


# ---- check-ins ---------------------------------------------------------------

_SUST, _HEAVY = "(hours <= 12 AND motivation >= 5)", "(hours > 20 OR motivation <= 4)"
_RR = "(CASE WHEN installs_total > 0 THEN refunds_total / installs_total ELSE 0 END)"
_REV = "(CASE WHEN installs_total > 0 THEN reviews_count / installs_total ELSE 0 END)"
_VR = "(installs_weeks_7_8 / CASE WHEN installs_weeks_1_2 = 0 THEN 1 ELSE installs_weeks_1_2 END)"


@query("label_checkin", f"""SELECT app_key, week, CASE WHEN week = 2 THEN CASE WHEN installs_total = 0 AND listing_visitors >= 200 THEN 'LISTING CRISIS' WHEN installs_total = 0 AND listing_visitors < 50
    THEN 'DISTRIBUTION CRISIS' WHEN installs_total BETWEEN 1 AND 2 THEN 'SLOW START' WHEN installs_total BETWEEN 3 AND 7 THEN 'HEALTHY START' WHEN installs_total >= 8 THEN 'STRONG LAUNCH' ELSE 'REVIEW MANUALLY' END
    WHEN week = 4 THEN CASE WHEN {_RR} > 0.20 THEN 'QUALITY CRISIS' WHEN reviews_count = 0 AND installs_total >= 5 THEN 'ENGAGEMENT CRISIS' WHEN bug_reviews >= 2 THEN 'UNDER-SPECCED V1'
    WHEN {_RR} > 0 AND {_REV} < 0.05 THEN 'SILENT QUITTERS' ELSE 'STABLE' END
    WHEN week = 8 THEN CASE WHEN {_VR} >= 1.5 THEN 'GROWING' WHEN {_VR} >= 0.8 THEN 'FLAT' WHEN installs_weeks_7_8 > 0 THEN 'DECLINING' WHEN installs_weeks_7_8 = 0 THEN 'STALL' ELSE 'REVIEW MANUALLY' END
    ELSE CASE WHEN revenue > 300 AND trend = 'growing' AND {_SUST} THEN 'CONTINUE' WHEN revenue BETWEEN 100 AND 300 AND trend = 'growing' AND {_SUST} THEN 'CONTINUE + PLAN APP #2'
    WHEN revenue BETWEEN 100 AND 300 AND trend = 'flat' AND {_SUST} THEN 'MAINTAIN MODE' WHEN revenue < 100 AND trend = 'growing' AND {_SUST} THEN 'ONE MORE MONTH'
    WHEN revenue < 100 AND (trend = 'flat' OR {_HEAVY}) THEN 'KILL' WHEN trend = 'declining' THEN 'KILL OR PIVOT' ELSE 'REVIEW MANUALLY' END END AS verdict FROM checkins""")
def label_checkin(spark, sf):
    return V.checkins(spark, sf).select("app_key", "week", H.verdict().alias("verdict"))


@query("win_first_weeks_ratio", f"SELECT app_key, {rnd(_VR, 4)} AS ratio FROM checkins WHERE week = 8")
def win_first_weeks_ratio(spark, sf):
    return V.checkins(spark, sf).filter("week = 8").select("app_key", C.rnd(H.velocity_ratio(), 4).alias("ratio"))
