"""Keyword niches, gap scans, wedges, token niches and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C, match as M, rareindex as R, tokens as T
from stallwise.functions.match import niche
from stallwise.operators import market as K, niches as N
from stallwise.plans import views as V
from stallwise.plans.q_market import BEST, GROSS, GROSS_LM, SUM, best
from stallwise.plans.registry import query
from stallwise.plans.sqlviews import rnd

# Niches over the words of the test catalog; any catalog brings its own rows.
NICHES = [
    niche("fasteners", "bolt", "rod", category="manufacturing", complexity="S", source="Alpha", edition="enterprise"),
    niche("rings", "ring", category="crm", complexity="M", source="Alpha", edition="none"),
    niche("workshop", "anvil", "gizmo", category="ops", complexity="L", source="Beta", edition="ux-gap"),
    niche("cold gear", "cold gear", category="hr", complexity="S", source="Beta", edition="none"),
    niche("promo deals", "promo", category="sales", complexity="M", source="Gamma", edition="community"),
    niche("brand 25", "brand#25", "small plate", category="ops", complexity="L", source="Gamma", edition="none"),
    niche("hot or old", "hot ", "old ", category="billing", complexity="S", source="Delta", edition="enterprise"),
    niche("airships", "zeppelin", "blimp", category="ops", complexity="L", source="Delta", edition="none"),
    niche("submarines", "submarine", category="ops", complexity="L", source="Alpha", edition="none"),
]
SOURCES = {"Alpha": (9_000_000, 0.08), "Beta": (500_000, 0.02), "Gamma": (1_200_000, 0.05)}
WORD_NICHES = [niche(n.label, *[k.strip() for k in n.keywords if "#" not in k], **n.attrs) for n in NICHES]
REGEX_NICHES = [niche("starts small", "^small", edition="none"), niche("gear or ring", "gear$", "ring$", edition="enterprise"),
                niche("double o", "o.*o", edition="ux-gap"), niche("x ray", "x-?ray", edition="none")]
WEDGES = {
    "bolts": "lower(tech_name) LIKE '%_bolt%' OR lower(display_name) LIKE '%bolt%'",
    "paid promo": "lower(summary) LIKE '%promo%' AND price_cents > 0",
    "cold": "lower(tech_name) LIKE 'cold%'", "none": "lower(tech_name) LIKE '%zeppelin%'",
}
_Q = lambda s: "'" + s.replace("'", "''") + "'"


def _dim_sql(dim, attrs=()):
    rows = ", ".join("(" + ", ".join([str(i), _Q(n.label), _Q(k.lower()), *[_Q(str(n.attrs.get(a))) for a in attrs]]) + ")"
                     for i, n in enumerate(dim) for k in n.keywords)
    return f"SELECT * FROM (VALUES {rows}) d({', '.join(['pos', 'label', 'kw', *attrs])})"


_ATTRS = ("category", "complexity", "source", "edition")
DIM = {
    "dim": _dim_sql(NICHES, _ATTRS),
    "niche_list": "SELECT DISTINCT pos, label, category, complexity, source, edition FROM dim",
    "matched": """SELECT n.label, l.* FROM niche_list n JOIN listings l ON EXISTS (SELECT 1 FROM dim k WHERE k.label = n.label
        AND (contains(lower(l.display_name), k.kw) OR contains(lower(l.summary), k.kw)))""",
    "wdim": _dim_sql(WORD_NICHES, _ATTRS),
    "wmatched": """SELECT n.label, n.category, n.complexity, l.* FROM (SELECT DISTINCT label, category, complexity FROM wdim) n
        JOIN listings l ON EXISTS (SELECT 1 FROM wdim k WHERE k.label = n.label AND regexp_matches(lower(l.display_name || ' ' || l.summary),
        '(^|[^a-z0-9_])' || replace(k.kw, ' ', '\\s+') || '($|[^a-z0-9_])'))""",
    "rdim": _dim_sql(REGEX_NICHES, ("edition",)),
    "rlist": "SELECT DISTINCT pos, label, edition FROM rdim",
    "rmatched": """SELECT n.label, l.* FROM rlist n JOIN listings l
        ON EXISTS (SELECT 1 FROM rdim k WHERE k.label = n.label AND regexp_matches(lower(l.display_name), k.kw))""",
}
COUNTS = f"count(*) AS listings, {SUM('total_purchases')} AS sales, {SUM('last_month_purchases')} AS last_month"
ZEROS = f"count(m.app_key) AS listings, {SUM('m.total_purchases')} AS sales, {SUM('m.last_month_purchases')} AS last_month"


@query("flt_keyword_any", """SELECT app_key FROM listings WHERE contains(lower(display_name), 'bolt') OR contains(lower(summary), 'bolt')
    OR contains(lower(display_name), 'promo') OR contains(lower(summary), 'promo')""")
def flt_keyword_any(spark, sf):
    return V.listings(spark, sf).filter(M.contains(N.BOTH, ["bolt", "promo"])).select("app_key")


@query("flt_name_only", "SELECT app_key FROM listings WHERE contains(lower(display_name), 'ring')")
def flt_name_only(spark, sf):
    return V.listings(spark, sf).filter(M.contains(["display_name"], ["ring"])).select("app_key")


_SO = "(contains(lower(summary), 'small') AND NOT contains(lower(display_name), 'small'))"


@query("flt_summary_only", f"""SELECT app_key, coalesce(total_purchases, 0) AS total_purchases, (SELECT count(*) FROM listings WHERE {_SO}) AS n
    FROM listings WHERE {_SO} ORDER BY total_purchases DESC, app_key LIMIT 20""")
def flt_summary_only(spark, sf):
    hit = V.listings(spark, sf).filter(F.lower("summary").contains("small") & ~F.lower("display_name").contains("small"))
    n = hit.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = hit.select("app_key", C.zero("total_purchases").alias("total_purchases"))
    return K.top(rows, [K.desc("total_purchases"), F.col("app_key")], 20).withColumn("n", n)


@query("flt_word_regex", "SELECT label, app_key FROM wmatched", DIM)
def flt_word_regex(spark, sf):
    return M.fan_out(V.listings(spark, sf), WORD_NICHES, N.BOTH, "word").select("label", "app_key")


@query("flt_regex_any", "SELECT label, app_key FROM rmatched", DIM)
def flt_regex_any(spark, sf):
    return M.fan_out(V.listings(spark, sf), REGEX_NICHES, ["display_name"], "regex").select("label", "app_key")


@query("flt_wedge", "SELECT app_key FROM listings WHERE lower(tech_name) LIKE '%_bolt%' OR lower(display_name) LIKE '%bolt%'")
def flt_wedge(spark, sf):
    return V.listings(spark, sf).filter(F.expr(WEDGES["bolts"])).select("app_key")


@query("join_keyword_fanout", "SELECT label, app_key FROM matched", DIM)
def join_keyword_fanout(spark, sf):
    return M.fan_out(V.listings(spark, sf), NICHES).select("label", "app_key")


@query("join_keyword_table", "SELECT DISTINCT w.word, l.app_key FROM listings l, (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part) w "
       "WHERE contains(lower(l.display_name), w.word)")
def join_keyword_table(spark, sf):
    """Keywords that are themselves a table: the equi-join on leading characters."""
    words = V.table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")).distinct()
    rows = V.listings(spark, sf).withColumn("name", F.lower("display_name"))
    pairs = M.contains_join(rows.select("name").distinct(), "name", words, "word")
    return rows.join(pairs, "name").select("word", "app_key")


_NAMES = {"name_dim": "SELECT DISTINCT p_type AS label, lower(p_name) AS kw FROM part"}


@query("join_keyword_table_any", """SELECT DISTINCT d.label, l.app_key FROM name_dim d JOIN listings l ON contains(lower(l.display_name), d.kw) OR contains(lower(l.summary), d.kw)""", _NAMES)
def join_keyword_table_any(spark, sf):
    """A derived (label, keyword) table against name or summary."""
    dim = V.table(spark, sf, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("keyword")).distinct()
    rows = V.listings(spark, sf).select("app_key", "display_name", "summary")
    return M.fan_out_table(rows, N.BOTH, dim).select("label", "app_key")


@query("join_words_documents", """SELECT w.word, count(*) AS n_docs, min(d.doc_id) AS first_doc FROM documents d JOIN (
    SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) w ON length(w.word) >= 6 AND contains(d.text, w.word) GROUP BY 1""")
def join_words_documents(spark, sf):
    """The longer words of one text table inside the whole texts of another, through the index of rare pieces."""
    words = V.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).filter(F.length("word") >= 6).distinct()
    pairs = R.found_words(V.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", words, "word")
    return pairs.groupBy("word").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("join_keyword_zero_keep", f"SELECT n.label, n.pos, {ZEROS} FROM niche_list n LEFT JOIN matched m USING (label) GROUP BY 1, 2", DIM)
def join_keyword_zero_keep(spark, sf):
    return N.counts_keep_zero(V.listings(spark, sf), NICHES)


@query("join_dim_lookup", "SELECT m.app_key, m.label, n.category, n.complexity FROM matched m JOIN niche_list n USING (label)", DIM)
def join_dim_lookup(spark, sf):
    attrs = M.to_frame(spark, NICHES, category="string", complexity="string")
    return M.fan_out(V.listings(spark, sf), NICHES).join(attrs, "label", "left").select("app_key", "label", "category", "complexity")


@query("agg_niche_rollup", f"SELECT label, {COUNTS}, {rnd('avg(rating_stars)', 2)} AS avg_rating FROM matched GROUP BY 1", DIM)
def agg_niche_rollup(spark, sf):
    return N.rollup(V.listings(spark, sf), NICHES, extra=[C.rnd(F.avg("rating_stars"), 2).alias("avg_rating")])


@query("agg_niche_velocity", f"""SELECT label, {COUNTS}, count(DISTINCT author) AS publishers,
    {rnd('coalesce(sum(last_month_purchases), 0) / count(*)', 2)} AS velocity_per_listing FROM matched GROUP BY 1""", DIM)
def agg_niche_velocity(spark, sf):
    return N.niche_velocity(V.listings(spark, sf), NICHES)


@query("agg_thin_niches", f"""SELECT n.label, n.pos, {ZEROS} FROM niche_list n LEFT JOIN matched m USING (label) GROUP BY 1, 2
    HAVING count(m.app_key) <= 5""", DIM)
def agg_thin_niches(spark, sf):
    return N.thin_niches(V.listings(spark, sf), NICHES)


@query("agg_niche_sales_map", f"SELECT n.label, n.pos, {ZEROS} FROM niche_list n LEFT JOIN matched m USING (label) GROUP BY 1, 2 ORDER BY sales DESC", DIM)
def agg_niche_sales_map(spark, sf):
    return N.counts_keep_zero(V.listings(spark, sf), NICHES).orderBy(K.desc("sales"), "label")


@query("agg_region_signal", f"""SELECT * FROM (SELECT 'all' AS kind, '' AS app_key, {COUNTS} FROM listings WHERE contains(lower(display_name), 'cold')
    OR contains(lower(summary), 'brand#1')) UNION ALL SELECT * FROM (SELECT 'top', app_key, 1, coalesce(total_purchases, 0), coalesce(last_month_purchases, 0)
    FROM listings WHERE contains(lower(display_name), 'cold') OR contains(lower(summary), 'brand#1')
    ORDER BY coalesce(total_purchases, 0) DESC, app_key LIMIT 10)""")
def agg_region_signal(spark, sf):
    hit = V.listings(spark, sf).filter(M.contains(["display_name"], ["cold"]) | M.contains(["summary"], ["brand#1"]))
    all_ = hit.agg(F.count(F.lit(1)).alias("listings"), K.total("total_purchases").alias("sales"), K.total("last_month_purchases").alias("last_month"))
    first = K.top(hit.select("app_key", C.zero("total_purchases").alias("sales"), C.zero("last_month_purchases").alias("last_month")),
                  [K.desc("sales"), F.col("app_key")], 10)
    return all_.select(F.lit("all").alias("kind"), F.lit("").alias("app_key"), "listings", "sales", "last_month").unionByName(
        first.select(F.lit("top").alias("kind"), "app_key", F.lit(1).cast("bigint").alias("listings"), "sales", "last_month"))


_SIGNAL = "CASE WHEN listings = 0 THEN 'ZERO' WHEN listings <= 3 THEN 'THIN' WHEN listings <= 15 THEN 'OK' ELSE 'CROWDED' END"
SCAN = {**DIM, "scan": f"""SELECT *, {_SIGNAL} AS signal FROM (SELECT n.label, n.pos, n.source, {ZEROS} FROM niche_list n
    LEFT JOIN matched m USING (label) GROUP BY 1, 2, 3)"""}


@query("sort_signal_then_sales", "SELECT * FROM scan", SCAN)
def sort_signal_then_sales(spark, sf):
    return N.gap_scan(V.listings(spark, sf), NICHES)


@query("label_signal", "SELECT label, signal FROM scan", SCAN)
def label_signal(spark, sf):
    return N.counts_keep_zero(V.listings(spark, sf), NICHES).select("label", N.signal_label(F.col("listings")).alias("signal"))


@query("agg_signal_summary", """SELECT signal, count(*) AS n, '' AS items FROM scan GROUP BY 1 UNION ALL
    SELECT 'ZERO:' || source, count(*), string_agg(label, '; ' ORDER BY label) FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY label) AS rn
    FROM scan WHERE signal = 'ZERO') WHERE rn <= 3 GROUP BY source""", SCAN)
def agg_signal_summary(spark, sf):
    return N.signal_summary(N.gap_scan(V.listings(spark, sf), NICHES))


@query("score_tam", "SELECT label, coalesce(floor(installs * churn * 0.005e0), 0)::BIGINT AS tam FROM scan LEFT JOIN (VALUES "
       + ", ".join(f"('{s}', {i}, {c}::DOUBLE)" for s, (i, c) in SOURCES.items()) + ") b(source, installs, churn) USING (source)", SCAN)
def score_tam(spark, sf):
    base = spark.createDataFrame([(s, i, c) for s, (i, c) in SOURCES.items()], "source string, installs bigint, churn double")
    return N.tam(N.gap_scan(V.listings(spark, sf), NICHES), base).select("label", "tam")


_GAP = "CASE WHEN listings <= 30 THEN least(100, floor(sales / listings / 5)) ELSE greatest(0, floor(sales / listings / 20)) END::BIGINT"
_RADAR = f"""SELECT label, listings, {rnd('sales / listings', 1)} AS sales_per_listing, {rnd('last_month / listings', 2)} AS velocity_per_listing,
    avg_price, {_GAP} AS gap_score FROM (SELECT label, {COUNTS}, {rnd('avg(price_cents) / 1e2', 2)} AS avg_price FROM matched WHERE price_cents > 0 GROUP BY 1)"""


@query("agg_gap_radar", _RADAR, DIM)
def agg_gap_radar(spark, sf):
    return N.gap_radar(V.listings(spark, sf), NICHES)


@query("score_gap_radar", f"SELECT author, {_GAP} AS gap_score FROM (SELECT author, {COUNTS} FROM listings GROUP BY 1)")
def score_gap_radar(spark, sf):
    agg = V.listings(spark, sf).groupBy("author").agg(F.count(F.lit(1)).alias("listings"), K.total("total_purchases").alias("sales"))
    return agg.select("author", N.radar_score(F.col("sales"), F.col("listings")).alias("gap_score"))


@query("agg_speed_to_dollar", f"""SELECT *, quantile_cont(dead_pct, 0.5) OVER () AS med_dead, quantile_cont(velocity_per_listing, 0.5) OVER () AS med_velocity
    FROM (SELECT label, listings, coalesce({rnd('dead * 1e2 / nullif(listings, 0)', 1)}, 0e0) AS dead_pct,
    coalesce({rnd('last_month / nullif(listings, 0)', 2)}, 0e0) AS velocity_per_listing, floor(last_month * avg_p)::BIGINT AS monthly_revenue, {rnd('avg_p')} AS avg_price
    FROM (SELECT n.label, {ZEROS}, count_if(m.app_key IS NOT NULL AND coalesce(m.total_purchases, 0) = 0) AS dead,
    coalesce((sum(CASE WHEN m.price_cents > 0 THEN m.price_cents END) / nullif(count_if(m.price_cents > 0), 0)) / 1e2, 0e0) AS avg_p
    FROM niche_list n LEFT JOIN matched m USING (label) GROUP BY 1))""", DIM)
def agg_speed_to_dollar(spark, sf):
    return N.speed_to_dollar(V.listings(spark, sf), NICHES)


@query("agg_keyword_probe", f"""SELECT 'used' AS probe, label, count(*) AS listings, {SUM('total_purchases')} AS sales FROM matched GROUP BY 2 UNION ALL
    SELECT 'rare', label, count(*), {SUM('total_purchases')} FROM matched WHERE price_cents > 0 AND label IN ('cold gear', 'brand 25', 'airships') GROUP BY 2
    HAVING count(*) < 60 AND sum(total_purchases) > 0""", DIM)
def agg_keyword_probe(spark, sf):
    rare = [n for n in NICHES if n.label in ("cold gear", "brand 25", "airships")]
    return N.keyword_probe(V.listings(spark, sf), NICHES, rare, 60)


_WEDGE_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS wedge, * FROM best WHERE {p}" for n, p in WEDGES.items())
WEDGE = {**BEST, "wedged": _WEDGE_ROWS}


@query("agg_wedges", f"""SELECT wedge, count(*) AS listings, count(DISTINCT author) AS publishers, {SUM('total_purchases')} AS lifetime,
    {SUM('last_month_purchases')} AS last_month, {rnd(f'sum({GROSS})', 2)} AS lifetime_gross, {rnd(f'sum({GROSS_LM})', 2)} AS last_month_gross,
    {rnd('quantile_cont(nullif(price_cents, 0), 0.5) / 1e2', 2)} AS median_paid_price FROM wedged GROUP BY 1""", WEDGE)
def agg_wedges(spark, sf):
    return N.wedges(best(spark, sf), WEDGES)


@query("win_wedge_leaders", f"""SELECT wedge, app_key, gross, rank FROM (SELECT *, {rnd(GROSS, 2)} AS gross, row_number() OVER (PARTITION BY wedge
    ORDER BY {rnd(GROSS, 2)} DESC, total_purchases DESC NULLS LAST, app_key) AS rank FROM wedged WHERE price_cents > 0) WHERE rank <= 10""", WEDGE)
def win_wedge_leaders(spark, sf):
    return N.wedge_leaders(best(spark, sf), WEDGES).select("wedge", "app_key", "gross", "rank")


@query("win_niche_topk", """SELECT label, app_key, rank FROM (SELECT *, row_number() OVER (PARTITION BY label
    ORDER BY coalesce(total_purchases, 0) DESC, app_key) AS rank FROM matched) WHERE rank <= 5""", DIM)
def win_niche_topk(spark, sf):
    return N.niche_topk(V.listings(spark, sf), NICHES, 5).select("label", "app_key", "rank")


_LEAD = """ORDER BY coalesce(last_month_purchases, 0) DESC, coalesce(total_purchases, 0) DESC, app_key"""
_DECISIONS = f"""SELECT *, CASE WHEN listings < 5 THEN 'BUILD' WHEN last_month < 3 THEN 'SKIP' WHEN top_price >= 300 THEN 'UNDERCUT'
    WHEN last_month >= 5 THEN 'UNDERCUT' ELSE 'WATCH' END AS decision FROM (
    SELECT n.label, n.pos, n.edition, {ZEROS}, (SELECT display_name FROM rmatched r WHERE r.label = n.label {_LEAD} LIMIT 1) AS top_name,
    coalesce((SELECT coalesce(price_cents, 0) / 1e2 FROM rmatched r WHERE r.label = n.label {_LEAD} LIMIT 1), 0e0) AS top_price
    FROM rlist n LEFT JOIN rmatched m USING (label) GROUP BY 1, 2, 3)"""


@query("label_decision", f"SELECT label, decision, top_name, top_price FROM ({_DECISIONS})", DIM)
def label_decision(spark, sf):
    return N.suite_decisions(V.listings(spark, sf), REGEX_NICHES).select("label", "decision", "top_name", "top_price")


@query("sort_decision", f"""SELECT label, pos, edition, listings, sales, last_month, top_name, top_price, decision,
    CASE WHEN listings = 0 THEN 'no competition' WHEN listings < 5 THEN 'few listings' WHEN last_month = 0 THEN 'no demand' WHEN last_month < 3 THEN 'weak demand'
    WHEN top_price >= 300 THEN 'top price high' WHEN last_month >= 5 AND top_price < 100 THEN 'busy, cheap leader' WHEN last_month >= 5 THEN 'busy' ELSE 'marginal' END AS reason
    FROM ({_DECISIONS})""", DIM)
def sort_decision(spark, sf):
    return N.suite_decisions(V.listings(spark, sf), REGEX_NICHES)


@query("agg_release_count", "SELECT label, count(*) AS n FROM matched WHERE version IN ('17.0', '18.0') GROUP BY 1", DIM)
def agg_release_count(spark, sf):
    rows = V.listings(spark, sf).filter(F.col("version").isin("17.0", "18.0"))
    return M.fan_out(rows, NICHES).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- token niches ------------------------------------------------------------

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
_TOKS = "regexp_extract_all(display_name, '[A-Za-z][A-Za-z0-9]+')"
_KEPT = lambda stop, n: f"list_filter({_TOKS}, lambda t: NOT list_contains({_LIST(stop)}, lower(t)) AND length(t) >= {n})[1]"
TOK = {
    "tok": f"SELECT *, {_KEPT(T.NICHE_STOPWORDS, 4)} AS t FROM listings",
    "tok_agg": """SELECT lower(t) AS niche, arg_min(t, app_key) AS keyword, count(*) AS n_apps, coalesce(sum(total_purchases), 0)::BIGINT AS sum_total,
        coalesce(sum(last_month_purchases), 0)::BIGINT AS sum_last_month,
        coalesce(max(coalesce(total_purchases, 0)) / nullif(sum(total_purchases), 0), 1e0) AS top1_share,
        avg(CASE WHEN review_count >= 5 THEN rating_stars END) AS avg_rating,
        coalesce(count_if(review_count >= 5 AND rating_stars < 4) / nullif(count_if(review_count >= 5 AND rating_stars IS NOT NULL), 0), 0.5e0) AS quality_gap,
        count_if(price_cents > 0) / count(*) AS paid_share,
        coalesce(list_sort(list(price_cents) FILTER (price_cents > 0))[((count_if(price_cents > 0) // 2) + 1)::BIGINT], 0) / 1e2 AS median_price_usd,
        coalesce(sum(last_month_purchases) / nullif(sum(total_purchases), 0), 0e0) AS momentum
        FROM tok WHERE t IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""",
    "tok_p90": """SELECT coalesce(nullif(list_sort(list(log10(sum_total + 1e0)))[round_even(0.9 * (count(*) - 1), 0)::INT + 1], 0), 1e0) AS pl,
        coalesce(nullif(list_sort(list(median_price_usd))[round_even(0.9 * (count(*) - 1), 0)::INT + 1], 0), 1e0) AS pp FROM tok_agg""",
}
_TCOLS = ("niche, keyword, n_apps, sum_total, sum_last_month, " + ", ".join(
    f"{rnd(c, 6)} AS {c}" for c in ("top1_share", "avg_rating", "quality_gap", "paid_share", "median_price_usd", "momentum")))


def _rounded(df, cols, places=6):
    for c in cols:
        df = df.withColumn(c, C.rnd(F.col(c), places))
    return df


@query("tok_primary_keyword", f"SELECT app_key, coalesce({_KEPT(T.CARD_STOPWORDS, 3)}, {_TOKS}[1]) AS keyword FROM listings")
def tok_primary_keyword(spark, sf):
    return V.listings(spark, sf).select("app_key", T.primary_keyword().alias("keyword"))


@query("tok_niche_keyword", "SELECT app_key, t AS keyword FROM tok", TOK)
def tok_niche_keyword(spark, sf):
    return V.listings(spark, sf).select("app_key", T.niche_keyword().alias("keyword"))


@query("agg_token_niches", f"SELECT {_TCOLS} FROM tok_agg", TOK)
def agg_token_niches(spark, sf):
    return _rounded(N.token_niches(V.listings(spark, sf)), ["top1_share", "avg_rating", "quality_gap", "paid_share", "median_price_usd", "momentum"])


@query("win_nearest_rank_p90", f"SELECT {rnd('pl', 6)} AS p_log, {rnd('pp', 6)} AS p_price FROM tok_p90", TOK)
def win_nearest_rank_p90(spark, sf):
    niches = N.token_niches(V.listings(spark, sf))
    a, b = N.nearest_rank_p90(niches, [F.log10(F.col("sum_total") + F.lit(1.0)), F.col("median_price_usd")])
    return spark.range(1).select(C.rnd(a, 6).alias("p_log"), C.rnd(b, 6).alias("p_price"))


@query("score_niches", f"""SELECT niche, n_apps, {rnd('''1e2 * (0.30e0 * least(1e0, log10(sum_total + 1e0) / pl)
    + 0.25e0 * CASE WHEN top1_share >= 0.8 THEN 0e0 WHEN top1_share <= 0.2 THEN 1e0 ELSE (0.8e0 - top1_share) / 0.6e0 END + 0.20e0 * quality_gap
    + 0.15e0 * least(1e0, median_price_usd / pp) + 0.10e0 * least(1e0, momentum / 0.1e0))''', 1)} AS opportunity FROM tok_agg, tok_p90""", TOK)
def score_niches(spark, sf):
    return N.score_niches(N.token_niches(V.listings(spark, sf))).select("niche", "n_apps", "opportunity")


# ---- recommendations ---------------------------------------------------------

REC = {**DIM, "rec_author": """SELECT label, coalesce(nullif(author, ''), 'unknown') AS a, sum(coalesce(total_purchases, 0)) AS t FROM wmatched GROUP BY 1, 2""",
       "rec": """SELECT m.label, category, complexity, count(*) AS n_apps, coalesce(sum(total_purchases), 0)::BIGINT AS total_purchases,
        coalesce(sum(last_month_purchases), 0)::BIGINT AS last_month, (SELECT count(*) FROM rec_author a WHERE a.label = m.label) AS author_count,
        floor(quantile_cont(CASE WHEN price_cents > 0 THEN price_cents END, 0.5))::BIGINT AS median_price_cents, avg(rating_stars) AS avg_rating,
        coalesce(count_if(rating_stars < 4) / nullif(count(rating_stars), 0), 0e0) AS pct_low_rating, count_if(rating_stars IS NULL) / count(*) AS pct_unrated,
        count_if(total_purchases > 0 AND coalesce(last_month_purchases, 0) / total_purchases < 0.005e0) / count(*) AS pct_stale,
        coalesce((SELECT max(t) FROM rec_author a WHERE a.label = m.label) / nullif(sum(total_purchases), 0), 1e0) AS top_author_share,
        sum(coalesce(last_month_purchases, 0) * coalesce(price_cents, 0)) / 1e2 * 0.7e0 AS est_monthly_revenue
        FROM wmatched m GROUP BY 1, 2, 3 HAVING count(*) >= 2"""}
_RSHARES = ("avg_rating", "pct_low_rating", "pct_unrated", "pct_stale", "top_author_share", "est_monthly_revenue")


def _stats(spark, sf):
    return N.recommend_stats(V.listings(spark, sf), WORD_NICHES)


@query("agg_recommend_stats", "SELECT label, category, complexity, n_apps, total_purchases, last_month, author_count, median_price_cents, "
       + ", ".join(f"{rnd(c, 4)} AS {c}" for c in _RSHARES) + " FROM rec", REC)
def agg_recommend_stats(spark, sf):
    return _rounded(_stats(spark, sf), _RSHARES, 4)


@query("score_recommend", f"""SELECT label, n_apps, {rnd('''(0.30e0 * least(1e0, log10(greatest(est_monthly_revenue, 1e0)) / 5e0) + 0.20e0 * pct_low_rating
    + 0.20e0 * (1e0 - top_author_share) + 0.10e0 * pct_stale + 0.10e0 * (1e0 - abs(least(n_apps, 30) - 10) / 30e0)
    + 0.10e0 * least(1e0, coalesce(median_price_cents, 0) / 30000e0)) * (CASE WHEN n_apps > 50 THEN 0.6e0 ELSE 1e0 END * CASE WHEN n_apps < 4 THEN 0.7e0 ELSE 1e0 END
    * CASE WHEN est_monthly_revenue < 5000 THEN 0.5e0 ELSE 1e0 END) * 1e2''', 1)} AS score FROM rec""", REC)
def score_recommend(spark, sf):
    return N.score_recommend(_stats(spark, sf)).select("label", "n_apps", "score")


@query("label_failure_modes", """SELECT label, CASE WHEN len(f) = 0 THEN 'patience' ELSE array_to_string(f[1:3], ', ') END AS modes FROM (SELECT label,
    list_filter([CASE WHEN category IN ('crm', 'hr', 'manufacturing', 'analytics', 'billing') THEN 'platform owner competes' END,
    CASE WHEN complexity = 'L' THEN 'scope too large' END, CASE WHEN top_author_share > 0.5 THEN 'dominant publisher' END,
    CASE WHEN n_apps > 25 THEN 'saturated' END, CASE WHEN est_monthly_revenue < 15000 THEN 'small revenue pool' END], lambda x: x IS NOT NULL) AS f FROM rec)""", REC)
def label_failure_modes(spark, sf):
    return _stats(spark, sf).select("label", F.array_join(N.failure_modes(), ", ").alias("modes"))


@query("label_angle", """SELECT label, CASE WHEN pct_stale > 0.3 THEN 'maintained' WHEN pct_low_rating > 0.4 THEN 'quality' WHEN pct_unrated > 0.5 THEN 'under-marketed'
    WHEN top_author_share > 0.5 AND author_count > 1 THEN 'sub-segment' WHEN median_price_cents > 30000 THEN 'mid-market price' ELSE 'read reviews' END AS angle FROM rec""", REC)
def label_angle(spark, sf):
    return _stats(spark, sf).select("label", N.angle().alias("angle"))


@query("label_angle_figures", """SELECT label, (CASE WHEN pct_stale > 0.3 THEN floor(pct_stale * 100) WHEN pct_low_rating > 0.4 THEN floor(pct_low_rating * 100)
    WHEN pct_unrated > 0.5 THEN floor(pct_unrated * 100) WHEN top_author_share > 0.5 AND author_count > 1 THEN floor(top_author_share * 100)
    WHEN median_price_cents > 30000 THEN floor(median_price_cents) END)::BIGINT AS figure FROM rec""", REC)
def label_angle_figures(spark, sf):
    return _stats(spark, sf).select("label", N.angle_figure().cast("long").alias("figure"))
