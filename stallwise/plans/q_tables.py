"""Readers, sinks and table maintenance, each on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise import schemas
from stallwise.functions import columns as C
from stallwise.operators import maintain as A, market as K, partners as P, scoring as S
from stallwise.plans import views as V
from stallwise.plans.registry import query
from stallwise.sources.arrays import read_json_array
from stallwise.plans.sqlviews import rnd
from stallwise.session import fresh_path
from stallwise.sources import readers as R, writers as O

_CARD = schemas.fields(schemas.CARD)
_PICK = "tech_name, version, display_name, author, price_cents, rating_stars, review_count, total_purchases, last_month_purchases"
#: Profiles of one compressed file, which one task reads; a partner with many pages of clients repeats its fields in each.
PROFILES = 1_000_000
#: Cards of one array, some 270 MB: more than one task reads at a time, and what a single task may write.
ARRAY_CARDS = 1_000_000
_day = lambda c: F.date_format(c, "yyyy-MM-dd")


@query("src_snapshot_json", f"SELECT {_PICK}, detail_url FROM listings")
def src_snapshot_json(spark, sf):
    path = fresh_path(spark, "cards")
    cards = V.listings(spark, sf).select(F.floor(F.col("file_pos") / 20).alias("page"), *_CARD)
    O.write_card_pages(cards, path, "page")
    return R.read_cards(spark, path, multi_line=False).select(*_PICK.split(", "), "detail_url")


@query("src_run_meta", "SELECT run_id, strftime(started_at, '%Y-%m-%d') AS started_at, run_id <> 'run-3' AS finished FROM runs")
def src_run_meta(spark, sf):
    path = fresh_path(spark, "runs")
    runs = V.runs(spark, sf)
    iso = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    O.write_run_meta(runs.select("run_id", iso.alias("started_at"), F.when(F.col("run_id") != "run-3", iso).alias("finished_at")), path)
    return R.read_run_meta(spark, path).select("run_id", _day("started_at").alias("started_at"), F.col("finished_at").isNotNull().alias("finished"))


def write_arrays(lines, path, at_most=ARRAY_CARDS):
    """Records (``value``) as JSON arrays in files of their own, each written by one task; an empty object ends an array."""
    files = max(1, -(-lines.count() // at_most))
    part = F.pmod(F.xxhash64("value"), F.lit(files)).cast("int")
    spark = lines.sparkSession
    ends = spark.range(files).select(F.col("id").cast("int").alias("part"), F.explode(F.expr("map(0, '[', 2, '{}]')")).alias("at", "value"))
    rows = lines.select(part.alias("part"), F.lit(1).alias("at"), F.concat("value", F.lit(",")).alias("value")).unionByName(ends)
    rows.repartition(files, "part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)


@query("src_json_array", f"SELECT {_PICK}, detail_url FROM listings")
def src_json_array(spark, sf):
    """Cards as one array in one file, read by several tasks; of more than ``ARRAY_CARDS`` cards, as several such files of like size."""
    lines, arrays = fresh_path(spark, "lines"), fresh_path(spark, "array")
    V.listings(spark, sf).select(F.to_json(F.struct(*_CARD)).alias("value")).write.parquet(lines)
    write_arrays(spark.read.parquet(lines), arrays)
    return read_json_array(spark, arrays, schemas.CARD).filter("tech_name IS NOT NULL").select(*_PICK.split(", "), "detail_url")


@query("src_run_discovery", "SELECT 'day=' || strftime(started_at, '%Y-%m-%d') AS day, 'run=' || run_id AS run, run_id = 'run-3' AS is_latest FROM runs")
def src_run_discovery(spark, sf):
    path = fresh_path(spark, "tree")
    rows = V.snapshots(spark, sf).groupBy("run_id", "captured_at").agg(F.count(F.lit(1)).alias("app_count"))
    rows.select(_day("captured_at").alias("day"), F.col("run_id").alias("run"), "app_count").write.partitionBy("day", "run").json(path)
    return R.discover_runs(spark, path, "*.json")


_PCOLS = "partner_id, name, grade, country, employees"


@query("src_csv", f"SELECT {_PCOLS.replace('partner_id', 'partner_id::VARCHAR AS partner_id')}, array_to_string(industries, '; ') AS industries FROM partners")
def src_csv(spark, sf):
    path = fresh_path(spark, "partners")
    rows = V.partners(spark, sf).withColumn("industries", F.array_join("industries", "; "))
    fields = schemas.fields(schemas.PARTNER)
    O.append_csv(rows.select(*[(F.col(c) if c in rows.columns else F.lit("")).cast("string").alias(c) for c in fields]), path, fields)
    return R.read_csv(spark, path, schemas.PARTNER).select(*_PCOLS.split(", "), "industries")


@query("src_tsv_videos", """SELECT id::VARCHAR AS id, CASE WHEN views % 5 = 0 THEN 0 ELSE views END AS views, CASE WHEN duration_s % 4 = 0 THEN 0 ELSE duration_s END AS duration_s,
    length(replace(replace(title, chr(10), ' '), chr(9), ' ')) AS chars FROM videos""")
def src_tsv_videos(spark, sf):
    path = fresh_path(spark, "videos")
    clean = F.translate("title", "\n\t", "  ")
    line = F.concat_ws("\t", clean, F.col("id").cast("string"), F.when(F.col("views") % 5 == 0, "NA").otherwise(F.col("views").cast("string")),
                       F.when(F.col("duration_s") % 4 == 0, "?").otherwise(F.concat(F.col("duration_s").cast("string"), F.lit(".0"))), "upload_date")
    short = V.videos(spark, sf).select(F.concat_ws("\t", F.lit("cut"), F.col("id").cast("string")).alias("value"))
    V.videos(spark, sf).select(line.alias("value")).unionByName(short).write.text(path)
    return R.read_videos_tsv(spark, path, "https://videos.example.com/").select("id", "views", "duration_s", F.length("title").alias("chars"))


@query("src_url_list", "SELECT trim(url) AS url FROM pages WHERE trim(url) LIKE 'http%'")
def src_url_list(spark, sf):
    path = fresh_path(spark, "urls")
    pages = V.table(spark, sf, "pages")
    pages.select(F.concat(F.lit("  "), "url").alias("value")).unionByName(pages.select(F.concat(F.lit("# "), "url").alias("value"))).write.text(path)
    return R.read_url_list(spark, path)


@query("src_jsonl", "SELECT id::VARCHAR AS id, community, score, body FROM comments")
def src_jsonl(spark, sf):
    path = fresh_path(spark, "comments")
    V.comments(spark, sf).select(F.col("id").cast("string").alias("id"), F.lit("t1").alias("kind"), "community", "score", "body").write.json(path)
    return R.read_jsonl(spark, path).select("id", "community", "score", "body")


@query("src_nested_listing", "SELECT id::VARCHAR AS id, community, title, CASE WHEN score < 10 THEN '[deleted]' ELSE author END AS author, score, "
       "CASE WHEN num_comments < 3 THEN 0 ELSE num_comments END AS num_comments FROM posts WHERE num_comments > 0")
def src_nested_listing(spark, sf):
    path = fresh_path(spark, "listing")
    item = F.struct(F.when(F.col("num_comments") == 0, "t5").otherwise("t3").alias("kind"), F.struct(
        F.col("id").cast("string").alias("id"), "community", "title", "selftext", F.when(F.col("score") >= 10, F.col("author")).alias("author"), "score",
        F.when(F.col("num_comments") >= 3, F.col("num_comments")).alias("num_comments")).alias("data"))
    page = V.posts(spark, sf).groupBy(F.floor(F.col("id") / 25).alias("page")).agg(F.collect_list(item).alias("children"))  # 25 per API page
    page.select(F.struct("children").alias("data")).write.json(path)
    return R.read_listing_pages(spark, path).drop("selftext")


@query("src_partner_json", """SELECT name AS partner_name, country AS location, email, employees, array_to_string(industries, ',') AS industries,
    coalesce(names, '') AS clients FROM partners p LEFT JOIN (SELECT partner_id, string_agg(client_name, ',' ORDER BY client_name) AS names
    FROM client_refs GROUP BY partner_id, client_id // 1000) r USING (partner_id)""")
def src_partner_json(spark, sf):
    """A profile for each partner and page of up to a thousand clients."""
    path = fresh_path(spark, "profiles")
    V.partner_pages(spark, sf).select(F.col("name").alias("partner_name"), F.col("country").alias("location"), "website", "email", "phone",
                                 F.col("grade").alias("certification"), "employees", "industries", "clients", "description").write.option("maxRecordsPerFile", PROFILES).json(path, compression="gzip")
    return R.read_partner_profiles(spark, path, multi_line=False).select(
        "partner_name", "location", "email", "employees", F.array_join("industries", ",").alias("industries"), F.array_join("clients", ",").alias("clients"))


@query("src_html_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def src_html_pages(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("chars"))


# ---- maintenance -------------------------------------------------------------

@query("tbl_stage_dedupe", "SELECT version, tech_name, file_pos, price_cents FROM listings QUALIFY row_number() OVER (PARTITION BY version, tech_name ORDER BY file_pos) = 1")
def tbl_stage_dedupe(spark, sf):
    return A.stage_dedupe(V.listings(spark, sf)).select("version", "tech_name", "file_pos", "price_cents")


@query("win_stage_dedupe", "SELECT author, min(file_pos) AS file_pos FROM listings GROUP BY 1")
def win_stage_dedupe(spark, sf):
    return A.first_rows(V.listings(spark, sf), [F.col("author")], F.col("file_pos")).select("author", "file_pos")


@query("tbl_replace_run", "SELECT run_id, count(*) AS n, sum(total_purchases)::BIGINT AS sales FROM snapshots WHERE run_id <> 'run-3' OR price_cents > 0 GROUP BY 1")
def tbl_replace_run(spark, sf):
    path = fresh_path(spark, "snapshots")
    O.write_partitioned(V.snapshots(spark, sf), path)
    O.write_partitioned(V.listings(spark, sf).filter(C.paid()), path)  # the same run again, with fewer rows
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_purchases").alias("sales"))


@query("tbl_merge_apps", """SELECT app_key, strftime(min(captured_at), '%Y-%m-%d') AS first_seen, strftime(max(captured_at), '%Y-%m-%d') AS last_seen
    FROM snapshots WHERE (run_id = 'run-3' AND price_cents > 0) OR (run_id < 'run-3' AND total_purchases > 20) GROUP BY 1""")
def tbl_merge_apps(spark, sf):
    old = V.snapshots(spark, sf).filter("run_id < 'run-3' AND total_purchases > 20").groupBy("app_key", "tech_name", "version").agg(
        F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))
    new = V.listings(spark, sf).filter(C.paid())
    return A.merge_apps(old, new, F.col("captured_at")).select("app_key", _day("first_seen").alias("first_seen"), _day("last_seen").alias("last_seen"))


_IDS = """SELECT app_key, (SELECT max(file_pos) FROM listings) + row_number() OVER (ORDER BY substring(md5(app_key), 1, 3), app_key) AS snapshot_id FROM listings"""


@query("tbl_surrogate_id", _IDS)
def tbl_surrogate_id(spark, sf):
    rows = V.listings(spark, sf)
    return A.surrogate_ids(rows.agg(F.max("file_pos").alias("m")).scalar(), rows, "app_key").select("app_key", "snapshot_id")


@query("win_row_id", "SELECT id, row_number() OVER (ORDER BY substring(md5(id::VARCHAR), 1, 3), id::VARCHAR) AS row_id FROM posts")
def win_row_id(spark, sf):
    rows = V.posts(spark, sf).select("id", F.col("id").cast("string").alias("key"))
    return A.surrogate_ids(F.lit(0), rows, "key", "row_id").select("id", "row_id")


@query("tbl_init_migrate", "SELECT p_partkey::BIGINT AS p_partkey, p_size::BIGINT AS p_size, p_name, NULL::VARCHAR AS note FROM part")
def tbl_init_migrate(spark, sf):
    return A.widen(spark, V.table(spark, sf, "part"), "p_partkey bigint, p_size bigint, p_name string, note string")


@query("tbl_info", """SELECT 'runs' AS metric, count(*)::VARCHAR AS value FROM runs UNION ALL SELECT 'apps', count(*)::VARCHAR FROM apps UNION ALL
    SELECT 'snapshots', count(*)::VARCHAR FROM snapshots UNION ALL SELECT 'latest', strftime(max(captured_at), '%Y-%m-%d') FROM snapshots""")
def tbl_info(spark, sf):
    return A.info(V.runs(spark, sf), V.apps(spark, sf), V.snapshots(spark, sf))


@query("tbl_rebuild_scores", "SELECT run_id, app_key, trend_score, opportunity_score FROM scored")
def tbl_rebuild_scores(spark, sf):
    path = fresh_path(spark, "scores")
    rows = S.score_apps(V.listings(spark, sf)).select("run_id", "app_key", "trend_score", "opportunity_score")
    O.write_partitioned(rows.withColumn("trend_score", F.lit(0.0)), path)
    O.write_partitioned(rows, path)
    return spark.read.parquet(path)


def _post_copies(spark, sf):
    """The table as stored, and a later pull that overlaps it with changed counts."""
    p = V.posts(spark, sf).select("id", "community", "title", "score", "num_comments", F.col("first_seen").cast("string").alias("first_seen"),
                                  F.col("first_seen").cast("string").alias("last_seen"), F.lit("a").alias("signals"))
    old = p.filter("first_seen <= '2024-01-20'")
    new = p.filter("first_seen >= '2024-01-15'").select("id", F.lit("moved").alias("community"), F.upper("title").alias("title"), (F.col("score") + 5).alias("score"),
                                                        (F.col("num_comments") + 1).alias("num_comments"), F.lit("2024-02-01").alias("first_seen"),
                                                        F.lit("2024-02-01").alias("last_seen"), F.lit("b").alias("signals"))
    return old, new


_UPSERT = """SELECT id, CASE WHEN first_seen > '2024-01-20' THEN 'moved' ELSE community END AS community, CASE WHEN first_seen >= '2024-01-15' THEN score + 5 ELSE score END AS score,
    CASE WHEN first_seen >= '2024-01-15' THEN num_comments + 1 ELSE num_comments END AS num_comments,
    CASE WHEN first_seen > '2024-01-20' THEN '2024-02-01' ELSE first_seen::VARCHAR END AS first_seen,
    CASE WHEN first_seen >= '2024-01-15' THEN '2024-02-01' ELSE first_seen::VARCHAR END AS last_seen, CASE WHEN first_seen >= '2024-01-15' THEN 'b' ELSE 'a' END AS signals,
    CASE WHEN first_seen > '2024-01-20' THEN 'new' WHEN first_seen >= '2024-01-15' THEN 'updated' ELSE 'kept' END AS change FROM posts"""


@query("tbl_upsert_posts", _UPSERT)
def tbl_upsert_posts(spark, sf):
    return A.upsert_posts(*_post_copies(spark, sf)).drop("title")


@query("tbl_upsert_repeats", f"SELECT id, community, score + 7 * (change <> 'kept')::INT AS score, num_comments, first_seen, CASE WHEN change = 'kept' THEN last_seen ELSE '2024-02-03' END AS last_seen, signals, change FROM ({_UPSERT})")
def tbl_upsert_repeats(spark, sf):
    """Each post of the pull comes three times, in any order: the first copy's text and the last copy's counts win."""
    old, new = _post_copies(spark, sf)
    later = lambda day, by: new.withColumns({"last_seen": F.lit(day), "score": F.col("score") + by, "community": F.lit("late"), "first_seen": F.lit(day)})
    return A.upsert_posts(old.unionByName(old), later("2024-02-03", 7).unionByName(new).unionByName(later("2024-02-02", 3))).drop("title")


@query("tbl_upsert_counts", f"SELECT count_if(change = 'new') AS new, count_if(change = 'updated') AS updated FROM ({_UPSERT})")
def tbl_upsert_counts(spark, sf):
    return A.change_counts(A.upsert_posts(*_post_copies(spark, sf)))


@query("tbl_incremental_skip", "SELECT partner_id, name FROM partners WHERE grade NOT IN ('Gold', 'Silver')")
def tbl_incremental_skip(spark, sf):
    crawled = V.partners(spark, sf).filter(F.col("grade").isin("Gold", "Silver"))
    return A.unseen(V.partners(spark, sf), crawled, "partner_id").select("partner_id", "name")


@query("join_anti_seen", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_anti_seen(spark, sf):
    seen = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return A.unseen(V.table(spark, sf, "customer"), seen, "c_custkey").select("c_custkey")


@query("set_except", "SELECT app_key FROM listings WHERE contains(lower(summary), 'small') EXCEPT SELECT app_key FROM listings WHERE contains(lower(display_name), 'small')")
def set_except(spark, sf):
    rows = V.listings(spark, sf)
    return A.unseen(rows.filter(F.lower("summary").contains("small")), rows.filter(F.lower("display_name").contains("small")), "app_key").select("app_key")


# ---- sinks -------------------------------------------------------------------

@query("snk_jsonl_append", "SELECT id, title, score FROM posts UNION ALL SELECT id, title, score FROM posts WHERE score > 50")
def snk_jsonl_append(spark, sf):
    path = fresh_path(spark, "days")
    p = V.posts(spark, sf).select("id", "title", "score")
    O.append_jsonl(p, path)
    O.append_jsonl(p.filter("score > 50"), path)
    return spark.read.schema(p.schema).json(path)


@query("snk_csv_append", "SELECT client_id, client_name, client_industry FROM client_refs")
def snk_csv_append(spark, sf):
    path = fresh_path(spark, "refs")
    refs = V.client_refs(spark, sf)
    fields = ["client_id", "client_name", "client_industry"]
    O.append_csv(refs.filter("client_industry < 'G'"), path, fields)
    O.append_csv(refs.filter("client_industry >= 'G'"), path, fields)
    return R.read_csv(spark, path, "client_id bigint, client_name string, client_industry string")


@query("snk_json_run", "SELECT 'cards' AS part, count(*) AS n FROM listings UNION ALL SELECT 'runs', count(*) FROM runs")
def snk_json_run(spark, sf):
    cards, meta = fresh_path(spark, "run-cards"), fresh_path(spark, "run-meta")
    O.write_card_pages(V.listings(spark, sf).select(F.floor(F.col("file_pos") / 20).alias("page"), *_CARD), cards, "page")
    O.write_run_meta(V.runs(spark, sf), meta)
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n("cards", R.read_cards(spark, cards, False)).unionByName(n("runs", R.read_run_meta(spark, meta)))


def _ranked(df, order, n):
    return K.rank_within(K.top(df, order, n).withColumn("_one", F.lit(1)), ["_one"], order, n).drop("_one")


@query("snk_csv_rank", f"""SELECT rank, app_key, format('{{:.2f}}', trend_score) AS trend, format('{{:.2f}}', opportunity_score) AS opportunity,
    CASE WHEN coalesce(price_cents, 0) = 0 THEN 'Free' ELSE '$' || format('{{:,}}', {rnd('price_cents / 1e2')}::BIGINT) END AS price, format('{{:,}}', coalesce(total_purchases, 0)) AS sales
    FROM (SELECT *, row_number() OVER (ORDER BY trend_score DESC, app_key) AS rank FROM scored) WHERE rank <= 50""")
def snk_csv_rank(spark, sf):
    path = fresh_path(spark, "rank")
    rows = O.rank_export(_ranked(S.score_apps(V.listings(spark, sf)), [K.desc("trend_score"), F.col("app_key")], 50))
    O.append_csv(rows, path, rows.columns)
    return R.read_csv(spark, path, "rank int, app_key string, trend string, opportunity string, price string, sales string")


@query("snk_url_list", "SELECT DISTINCT split_part(url, '#', 1) AS url FROM pages")
def snk_url_list(spark, sf):
    path = fresh_path(spark, "url-list")
    O.write_url_list(V.table(spark, sf, "pages").select(F.split_part("url", F.lit("#"), F.lit(1)).alias("url")), path)
    return R.read_url_list(spark, path)


@query("snk_refs", "SELECT partner_id, count(*) AS flat, count(*) AS nested FROM client_refs GROUP BY 1")
def snk_refs(spark, sf):
    flat, nested = fresh_path(spark, "refs-flat"), fresh_path(spark, "refs-nested")
    O.write_refs(V.client_refs(spark, sf), flat, nested, F.floor(F.col("client_id") / 100))
    a = R.read_csv(spark, flat, "partner_id bigint, client_id bigint, client_name string, client_industry string").groupBy("partner_id").agg(F.count("*").alias("flat"))
    b = spark.read.schema("partner_id bigint, page bigint, references array<struct<client_name: string, client_industry: string>>").json(nested)
    return a.join(b.groupBy("partner_id").agg(F.sum(F.size("references")).alias("nested")), "partner_id")


@query("snk_contact_db", """SELECT partner_id, name, email, phone, website, '[' || array_to_string(list_transform(industries, lambda x: '"' || x || '"'), ',') || ']' AS industries,
    '[' || array_to_string(list_transform(clients[1:3], lambda x: '"' || x || '"'), ',') || ']' AS clients FROM partners""")
def snk_contact_db(spark, sf):
    known = V.partners(spark, sf).join(P.first_clients(V.client_refs(spark, sf)), F.col("partner_id") == F.col("_partner"), "left")
    return O.contact_rows(known.withColumn("clients", F.coalesce("clients", F.array().cast("array<string>"))))


@query("snk_leaderboard_json", "SELECT section, count(*) AS n FROM (SELECT 'publishers' AS section FROM (SELECT DISTINCT author FROM listings WHERE price_cents > 0 AND total_purchases > 0 LIMIT 25) UNION ALL "
       "SELECT 'apps' FROM (SELECT app_key FROM listings WHERE price_cents > 0 AND total_purchases > 0 LIMIT 20)) GROUP BY 1")
def snk_leaderboard_json(spark, sf):
    rows, path = V.listings(spark, sf), fresh_path(spark, "leaders")
    K.publishers_gross(rows, "total_purchases").write.json(f"{path}/section=publishers")
    K.top_gross(rows).write.json(f"{path}/section=apps")
    return spark.read.schema("author string, gross double, section string").json(path).groupBy("section").agg(F.count("*").alias("n"))


@query("snk_report_rows", f"""SELECT * FROM (SELECT 'publishers' AS section, row_number() OVER (ORDER BY listings DESC, author)::INT AS rank, author || ' | ' || listings AS text
    FROM (SELECT author, count(*) AS listings FROM listings GROUP BY 1)) WHERE rank <= 5 UNION ALL SELECT * FROM (SELECT 'stale', row_number() OVER (ORDER BY total_purchases DESC, app_key)::INT AS rank,
    app_key || ' | ' || total_purchases FROM listings WHERE price_cents > 0 AND total_purchases > 100 AND coalesce(last_month_purchases, 0) = 0) WHERE rank <= 5""")
def snk_report_rows(spark, sf):
    rows = V.listings(spark, sf)
    pub = _ranked(rows.groupBy("author").agg(F.count("*").alias("listings")), [K.desc("listings"), F.col("author")], 5)
    stale = _ranked(K.stale_incumbents(rows, 5), [K.desc("total_purchases"), F.col("app_key")], 5)
    return O.report_rows([("publishers", pub, ["author", "listings"]), ("stale", stale, ["app_key", "total_purchases"])])
