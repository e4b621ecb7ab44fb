"""The marketplace tables, expressed over the driver's star schema.

``snapshots`` is one pass over ``lineitem``: the lines of a part are combined
map-side into per-run totals, so one hot part cannot overload a task, and the
four runs are then unfolded from one row per part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

RUN_COUNT = 4
RUN_GAP_DAYS = 90
AS_OF = "2024-01-31"
_PLANS: dict[tuple, DataFrame] = {}


def _planned(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Keep the lazy plan of a view per session and folder; no data is held."""
    @wraps(fn)
    def get(spark: SparkSession, sf: str, *args, **kwargs) -> DataFrame:
        key = (fn.__name__, spark.sparkContext.applicationId, id(spark), sf, args, tuple(kwargs.items()))
        if key not in _PLANS:
            _PLANS[key] = fn(spark, sf, *args, **kwargs)
        return _PLANS[key]
    return get


@_planned
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _last_ship(lineitem: DataFrame) -> Column:
    return lineitem.agg(F.max("l_shipdate").alias("m")).scalar()


def _cap(last: Column, k: int) -> Column:
    return last - F.expr(f"INTERVAL {k * RUN_GAP_DAYS} DAYS")


@_planned
def runs(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "lineitem").agg(F.max("l_shipdate").cast("timestamp").alias("m"))
    k = F.explode(F.sequence(F.lit(0), F.lit(RUN_COUNT - 1))).alias("k")
    return last.select("m", k).select(
        F.concat(F.lit("run-"), (RUN_COUNT - 1 - F.col("k")).cast("string")).alias("run_id"),
        (F.col("m") - F.make_dt_interval(F.col("k") * RUN_GAP_DAYS)).alias("started_at"),
    )


@_planned
def snapshots(spark: SparkSession, sf: str, ks: Sequence[int] = (3, 2, 1, 0)) -> DataFrame:
    """Listing facts per run; ``ks`` are the runs to read, 0 being the latest (run pruning)."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    last = _last_ship(line)
    line = line.select("l_partkey", "l_shipdate", "l_quantity", "l_returnflag").select(
        "l_partkey", "l_quantity", "l_returnflag", (last - F.col("l_shipdate")).alias("_age"))
    age, qty = F.col("_age"), F.col("l_quantity")
    ret = F.col("l_returnflag") == "R"
    aggs = []
    for k in ks:
        seen = age >= F.expr(f"INTERVAL '{k * RUN_GAP_DAYS}' DAY")
        recent = seen & (age < F.expr(f"INTERVAL '{k * RUN_GAP_DAYS + 30}' DAY"))
        aggs += [
            F.count_if(seen).alias(f"n{k}"), F.sum(F.when(seen, qty)).alias(f"q{k}"),
            F.count_if(recent).alias(f"m{k}"), F.sum(F.when(recent, qty)).alias(f"mq{k}"),
            F.count_if(seen & ret).alias(f"r{k}"), F.avg(F.when(seen & ret, qty)).alias(f"rq{k}"),
        ]
    per_part = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(*aggs)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    run = lambda k: F.struct(
        F.lit(f"run-{RUN_COUNT - 1 - k}").alias("run_id"), _cap(F.col("_last"), k).cast("timestamp").alias("captured_at"),
        zero(f"n{k}").alias("n"), zero(f"q{k}").alias("q"), zero(f"m{k}").alias("m"), zero(f"mq{k}").alias("mq"),
        zero(f"r{k}").alias("r"), F.col(f"rq{k}").alias("rq"))
    key, size = F.col("p_partkey"), F.col("p_size")
    muted, bulk = key % 7 == 0, key % 3 == 0
    version = F.concat((16 + key % 4).cast("string"), F.lit(".0"))
    tech = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    unfolded = part.join(per_part, "p_partkey", "left").withColumn("_last", last).select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
        F.explode(F.array(*[run(k) for k in ks])).alias("s"))
    return unfolded.select(
        F.col("s.run_id").alias("run_id"), F.col("s.captured_at").alias("captured_at"),
        F.concat_ws("/", version, tech, key.cast("string")).alias("app_key"),
        version.alias("version"), tech.alias("tech_name"),
        F.col("p_name").alias("display_name"), F.concat_ws(" ", "p_type", "p_brand").alias("summary"),
        F.col("p_brand").alias("author"),
        F.when(size % 5 == 0, F.lit(0).cast("bigint")).when(size % 17 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.floor(F.col("p_retailprice") * 100 / (1 + size))).alias("price_cents"),
        F.lit("$").alias("currency"),
        F.when(muted | (F.col("s.r") == 0), F.lit(None).cast("double"))
        .otherwise(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.floor(F.col("s.rq") / 5.0).cast("double")))).alias("rating_stars"),
        F.when(muted, F.lit(0).cast("bigint")).otherwise(F.col("s.r")).alias("review_count"),
        F.when(muted, F.lit(0).cast("bigint")).when(bulk, F.col("s.q")).otherwise(F.col("s.n")).alias("total_purchases"),
        F.when(muted, F.lit(None).cast("bigint")).when(bulk, F.col("s.mq")).otherwise(F.col("s.m")).alias("last_month_purchases"),
        F.concat(F.lit("/apps/"), F.concat_ws("/", version, tech, key.cast("string"))).alias("detail_url"),
        F.lit(None).cast("string").alias("image_url"),
        key.alias("file_pos"), F.col("s.r").alias("return_lines"),
    )


@_planned
def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the latest run only."""
    return snapshots(spark, sf, ks=(0,))


@_planned
def apps(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).groupBy("app_key", "tech_name", "version").agg(
        F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))


@_planned
def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Forum posts: the first line of a document is the title, the whole text the body."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("community"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("selftext"),
        F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("author"),
        (F.col("n_chars") % 100).alias("score"), (F.col("n_chars") % 17).alias("num_comments"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("first_seen"),
        F.concat(F.lit("/p/"), F.col("doc_id").cast("string")).alias("permalink"))


@_planned
def comments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("author"),
        F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string")).alias("community"),
        F.col("conv_id").alias("link_title"), F.col("text").alias("body"),
        (F.length("text") % 100).cast("bigint").alias("score"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 400).cast("int")).alias("created"))


@_planned
def videos(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        key.alias("id"), F.col("text").alias("title"), (key * 37 % 10007).alias("views"),
        (key % 1800).alias("duration_s"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 400).cast("int")), "yyyyMMdd").alias("upload_date"))


@_planned
def client_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (partner, client) edges."""
    edge = (table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey")
            .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_suppkey").alias("partner_id"), F.col("o_custkey").alias("c_custkey")).distinct())
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return edge.join(cust, "c_custkey").select(
        "partner_id", F.col("c_custkey").alias("client_id"), F.col("c_name").alias("client_name"),
        F.col("c_mktsegment").alias("client_industry"))


@_planned
def partners(spark: SparkSession, sf: str) -> DataFrame:
    """Partners without their clients, which stay edges (``client_refs``); every part belongs to one partner's industries."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    size = s.agg(F.count(F.lit(1)).alias("n")).scalar()
    part = table(spark, sf, "part").select(F.pmod("p_partkey", size).alias("s_suppkey"), "p_type")
    inds = part.groupBy("s_suppkey").agg(F.array_sort(F.collect_set("p_type")).alias("industries"))  # a handful of types
    key, bal = F.col("s_suppkey"), F.col("s_acctbal")
    lo = key % 50
    out = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(inds, "s_suppkey", "left")
    none = F.array().cast("array<string>")
    return out.select(
        key.alias("partner_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"),
        F.when(bal > 7500, "Gold").when(bal > 4000, "Silver").when(bal > 0, "Ready").otherwise("Unknown").alias("grade"),
        F.coalesce("industries", none).alias("industries"),
        F.concat(lo.cast("string"), F.lit("-"), (lo + 10 * (key % 40)).cast("string")).alias("employees"),
        F.when(key % 2 == 0, F.concat(F.lit("p"), key.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(key % 3 == 0, F.concat(F.lit("+1 555 "), key.cast("string"))).alias("phone"),
        F.when(key % 5 == 0, F.concat(F.lit("https://p"), key.cast("string"), F.lit(".example.com"))).alias("website"),
        F.concat(F.lit("serves "), F.lower("n_name")).alias("description"),
        (bal / 100).alias("balance"))


@_planned
def partner_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Partners with their clients in pages of at most a thousand, by the range of the client's number; one page without clients for those without any."""
    pages = client_refs(spark, sf).groupBy(F.col("partner_id").alias("_partner"), F.floor(F.col("client_id") / 1000).alias("page")).agg(F.array_sort(F.collect_list("client_name")).alias("clients"))
    met = partners(spark, sf).join(pages, F.col("partner_id") == F.col("_partner"), "left").drop("_partner")
    return met.withColumn("clients", F.coalesce("clients", F.array().cast("array<string>")))


@_planned
def checkins(spark: SparkSession, sf: str) -> DataFrame:
    """One row per listing and check-in week, from its four runs."""
    by_app = W.partitionBy("app_key").orderBy("captured_at")
    key, total, last = F.col("file_pos"), F.col("total_purchases"), F.coalesce("last_month_purchases", F.lit(0))
    before = F.coalesce(F.lag(last).over(by_app), F.lit(0))
    week = F.create_map(*[F.lit(x) for kv in (("run-0", 2), ("run-1", 4), ("run-2", 8), ("run-3", 12)) for x in kv])
    return snapshots(spark, sf).select(
        "app_key", F.element_at(week, F.col("run_id")).alias("week"),
        total.alias("installs_total"), (F.col("return_lines") % 5).alias("refunds_total"),
        F.col("review_count").alias("reviews_count"), (total * 10).alias("listing_visitors"),
        (key % 4).alias("bug_reviews"), before.alias("installs_weeks_1_2"), last.alias("installs_weeks_7_8"),
        (F.coalesce("price_cents", F.lit(0)) / F.lit(100.0) * last).alias("revenue"),
        F.when(last > before, "growing").when(last == before, "flat").otherwise("declining").alias("trend"),
        (key % 25).alias("hours"), (1 + key % 10).alias("motivation"))
