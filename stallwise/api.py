"""The commands of the toolkit as functions from DataFrames to DataFrames.

Every function takes whole tables; ``run_id`` defaults to the run with the
newest capture.  Nothing is collected: callers decide what to show or write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.functions import columns as C, match as M
from stallwise.functions.match import Niche
from stallwise.operators import forum, maintain, market, niches as niche_ops, partners as partner_ops, scoring, validate as idea
from stallwise.operators.market import desc, rank_within, top
from stallwise import schemas
from stallwise.session import fresh_path
from stallwise.sources import readers
from stallwise.sources.arrays import read_json_array
from stallwise.sources.writers import write_partitioned


def of_run(snapshots: DataFrame, run_id: str | None = None) -> DataFrame:
    if run_id is not None:
        return snapshots.filter(F.col("run_id") == run_id)
    newest = snapshots.agg(F.max_by("run_id", F.struct("captured_at", "run_id")).alias("r")).scalar()
    return snapshots.filter(F.col("run_id") == newest)


def load_run(spark: SparkSession, run_dir: str, facts_path: str, run_id: str) -> None:
    """Load one crawl folder (apps.json, run.json) into the fact table; loading again replaces it."""
    # A card's byte in its file settles which duplicate stays, however the file is split.
    placed = read_json_array(spark, f"{run_dir}/apps.json", schemas.CARD).withColumnRenamed("_pos", "file_pos").drop("_file")
    meta = readers.read_run_meta(spark, f"{run_dir}/run.json", multi_line=True)
    refuse_unstarted(meta)
    write_partitioned(maintain.to_snapshots(placed, run_id, meta.agg(F.max("started_at").alias("s")).scalar()), facts_path)


def refuse_unstarted(meta: DataFrame) -> None:
    bad = [r["folder"] for r in meta.filter("started_at IS NULL OR run_id IS NULL").select("folder").limit(5).collect()]
    if bad:
        raise ValueError(f"runs without an id or a start time: {bad}")


def load_all(spark: SparkSession, root: str, facts_path: str) -> list[str]:
    """Load every run folder under ``root``, oldest first; the list of runs is as small as their number."""
    found = readers.discover_runs(spark, root).orderBy("day", "run").collect()
    for r in found:
        load_run(spark, f"{root}/{r['day']}/{r['run']}", facts_path, r["run"])
    return [r["run"] for r in found]


def load_tables(spark: SparkSession, root: str, tables: str) -> None:
    """Load all run folders ``root/<day>/<run>/`` in one job into the tables ``runs``, ``apps`` and ``snapshots`` under ``tables``.

    Runs that are there already are replaced: their facts get the numbers after
    the greatest of the other runs, so loading the same folders again gives the
    same tables.  A listing keeps the earliest run that had it as ``first_seen``
    and the latest as ``last_seen``, whatever the order of loading.  A crawl's
    array is read by as many tasks as its size asks for.
    """
    meta = readers.read_run_meta(spark, f"{root}/*/*/run.json", multi_line=True)
    refuse_unstarted(meta)
    runs = meta.groupBy("run_id").agg(F.max(F.struct("started_at", "finished_at", "page_count", "app_count", "note", "folder")).alias("r")).select("run_id", "r.*")
    cards = read_json_array(spark, f"{root}/*/*/apps.json", schemas.CARD).withColumn("folder", F.regexp_replace("_file", "/[^/]*$", ""))
    of_runs = cards.join(runs.select("run_id", F.col("started_at").alias("captured_at"), "folder"), "folder")
    valid = of_runs.filter(F.col("version").isNotNull() & F.col("tech_name").isNotNull())
    first = maintain.first_rows(valid, [F.col("run_id"), F.col("version"), F.col("tech_name")], F.col("_pos"))
    facts = first.select("run_id", C.app_key().alias("app_key"), "captured_at", *[c for c in schemas.fields(schemas.CARD)])
    # Facts are stored once; ids, apps and the run table all come from that copy.
    staged = fresh_path(spark, "facts")
    facts.write.parquet(staged)
    facts = spark.read.parquet(staged)
    old = _stored(spark, f"{tables}/snapshots")
    kept = None if old is None else old.join(runs.select("run_id"), "run_id", "left_anti")
    top_id = F.lit(0) if kept is None else kept.agg(F.max("snapshot_id").alias("m")).scalar()
    numbered = maintain.surrogate_ids(top_id, facts.withColumn("_key", F.concat_ws("/", "run_id", "app_key")), "_key").drop("_key")
    ids = fresh_path(spark, "numbered")
    numbered.write.parquet(ids)
    write_partitioned(spark.read.parquet(ids), f"{tables}/snapshots")
    write_partitioned(runs.drop("folder"), f"{tables}/runs")
    new_apps = facts.groupBy("app_key", "tech_name", "version").agg(F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))
    old_apps = _stored(spark, f"{tables}/apps")
    both = new_apps if old_apps is None else old_apps.select(new_apps.columns).unionByName(new_apps)
    apps = both.groupBy("app_key").agg(F.min("tech_name").alias("tech_name"), F.min("version").alias("version"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    merged = fresh_path(spark, "apps")
    apps.write.parquet(merged)
    spark.read.parquet(merged).write.mode("overwrite").parquet(f"{tables}/apps")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where nothing has been written yet."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    return spark.read.parquet(path) if there else None


def score(snapshots: DataFrame, run_id: str | None = None) -> DataFrame:
    return scoring.score_apps(of_run(snapshots, run_id))


def trends(snapshots: DataFrame, n: int = 20, run_id: str | None = None) -> DataFrame:
    return scoring.top_trends(score(snapshots, run_id), n)


def niche(snapshots: DataFrame, keyword: str, n: int = 20, name_only: bool = False, run_id: str | None = None) -> dict[str, DataFrame]:
    """Best listings of a keyword, their totals, and the day-one verdict."""
    fields = ["display_name"] if name_only else list(niche_ops.BOTH)
    hits = score(snapshots, run_id).filter(M.contains(fields, [keyword]))
    return {"apps": top(hits, [desc("opportunity_score"), F.col("app_key")], n), "totals": niche_ops.rollup(hits, [M.niche(keyword, keyword)], fields),
            "gate": scoring.day1_gate(hits)}


def card(snapshots: DataFrame, n: int = 10, run_id: str | None = None) -> DataFrame:
    return scoring.cards(score(snapshots, run_id), n)


def niches(snapshots: DataFrame, min_apps: int = 3, n: int = 30, run_id: str | None = None) -> DataFrame:
    scored = niche_ops.score_niches(niche_ops.token_niches(of_run(snapshots, run_id), min_apps))
    return top(scored, [desc("opportunity"), F.col("niche")], n)


def recommend(snapshots: DataFrame, dim: Sequence[Niche], n: int = 10, only: str | None = None, run_id: str | None = None) -> DataFrame:
    """Ranked keyword niches with risks and angle; ``only`` asks for a single one."""
    chosen = [d for d in dim if only is None or d.label == only]
    scored = niche_ops.score_recommend(niche_ops.recommend_stats(of_run(snapshots, run_id), chosen))
    return top(scored, [desc("score"), F.col("label")], n).withColumn("risks", niche_ops.failure_modes()).withColumn("angle", niche_ops.angle())


def planning_stats(snapshots: DataFrame, version: str, region: Sequence[str], run_id: str | None = None, all_runs: bool = False) -> dict[str, DataFrame]:
    """The planning report's sections; ``all_runs`` counts every capture instead of one run."""
    rows = snapshots if all_runs else of_run(snapshots, run_id)
    regional = M.contains(["author"], region)
    return {"sizing": market.market_sizing(rows, version), "prices": market.price_percentiles(rows),
            "velocity": market.bucket_counts(rows, C.velocity_bucket(), C.VELOCITY_BUCKETS),
            "lifetime": market.bucket_counts(rows, C.lifetime_bucket(), C.LIFETIME_BUCKETS), "publishers": market.publishers_portfolio(rows),
            "top_apps": market.top_gross(rows), "region": market.region_position(rows, regional), "region_publishers": market.region_publishers(rows, regional)}


def leaderboard(snapshots: DataFrame, wedges: dict[str, str]) -> dict[str, DataFrame]:
    """The five result sets of the publisher leaderboard, over the best row of every product."""
    best = market.best_per_app(market.latest_per_app(snapshots))
    return {"lifetime": market.publishers_gross(best, "total_purchases"), "last_month": market.publishers_gross(best, "last_month_purchases"),
            "apps": market.top_gross(best, 60), "wedges": niche_ops.wedges(best, wedges), "wedge_leaders": niche_ops.wedge_leaders(best, wedges),
            "portfolios": market.portfolios(best)}


def validate(snapshots: DataFrame, ideas: Sequence[Niche], name_only: bool = True, min_purchases: int = 0, words: idea.Words = idea.Words(),
             run_id: str | None = None) -> DataFrame:
    """Everything known about each idea in one row: facts, sub-scores, verdict, sizing, labels and break-even."""
    fields = ("display_name",) if name_only else niche_ops.BOTH
    text = F.col("idea")
    rows = idea.sub_scores(idea.idea_metrics(of_run(snapshots, run_id), ideas, fields, min_purchases), text, words)
    effort = idea.effort(text)
    rows = idea.break_even(idea.sizing(rows), effort.getField("effort"))
    v = F.col("viability")
    return rows.select("*", idea.verdict(v).alias("verdict"), idea.success_probability(v).alias("success_pct"), idea.regulatory_risk(text).alias("risk"),
                       effort.alias("effort"), idea.owned(text).alias("owned_by_platform"), idea.go_to_market(F.col("avg_price")).alias("go_to_market"),
                       idea.pivots().alias("pivots"), idea.actions(v).alias("actions"))


def partner_fit(profiles: DataFrame, min_score: int = 60, n: int = 50, refs: DataFrame | None = None) -> DataFrame:
    """The best partners; ``refs`` (partner_id, client_name) stand for a column ``clients``."""
    best = partner_ops.top_partners(partner_ops.score_fit(profiles, refs=refs), min_score, n).withColumn("_one", F.lit(1))
    return rank_within(best, ["_one"], [desc("fit"), F.col("partner_id")], n).drop("_one")


def forum_report(posts: DataFrame, patterns: dict[str, str], as_of: str, days: int = 7, n: int = 10) -> dict[str, DataFrame]:
    tagged = forum.tag_signals(posts, patterns)
    window = forum.recent(posts, as_of, days)
    return {"totals": forum.window_totals(posts, as_of, days), "by_signal": forum.top_by_signal(tagged, as_of, days, n), "communities": forum.by_community(window),
            "authors": forum.repeat_authors(window), "words": forum.token_freq(window)}
