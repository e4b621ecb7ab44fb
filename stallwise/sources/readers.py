"""Readers with explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise import schemas


def read_cards(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON arrays of listing cards: one array per file, or one per line."""
    return spark.read.schema(schemas.CARD).option("multiLine", multi_line).json(path)


def read_run_meta(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run records with ISO times; the finish may be missing.  ``multi_line``: one indented object per (small) file.

    Counts are read under the names ``page_count`` / ``app_count`` or, as crawls write them, ``pages_scraped`` / ``total_cards``.
    """
    names = "run_id string, started_at string, finished_at string, page_count bigint, app_count bigint, pages_scraped bigint, total_cards bigint, note string"
    raw = spark.read.schema(names).option("multiLine", multi_line).json(path)
    iso = lambda c: F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
    return raw.select("run_id", iso(F.col("started_at")).alias("started_at"), iso(F.col("finished_at")).alias("finished_at"),
                      F.coalesce("page_count", "pages_scraped").alias("page_count"), F.coalesce("app_count", "total_cards").alias("app_count"), "note",
                      F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"))


def discover_runs(spark: SparkSession, root: str, marker: str = "run.json") -> DataFrame:
    """Run folders ``root/<day>/<run>/`` that hold the (small) marker file, with the newest flagged."""
    files = spark.read.text(f"{root}/*/*/{marker}").select(F.col("_metadata.file_path").alias("path"))
    parts = F.split("path", "/")
    runs = files.select(F.element_at(parts, -3).alias("day"), F.element_at(parts, -2).alias("run")).distinct()
    newest = runs.agg(F.max(F.struct("day", "run")).alias("m")).scalar()
    return runs.withColumn("is_latest", F.struct("day", "run") == newest)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _number(c: Column, kind: str) -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))


def read_videos_tsv(spark: SparkSession, path: str, url_base: str) -> DataFrame:
    """Five tab-separated fields; shorter lines go, missing or bad numbers become 0."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.trim("value") != "").filter(F.size(p) >= 5)
    return rows.select(
        p[0].alias("title"), p[1].alias("id"), _number(p[2], "bigint").alias("views"),
        _number(p[3], "double").cast("bigint").alias("duration_s"), p[4].alias("upload_date"), F.concat(F.lit(url_base), p[1]).alias("url"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    url = F.trim("value").alias("url")
    return spark.read.text(path).select(url).filter(F.col("url").startswith("http"))


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.EXPORT_ITEM) -> DataFrame:
    return spark.read.schema(schema).json(path).dropna(how="all")


def read_listing_pages(spark: SparkSession, path: str, kind: str = "t3") -> DataFrame:
    """API pages of ``{data: {children: [{kind, data}]}}``, unfolded; absent counts and texts get defaults."""
    child = spark.read.schema(schemas.LISTING_PAGE).json(path).select(F.explode("data.children").alias("c")).filter(F.col("c.kind") == kind)
    d = lambda f: F.col(f"c.data.{f}")
    text = lambda f: F.coalesce(d(f), F.lit("")).alias(f)
    count = lambda f: F.coalesce(d(f), F.lit(0)).cast("bigint").alias(f)
    return child.select(d("id").alias("id"), text("community"), text("title"), text("selftext"), F.coalesce(d("author"), F.lit("[deleted]")).alias("author"),
                        count("score"), count("num_comments"))


def read_partner_profiles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schemas.PARTNER_PROFILE).option("multiLine", multi_line).json(path)
