"""Keeping tables current: dedupe, merge, upsert, replace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from stallwise.functions.columns import app_key


def first_rows(df: DataFrame, keys: Sequence[Column], position: Column) -> DataFrame:
    """One whole row per key, the earliest by position; combined map-side."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(F.struct(*df.columns), position).alias("_row")).select("_row.*")


def stage_dedupe(cards: DataFrame, position: str = "file_pos") -> DataFrame:
    """Cards with a version and a name, one per (version, tech_name): the first in the file."""
    valid = cards.filter(F.col("version").isNotNull() & F.col("tech_name").isNotNull())
    return first_rows(valid, [F.col("version"), F.col("tech_name")], F.col(position))


def replace_run(existing: DataFrame, incoming: DataFrame, run_id: str) -> DataFrame:
    return existing.filter(F.col("run_id") != run_id).unionByName(incoming)


def merge_apps(existing: DataFrame, cards: DataFrame, started_at: Column) -> DataFrame:
    """New listings start at the run; known ones keep first_seen and take the run as last_seen."""
    cols = ["app_key", "tech_name", "version"]
    old = existing.select(*cols, "first_seen", "last_seen", F.lit(False).alias("_new"))
    new = cards.select(*cols, started_at.alias("first_seen"), started_at.alias("last_seen"), F.lit(True).alias("_new"))
    return old.unionByName(new).groupBy("app_key").agg(
        F.min_by("tech_name", "_new").alias("tech_name"), F.min_by("version", "_new").alias("version"),
        F.min_by("first_seen", "_new").alias("first_seen"), F.max_by("last_seen", "_new").alias("last_seen"))


def surrogate_ids(existing_max: Column, rows: DataFrame, key: str, out: str = "snapshot_id") -> DataFrame:
    """Dense new ids after ``existing_max``.

    Rows fall into 4096 even buckets by a digest of the key; bucket totals give
    each bucket its first id, so no window spans the table.
    """
    b = rows.withColumn("_b", F.substring(F.md5(F.col(key)), 1, 3))
    upto = W.partitionBy(F.lit(0)).orderBy("_b2").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = b.groupBy(F.col("_b").alias("_b2")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.sum("_n").over(upto) - F.col("_n"))
    numbered = b.join(starts, F.col("_b") == F.col("_b2"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(key))
    return numbered.withColumn(out, F.coalesce(existing_max, F.lit(0)) + F.col("_start") + rank).drop("_b", "_b2", "_n", "_start")


def widen(spark: SparkSession, df: DataFrame | None, ddl: str) -> DataFrame:
    """The table in its current schema: an empty one if missing, 32-bit columns widened."""
    empty = spark.createDataFrame([], ddl)
    if df is None:
        return empty
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def info(runs: DataFrame, apps: DataFrame, snapshots: DataFrame) -> DataFrame:
    one = lambda name, df: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("metric"), "value")
    latest = snapshots.agg(F.date_format(F.max("captured_at"), "yyyy-MM-dd").alias("value")).select(F.lit("latest").alias("metric"), "value")
    return one("runs", runs).unionByName(one("apps", apps)).unionByName(one("snapshots", snapshots)).unionByName(latest)


POST_UPDATES = ("score", "num_comments", "last_seen", "signals")


def one_per_post(pulled: DataFrame) -> DataFrame:
    """One row per id: fixed columns from the earliest copy by ``last_seen``, changing ones from the latest.

    Copies of one time are settled by value, so the order of rows changes nothing; combined map-side.
    """
    at = lambda c: F.struct("last_seen", c)
    picked = [(F.max_by(c, at(c)) if c in POST_UPDATES else F.min_by(c, at(c))).alias(c) for c in pulled.columns if c != "id"]
    return pulled.groupBy("id").agg(*picked).select(pulled.columns)


def upsert_posts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known posts take only the changing columns from the newest copy; ``change`` says what happened.

    Both sides may hold an id any number of times: each is reduced to one row before they meet.
    """
    e, i = one_per_post(existing).alias("e"), one_per_post(incoming).alias("i")
    both = e.join(i, F.col("e.id") == F.col("i.id"), "full_outer")
    pick = lambda c: F.coalesce(f"i.{c}", f"e.{c}") if c in POST_UPDATES else F.coalesce(f"e.{c}", f"i.{c}")
    change = F.when(F.col("e.id").isNull(), "new").when(F.col("i.id").isNotNull(), "updated").otherwise("kept")
    return both.select(*[pick(c).alias(c) for c in existing.columns], change.alias("change"))


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "updated").alias("updated"))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def to_snapshots(cards: DataFrame, run_id: str, captured_at: Column) -> DataFrame:
    """Fact rows of one run from deduplicated cards."""
    return stage_dedupe(cards).select(F.lit(run_id).alias("run_id"), app_key().alias("app_key"), captured_at.alias("captured_at"), "*")
