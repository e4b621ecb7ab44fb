"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model may learn from: crc32 of the id as text is divisible by five.

    A null id counts as text ``null``, so that it has a fold, too.
    """
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int, seed: int = 11) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled rows outside the held-out fold, with texts of at most ``max_chars``, for fitting.

    The rows are the first in the order of a hash of the id, so the sample doesn't
    depend on partitions; an id with several equal labels counts once, one with
    contradicting labels not at all.
    """
    marks = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).filter("y = y2").select("doc_id", "y"))
    sizes = docs.select("doc_id", F.length(text_of()).alias("n")).filter(F.col("n") <= max_chars)
    picked = sample_ids(sizes.join(marks, "doc_id").select("doc_id", "y"), max_rows, seed)
    rows = texts_of(docs, picked).filter(F.length("text") <= max_chars)
    return [(r["text"], int(r["y"])) for r in rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "text").limit(max_rows).select("text", "y").collect()]


def sample_ids(ids: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """The first ``max_rows`` distinct rows of ``ids`` in the order of a hash of ``doc_id``; no text takes part."""
    return ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), *ids.columns).limit(max_rows)


def texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The texts of a sample whose number of ids is a parameter: that bound makes the broadcast safe, and no text is shuffled."""
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")


def free_name(columns: list[str], base: str) -> str:
    """``base``, with underscores in front until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
