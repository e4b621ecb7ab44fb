"""Sinks; each writes a DataFrame from its executors and returns nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import columns as C


def write_partitioned(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Append the named fields only; every part file carries the header."""
    df.select(*fields).write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_card_pages(cards: DataFrame, path: str, page: str) -> None:
    """One JSON array of cards per line and page; a page is a bounded group by construction of ``page``."""
    fields = [c for c in cards.columns if c != page]
    rows = cards.groupBy(page).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("value"))
    rows.select("value").write.mode("overwrite").text(path)


def write_run_meta(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").json(path)


def rank_export(df: DataFrame) -> DataFrame:
    """Fixed-format rows of a score list."""
    return df.select("rank", "app_key", F.format_number("trend_score", 2).alias("trend"), F.format_number("opportunity_score", 2).alias("opportunity"),
                     C.fmt_price().alias("price"), C.fmt_int(C.zero("total_purchases")).alias("sales"))


def outreach_rows(ranked: DataFrame, breakdown: Sequence[str]) -> DataFrame:
    """Outreach list: defaults for missing contacts, three industries, the breakdown as JSON."""
    or_na = lambda c: F.coalesce(c, F.lit("N/A"))
    return ranked.select(
        "rank", F.coalesce("name", F.lit("Unknown")).alias("partner"), or_na("country").alias("location"), or_na("email").alias("email"),
        or_na("phone").alias("phone"), or_na("website").alias("website"), F.array_join(F.slice("industries", 1, 3), "; ").alias("industries"),
        or_na("grade").alias("certification"), F.col("fit").cast("string").alias("score"), F.to_json(F.struct(*breakdown)).alias("breakdown"))


def contact_rows(partners: DataFrame) -> DataFrame:
    return partners.select("partner_id", "name", "email", "phone", "website", F.to_json("industries").alias("industries"),
                           F.to_json(F.slice("clients", 1, 3)).alias("clients"))


def write_refs(refs: DataFrame, flat_path: str, nested_path: str, pages: Column) -> None:
    """References as flat CSV and as JSON, nested in bounded pages of a partner's references."""
    refs.write.mode("overwrite").option("header", True).csv(flat_path)
    nested = refs.groupBy("partner_id", pages.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("client_name", "client_industry"))).alias("references"))
    nested.write.mode("overwrite").json(nested_path)


def write_url_list(urls: DataFrame, path: str) -> None:
    """Distinct URLs as text, globally sorted across part files."""
    urls.distinct().orderBy("url").write.mode("overwrite").text(path)


def report_rows(sections: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Ordered sections of already ranked results as (section, rank, text) rows."""
    parts = [df.select(F.lit(name).alias("section"), F.col("rank").cast("int").alias("rank"),
                       F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols]).alias("text")) for name, df, cols in sections]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
