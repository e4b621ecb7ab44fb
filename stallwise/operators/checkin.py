"""Verdicts on a listing's first weeks, one per check-in row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from stallwise.functions.columns import safe_div, zero


def _first(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules], F.lit(default))


def _per_install(c: str) -> Column:
    return F.coalesce(safe_div(F.col(c), F.col("installs_total")), F.lit(0.0))


def velocity_ratio() -> Column:
    """Installs of weeks 7-8 over those of weeks 1-2, where none counts as one."""
    first = zero("installs_weeks_1_2")
    return safe_div(F.col("installs_weeks_7_8"), F.when(first == 0, F.lit(1)).otherwise(first))


def week_2() -> Column:
    n, seen = F.col("installs_total"), F.col("listing_visitors")
    return _first([((n == 0) & (seen >= 200), "LISTING CRISIS"), ((n == 0) & (seen < 50), "DISTRIBUTION CRISIS"), (n.between(1, 2), "SLOW START"),
                   (n.between(3, 7), "HEALTHY START"), (n >= 8, "STRONG LAUNCH")], "REVIEW MANUALLY")


def week_4() -> Column:
    refunds, reviews = _per_install("refunds_total"), _per_install("reviews_count")
    return _first([(refunds > 0.20, "QUALITY CRISIS"), ((F.col("reviews_count") == 0) & (F.col("installs_total") >= 5), "ENGAGEMENT CRISIS"),
                   (F.col("bug_reviews") >= 2, "UNDER-SPECCED V1"), ((refunds > 0) & (reviews < 0.05), "SILENT QUITTERS")], "STABLE")


def week_8() -> Column:
    r, late = velocity_ratio(), F.col("installs_weeks_7_8")
    return _first([(r >= 1.5, "GROWING"), (r >= 0.8, "FLAT"), (late > 0, "DECLINING"), (late == 0, "STALL")], "REVIEW MANUALLY")


def week_12() -> Column:
    rev, trend = F.col("revenue"), F.lower(F.coalesce("trend", F.lit("")))
    light = (F.col("hours") <= 12) & (F.col("motivation") >= 5)
    heavy = (F.col("hours") > 20) | (F.col("motivation") <= 4)
    grows, flat = trend == "growing", trend == "flat"
    return _first([((rev > 300) & grows & light, "CONTINUE"), (rev.between(100, 300) & grows & light, "CONTINUE + PLAN APP #2"),
                   (rev.between(100, 300) & flat & light, "MAINTAIN MODE"), ((rev < 100) & grows & light, "ONE MORE MONTH"),
                   ((rev < 100) & (flat | heavy), "KILL"), (trend == "declining", "KILL OR PIVOT")], "REVIEW MANUALLY")


def verdict(week: str = "week") -> Column:
    w = F.col(week)
    return F.when(w == 2, week_2()).when(w == 4, week_4()).when(w == 8, week_8()).when(w == 12, week_12())
