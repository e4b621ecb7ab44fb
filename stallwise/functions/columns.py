"""Derived columns: money, buckets, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def rnd(x: Column, places: int = 0) -> Column:
    """Round half up on the double value, the same in every engine (values are non-negative)."""
    scale = 10.0 ** places
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def zero(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0))


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def app_key(version: str = "version", tech: str = "tech_name") -> Column:
    return F.concat_ws("/", F.col(version), F.col(tech))


def price_usd(cents: str = "price_cents", places: int = 2) -> Column:
    return rnd(F.col(cents) / F.lit(100.0), places)


def velocity_pct(null_when_unsold: bool = False) -> Column:
    total, last = F.col("total_purchases"), zero("last_month_purchases")
    pct = rnd(last * F.lit(100.0) / F.nullif(zero(total), F.lit(0)), 1)
    return pct if null_when_unsold else F.coalesce(pct, F.lit(0.0))


def gross(units: str = "total_purchases") -> Column:
    return zero("price_cents") * zero(units) / F.lit(100.0)


def paid() -> Column:
    return F.coalesce(F.col("price_cents") > 0, F.lit(False))


def dead() -> Column:
    return zero("total_purchases") == 0


def active() -> Column:
    return zero("last_month_purchases") > 0


def stale_flag() -> Column:
    return (zero("total_purchases") > 50) & (zero("last_month_purchases") == 0)


# Price tiers as (upper bound in cents, exclusive except for 0, label).
PRICE_TIERS = [
    (0, "Free"), (1000, "$1-9"), (2000, "$10-19"), (3000, "$20-29"), (5000, "$30-49"),
    (10000, "$50-99"), (20000, "$100-199"), (50000, "$200-499"),
]
PRICE_TIER_TOP = "$500+"
# Right-closed price bins in dollars.
PRICE_BINS = [0, 10, 20, 30, 50, 100, 200, 500, 99999]
PRICE_BIN_LABELS = ["$1-10", "$11-20", "$21-30", "$31-50", "$51-100", "$101-200", "$201-500", "$500+"]


def price_tier(unknown: str | None = None) -> Column:
    """Price label; without ``unknown`` an unpriced row lands in the top tier."""
    cents = F.col("price_cents")
    out = F.when(cents.isNull() | (cents < 0), F.lit(unknown)) if unknown else None
    for bound, label in PRICE_TIERS:
        test = cents == 0 if bound == 0 else cents < bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(PRICE_TIER_TOP)


def price_bin(bins: Sequence[float] = PRICE_BINS, labels: Sequence[str] = PRICE_BIN_LABELS) -> Column:
    usd = F.col("price_cents") / F.lit(100.0)
    out = None
    for lo, hi, label in zip(bins, bins[1:], labels):
        test = (usd > float(lo)) & (usd <= float(hi))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def velocity_bucket() -> Column:
    v = zero("last_month_purchases")
    return F.when(v == 0, "0").when(v == 1, "1").when(v <= 5, "2-5").when(v <= 20, "6-20").otherwise(">20")


VELOCITY_BUCKETS = ["0", "1", "2-5", "6-20", ">20"]


def lifetime_bucket() -> Column:
    v = zero("total_purchases")
    return (F.when(v == 0, "0").when(v < 10, "1-9").when(v < 50, "10-49").when(v < 200, "50-199")
            .when(v < 1000, "200-999").otherwise("1000+"))


LIFETIME_BUCKETS = ["0", "1-9", "10-49", "50-199", "200-999", "1000+"]


def momentum_pct() -> Column:
    return F.coalesce(safe_div(zero("last_month_purchases") * F.lit(100.0), zero("total_purchases")), F.lit(0.0))


def badges() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("version") != "", F.concat(F.lit("v"), F.col("version"))),
        F.lit("B2B"),
        F.when(paid(), F.lit("Paid")).otherwise(F.lit("Free")),
        F.when(F.col("rating_stars") >= 4.5, F.lit("Top-rated")),
        F.when(momentum_pct() >= 5, F.lit("Accelerating")),
    ))


def engagement() -> Column:
    return zero("score") + 2 * zero("num_comments")


def md_link(title: str = "title", permalink: str = "permalink", base: str = "") -> Column:
    text = F.substring(F.trim(F.replace(F.translate(F.col(title), "[]", "()"), F.lit("\n"), F.lit(" "))), 1, 120)
    return F.concat(F.lit("["), text, F.lit("]("), F.lit(base), F.col(permalink), F.lit(")"))


def safe_trunc(c: str, length: int) -> Column:
    return F.substring(F.coalesce(F.col(c), F.lit("")), 1, length)


def fmt_int(c: Column) -> Column:
    return F.format_number(c.cast("bigint"), 0)


def fmt_price(cents: str = "price_cents") -> Column:
    """``Free`` for 0 or unknown, else whole dollars."""
    return F.when(zero(cents) == 0, F.lit("Free")).otherwise(
        F.concat(F.lit("$"), F.format_number(rnd(F.col(cents) / F.lit(100.0)).cast("bigint"), 0)))


def fmt_pct(x: Column) -> Column:
    return F.concat(rnd(x).cast("bigint").cast("string"), F.lit("%"))
