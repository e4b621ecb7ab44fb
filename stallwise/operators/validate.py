"""Viability of an idea or a listing: sub-scores, verdicts and planning numbers.

Ideas come as a small keyword table, so any number of them is validated in one
scan of the listings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import columns as C, match as M
from stallwise.functions.columns import rnd, safe_div, zero
from stallwise.functions.match import Niche
from stallwise.operators.market import total

# Words of buyers with a legal deadline.
DEADLINE_WORDS = ["e-slog", "eslog", "peppol", "zatca", "irn", "eway bill", "ewaybill", "gst 2.0", "e-invoice mandate", "ksef", "mydata"]
# Words of buyers leaving another product.
MIGRATION_WORDS = ["quickbooks", "qbo", "tally", "sage", "myob", "dynamics gp", "dynamics nav", "netsuite", "wave accounting", "datev", "busy accounting"]
# Migration products and the demand score that stands in for their listings (50 where none is known).
MIGRATORS = {"quickbooks": 90, "qbo": 90, "tally": 80, "sage": 65, "myob": 65, "xero": 70, "dynamics": 75, "netsuite": 75,
             "wave accounting": 50, "zoho books": 60, "busy accounting": 70, "datev": 85}
# Words of regulated fields, high risk then medium.
HIGH_RISK = ["health", "pharma", "hospital", "patient", "clinic", "medical", "bank", "banking", "insurance", "kyc", "aml", "gdpr", "hipaa", "crypto", "legal", "court", "drug"]
MEDIUM_RISK = ["payroll", "hr", "employee", "invoice", "accounting", "gst", "vat", "einvoice", "tax", "compliance", "finance", "nbfc", "loan"]
# Effort classes in order: words, effort of 5, class, weeks.
EFFORT = [
    (["tally", "busy", "quickbooks", "xero", "sage", "zoho", "myob", "wave", "netsuite", "dynamics", "sap migration"], 2, "migration", "2-3"),
    (["shopify", "woocommerce", "amazon", "ebay", "magento", "flipkart", "meesho"], 3, "shop connector", "3-4"),
    (["whatsapp", "telegram", "sms", "twilio", "ivr", "telephony"], 3, "messaging", "2-3"),
    (["gst", "einvoice", "eway", "vat", "tax", "compliance", "kyc"], 3, "compliance", "3-4"),
    (["hospital", "clinic", "patient", "pharma", "lims", "fhir"], 4, "health", "4-6"),
    (["dashboard", "report", "analytics", "kpi", "chart", "pivot"], 1, "reporting", "1-2"),
    (["barcode", "qr", "label", "print"], 1, "printing", "1-2"),
    (["payroll", "salary", "leave", "attendance", "biometric"], 3, "payroll", "3-4"),
]
EFFORT_DEFAULT = (2, "standard", "2-3")
# Fields the platform owner covers itself.
OWNED = {"subscription": "subscriptions", "recurring": "subscriptions", "esign": "signatures", "e-sign": "signatures", "expense": "expenses",
         "elearning": "elearning", "field service": "field service", "helpdesk": "helpdesk", "repair": "repairs",
         "timesheet": "timesheets", "appraisal": "appraisals"}


@dataclass(frozen=True)
class Words:
    """Word lists the sub-scores look for; a catalog in another field brings its own."""

    deadline: Sequence[str] = tuple(DEADLINE_WORDS)
    migration: Sequence[str] = tuple(MIGRATION_WORDS)
    migrators: Mapping[str, int] = field(default_factory=lambda: MIGRATORS)


def has_any(text: Column, words: Sequence[str]) -> Column:
    return M.any_of(text.contains(w) for w in words)


def _ladder(steps: Sequence[tuple[Column, int]], default: int) -> Column:
    out = None
    for test, value in steps:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def _whole(x: Column) -> Column:
    """Cut the fraction off a non-negative double."""
    return F.floor(x).cast("int")


def sub_scores(df: DataFrame, text: Column, words: Words = Words()) -> DataFrame:
    """sat, demand, dead_health, momentum, forced_buyer, rating_score and viability.

    Needs n, total, velocity, dead, active and avg_rating; ``text`` is lower case.
    """
    n, act = F.col("n"), F.greatest(F.col("active"), F.lit(1))
    dead_pct = F.coalesce(safe_div(F.col("dead"), n), F.lit(0.0))
    avg, vel = safe_div(F.col("total"), act), safe_div(F.col("velocity"), act)
    migrator = has_any(text, list(words.migrators))
    proxy = F.greatest(*[F.when(text.contains(w), F.lit(v)).otherwise(F.lit(0)) for w, v in words.migrators.items()], F.lit(0))
    sat = _ladder([(n == 0, 50), (n <= 3, 90), (n <= 8, 75), (n <= 20, 55), (n <= 50, 35)], 15)
    sat = F.when((dead_pct >= 0.80) & (n > 3), F.least(sat, F.lit(35))).otherwise(sat)
    demand = F.when(migrator, proxy).otherwise(_ladder([(avg > 500, 90), (avg > 200, 75), (avg > 80, 60), (avg > 20, 40), (avg > 5, 25)], 10))
    bonus = F.least(F.lit(20), _whole(safe_div(F.col("velocity"), F.greatest(F.col("total"), F.lit(1))) * 200.0))
    pace = F.when(migrator, F.lit(70)).otherwise(_ladder([(vel > 10, 90), (vel > 5, 80), (vel > 2, 65), (vel > 0.5, 45), (vel > 0.1, 25)], 10))
    health = _ladder([(n <= 3, 50), (dead_pct <= 0.40, 85), (dead_pct <= 0.55, 65), (dead_pct <= 0.70, 45), (dead_pct <= 0.85, 25)], 10)
    forced = F.when(has_any(text, words.deadline), F.lit(90)).when(has_any(text, words.migration), F.lit(70)).otherwise(F.lit(10))
    rating = F.when(F.col("avg_rating") > 0, _whole(F.col("avg_rating") / 5.0 * 100.0)).otherwise(F.lit(50))
    out = df.select("*", dead_pct.alias("dead_pct"), migrator.alias("is_migrator"), vel.alias("velocity_per_app"), sat.alias("sat"),
                    demand.alias("demand"), health.alias("dead_health"), F.least(F.lit(90), pace + bonus).alias("momentum"),
                    forced.alias("forced_buyer"), rating.alias("rating_score"))
    return out.withColumn("viability", viability(WEIGHTS).cast("int"))


# Weights of the current and of the earlier formula, in adding order.
WEIGHTS = {"sat": 0.10, "demand": 0.20, "dead_health": 0.12, "momentum": 0.28, "forced_buyer": 0.13, "rating_score": 0.17}
EARLIER_WEIGHTS = {"sat": 0.10, "demand": 0.14, "gap": 0.04, "dead_health": 0.10, "moat": 0.12, "momentum": 0.22, "forced_buyer": 0.13, "rating_score": 0.15}


def weighted(weights: Mapping[str, float]) -> Column:
    """Weighted sum, added left to right."""
    out = None
    for name, w in weights.items():
        term = F.col(name).cast("double") * F.lit(w)
        out = term if out is None else out + term
    return out


def viability(weights: Mapping[str, float]) -> Column:
    return F.floor(weighted(weights))


def gap_moat(df: DataFrame) -> DataFrame:
    """The two sub-scores of the earlier formula; needs paid, low, stale and top_share."""
    paid, low, share = F.col("paid"), F.col("low"), F.col("top_share")
    gap = _ladder([(paid == 0, 50), (low == 0, 80), (low <= 3, 60), (low <= 8, 40)], 20)
    moat = _ladder([(share > 60, 20), (share > 40, 45), (share > 20, 65)], 85)
    stale_half = (F.col("stale") >= 2) & (paid > 0) & (safe_div(F.col("stale"), paid) >= 0.5)
    return df.select("*", gap.alias("gap"), F.when(stale_half, F.least(F.lit(95), moat + 15)).otherwise(moat).alias("moat"))


def idea_metrics(listings: DataFrame, ideas: Sequence[Niche], fields: Sequence[str] = ("display_name",), min_purchases: int = 0) -> DataFrame:
    """Market facts per idea; publishers are combined before ideas, so a hot idea stays spread out."""
    hits = M.fan_out(listings.filter(zero("total_purchases") >= min_purchases), ideas, fields)
    t, lm, paid = zero("total_purchases"), zero("last_month_purchases"), C.paid()
    stale = paid & (t > 50) & (lm == 0)
    per_author = hits.groupBy("label", "author").agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).alias("total"), F.sum(lm).alias("velocity"), F.count_if(t == 0).alias("dead"),
        F.count_if(lm > 0).alias("active"), F.count_if(paid).alias("paid"), F.count_if(paid & (F.col("price_cents") <= 3000)).alias("low"),
        total(F.when(paid, F.col("price_cents"))).alias("cents"), total(F.when(paid, t)).alias("paid_total"),
        total(F.when(paid, lm)).alias("paid_velocity"), F.count_if(stale).alias("stale"), total(F.when(stale, t)).alias("stranded"),
        F.sum(F.coalesce("rating_stars", F.lit(0.0))).alias("stars"))
    names = [c for c in per_author.columns if c not in ("label", "author")]
    agg = per_author.groupBy("label").agg(*[F.sum(c).alias(c) for c in names], F.max(F.when(F.col("author").isNotNull(), F.col("total"))).alias("_top"))
    text = M.to_frame(listings.sparkSession, [Niche(i.label, i.keywords, {"idea": ", ".join(i.keywords).lower()}) for i in ideas], idea="string").drop("pos")
    return agg.join(text, "label").select(
        "label", "idea", "n", "total", "velocity", "dead", "active", "paid", "low", "paid_total", "paid_velocity", "stale", "stranded",
        F.coalesce(safe_div(F.col("cents"), F.col("paid")) / 100.0, F.lit(0.0)).alias("avg_price"),
        F.coalesce(safe_div(zero("_top") * 100.0, F.col("total")), F.lit(0.0)).alias("top_share"),
        safe_div(F.col("stars"), F.col("n")).alias("avg_rating"),
        rnd(safe_div(F.col("velocity"), F.greatest(F.col("total"), F.lit(1))) * 100.0, 1).alias("recency_pct"))


def verdict(v: Column) -> Column:
    return F.when(v >= 52, "LAUNCH CANDIDATE").when(v >= 47, "CONSIDER").when(v >= 42, "INVESTIGATE").otherwise("SCREEN OUT")


def success_probability(v: Column, coef: float = 0.1515, intercept: float = -8.519) -> Column:
    """Percent chance of success at a viability; the fitted coefficients are fixed values."""
    return rnd(F.lit(100.0) / (F.lit(1.0) + F.exp(-(F.lit(coef) * v + F.lit(intercept)))), 1)


def sizing(df: DataFrame) -> DataFrame:
    monthly = F.floor(F.col("paid_velocity") * F.col("avg_price"))
    return df.select("*", F.floor(F.col("paid_total") * F.col("avg_price")).alias("sam"), monthly.alias("monthly_revenue"),
                     F.floor(monthly * 12 * 0.05).alias("som_year1"))


def regulatory_risk(text: Column, high: Sequence[str] = HIGH_RISK, medium: Sequence[str] = MEDIUM_RISK) -> Column:
    return F.when(has_any(text, high), "HIGH").when(has_any(text, medium), "MEDIUM").otherwise("LOW")


def effort(text: Column, classes: Sequence[tuple] = EFFORT) -> Column:
    """(effort of 5, class, weeks) by the first class with a matching word."""
    pack = lambda e, c, w: F.struct(F.lit(e).alias("effort"), F.lit(c).alias("kind"), F.lit(w).alias("weeks"))
    out = None
    for words, e, c, w in classes:
        out = F.when(has_any(text, words), pack(e, c, w)) if out is None else out.when(has_any(text, words), pack(e, c, w))
    return out.otherwise(pack(*EFFORT_DEFAULT))


def owned(text: Column, modules: Mapping[str, str] = OWNED) -> Column:
    return F.coalesce(*[F.when(text.contains(k), F.lit(v)) for k, v in modules.items()])


def go_to_market(avg: Column) -> Column:
    """Channel and price corridor by the average paid price."""
    pack = lambda ch, lo, hi: F.struct(F.lit(ch).alias("channel"), lo.cast("int").alias("low"), hi.cast("int").alias("high"))
    part = lambda f: F.floor(avg * f)
    return (F.when(avg > 100, pack("partner outreach", F.greatest(F.lit(49), part(0.6)), part(0.8)))
            .when(avg > 30, pack("marketplace and forum", F.greatest(F.lit(15), part(0.5)), part(0.75)))
            .otherwise(pack("free then paid", F.lit(15), F.lit(25))))


def pivots() -> Column:
    """Up to four of ten named moves; needs metrics and sub-scores."""
    c = F.col
    found = F.array_compact(F.array(
        F.when(c("momentum") >= 80, "Hot Right Now").when(c("momentum") <= 25, "Cold Market"),
        F.when(c("n") > 60, "Niche Down"), F.when((c("low") == 0) & (c("paid") > 0), "Price Wedge"),
        F.when(c("top_share") > 50, "UX Flanking"), F.when((c("demand") < 30) & (c("n") > 5), "Validate Demand First"),
        F.when(c("dead_pct") > 0.6, "Quality Gap"), F.when((c("n") <= 3) & (c("momentum") < 30), "Blue Ocean"),
        F.when(c("stale") >= 2, "Attack Window"), F.when(c("forced_buyer") >= 70, "Forced Buyer Market")))
    return F.when(F.size(found) == 0, F.array(F.lit("Green Light"))).otherwise(F.slice(found, 1, 4))


ACTIONS = {
    "build": ["read competitor reviews", "set launch price", "build the core", "publish and announce", "sell toward the first-year goal"],
    "probe": ["ask about the problem", "ask implementers", "check how old the leader is", "build a small version if confirmed", "reassess after outreach"],
    "stop": ["do not build", "scan for uncovered needs", "consider a migration product", "find paying customers first", "rescore with better words"],
}


def actions(v: Column) -> Column:
    """Five next steps by viability band."""
    steps = {k: F.array(*[F.lit(s) for s in v_]) for k, v_ in ACTIONS.items()}
    return F.when(v >= 47, steps["build"]).when(v >= 42, steps["probe"]).otherwise(steps["stop"])


def break_even(df: DataFrame, effort_points: Column, rate: float = 15.0) -> DataFrame:
    """Cost, sales and days until a build pays for itself; needs avg_price, velocity, top_share and n."""
    price = F.when(F.col("avg_price") > 0, F.greatest(F.lit(19), F.floor(F.col("avg_price") * 0.6))).otherwise(F.lit(29))
    base = df.select("*", price.alias("launch_price"), (effort_points * 30 * F.lit(rate)).alias("build_cost"))
    share = F.when((F.col("top_share") > 50) | (F.col("n") > 30), 0.02).when(F.col("n") <= 10, 0.08).otherwise(0.05)
    need = safe_div(F.col("build_cost"), F.col("launch_price"))
    days = lambda s: rnd(need / F.greatest(F.lit(1.0), F.col("velocity") * s) * 30.0, 1)
    return base.select("*", rnd(need, 1).alias("sales_needed"), share.alias("capture"), days(share).alias("days"), days(F.lit(0.01)).alias("days_worst"))
