"""Partner directory: fit scores, filters, breakdowns and client references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import match as M
from stallwise.functions.columns import rnd, safe_div
from stallwise.operators.maintain import first_rows
from stallwise.operators.market import desc, rank_within, top

# Words of partners that move clients between systems.
FIT_WORDS = ["quickbooks", "qb", "accounting software", "erp migration", "migration", "accounting", "finance", "bookkeeping", "small business", "smb", "implementation"]
FIT_WORDS_SHORT = ["quickbooks", "qb", "migration", "accounting", "erp"]
# Industries ready to move.
READY_INDUSTRIES = ["accounting", "bookkeeping", "finance", "professional services", "consulting", "manufacturing", "distribution", "wholesale", "trading", "import/export"]
# Certification levels and score bands.
LEVELS = {"Gold": 3, "Silver": 2, "Bronze": 1}
BANDS = [(90, "90-100"), (70, "70-89"), (50, "50-69"), (30, "30-49"), (0, "0-29")]
GRADES = ["Gold", "Silver", "Ready", "Unknown"]


def profile_text(clients: bool = True) -> Column:
    parts = ["name", "description", F.array_join("industries", " ")] + ([F.array_join("clients", " ")] if clients else [])
    return F.lower(F.concat_ws(" ", *parts))


def edge_hits(refs: DataFrame, words: Sequence[str], text: str = "client_name") -> DataFrame:
    """``_partner`` and a flag ``_e0``, ``_e1``, ... for each word that any of its references holds.

    Flags are taken edge by edge and combined by ``max`` before the shuffle, so no list of references is ever built.
    """
    hit = lambda w: F.max(F.coalesce(F.lower(text).contains(w.lower()), F.lit(False)))
    return refs.groupBy(F.col("partner_id").alias("_partner")).agg(*[hit(w).alias(f"_e{i}") for i, w in enumerate(words)])


def with_hits(partners: DataFrame, words: Sequence[str], refs: DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """``partners`` and one condition per word: found in the profile's text or, if ``refs`` is given, in a reference.

    A word is looked for inside one text; without ``refs`` the column ``clients`` is part of the profile.
    """
    if refs is None:
        return partners.withColumn("_text", profile_text()), [F.col("_text").contains(w.lower()) for w in words]
    met = partners.withColumn("_text", profile_text(clients=False)).join(edge_hits(refs, words), F.col("partner_id") == F.col("_partner"), "left")
    return met, [F.col("_text").contains(w.lower()) | F.coalesce(F.col(f"_e{i}"), F.lit(False)) for i, w in enumerate(words)]


def first_clients(refs: DataFrame, k: int = 3) -> DataFrame:
    """``_partner``, its first ``k`` client names and the number of all; ranks above ``k`` go before the shuffle."""
    names = refs.select("partner_id", "client_name").distinct()
    best = rank_within(names, ["partner_id"], [F.col("client_name")], k, "_r")
    some = best.groupBy(F.col("partner_id").alias("_partner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "client_name"))), lambda c: c["client_name"]).alias("clients"))
    counts = names.groupBy(F.col("partner_id").alias("_q")).agg(F.count("*").alias("n_clients"))
    return some.join(counts, F.col("_partner") == F.col("_q")).drop("_q")


def level(certification: str = "grade") -> Column:
    """Level of the first word of a certification such as ``Gold Partner``."""
    word = F.regexp_extract(F.coalesce(F.col(certification), F.lit("")), "^(Gold|Silver|Bronze)", 1)
    return F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in LEVELS.items()], F.lit(0))


def employees_mid(c: str = "employees") -> Column:
    part = lambda i: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"^\s*(\d+)\s*-\s*(\d+)\s*$", i).try_cast("int")
    return (part(1) + part(2)) / 2.0


def score_fit(partners: DataFrame, words: Sequence[str] = FIT_WORDS, ready: Sequence[str] = READY_INDUSTRIES, refs: DataFrame | None = None) -> DataFrame:
    """Fit 0-100 and its five parts; references come as ``refs`` (partner_id, client_name) or in a column ``clients``."""
    has = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 5).otherwise(0)
    base, found = with_hits(partners, words, refs)
    hits = sum((F.when(f, 1).otherwise(0) for f in found), F.lit(0))
    matching = F.size(F.filter("industries", lambda i: M.any_of(F.lower(i).contains(r) for r in ready)))
    mid = employees_mid()
    size = F.when(mid.between(20, 200), 15).when(mid.between(10, 500), 10).otherwise(0)
    scored = base.select(
        *partners.columns, F.least(F.lit(30), hits * 5).alias("keyword_match"), F.least(F.lit(20), matching * 5).alias("industry_match"),
        (level() * 10).alias("certification_points"), size.alias("employee_count"), (has("email") + has("phone") + has("website")).alias("contact_quality"))
    parts = sum((F.col(c) for c in PARTS), F.lit(0))
    return scored.withColumn("fit", F.least(F.lit(100), parts))


PARTS = ["keyword_match", "industry_match", "certification_points", "employee_count", "contact_quality"]


def top_partners(scored: DataFrame, min_score: int = 60, n: int = 50) -> DataFrame:
    return top(scored.filter(F.col("fit") >= min_score), [desc("fit"), F.col("partner_id")], n)


def band() -> Column:
    out = None
    for lo, label in BANDS:
        out = F.when(F.col("fit") >= lo, label) if out is None else out.when(F.col("fit") >= lo, label)
    return out


def share_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows and percent of all rows per key."""
    whole = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", rnd(safe_div(F.col("n") * 100.0, whole), 1))


def keyword_filter(partners: DataFrame, words: Sequence[str], refs: DataFrame | None = None) -> DataFrame:
    base, found = with_hits(partners, words, refs)
    return base.filter(M.any_of(found)).select(*partners.columns)


def kpis(partners: DataFrame, refs: DataFrame) -> DataFrame:
    n_refs = refs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return partners.agg(F.count(F.lit(1)).alias("partners"), F.countDistinct("country").alias("countries"),
                        F.count_if(F.col("grade") == "Gold").alias("gold")).withColumn("client_refs", n_refs)


def by_country(partners: DataFrame, n: int = 20) -> DataFrame:
    return top(partners.groupBy("country").agg(F.count(F.lit(1)).alias("partners")), [desc("partners"), F.col("country")], n)


def by_grade(partners: DataFrame) -> DataFrame:
    """Counts in the fixed grade order; grades without partners stay with 0."""
    dim = partners.sparkSession.createDataFrame(list(enumerate(GRADES)), "pos int, grade string")
    agg = partners.groupBy("grade").agg(F.count(F.lit(1)).alias("partners"))
    return dim.join(agg, "grade", "left").fillna(0, ["partners"]).orderBy("pos")


def industries(rows: DataFrame, column: str, n: int = 25, sep: str = ";") -> DataFrame:
    """Most frequent entries of a delimited column, by length between 3 and 59."""
    one = rows.select(F.explode(F.split(F.col(column), sep)).alias("i")).select(F.trim("i").alias("industry"))
    kept = one.filter((F.length("industry") > 2) & (F.length("industry") < 60))
    return top(kept.groupBy("industry").agg(F.count(F.lit(1)).alias("n")), [desc("n"), F.col("industry")], n)


def industry_contains(refs: DataFrame, part: str, n: int = 200) -> DataFrame:
    hit = F.coalesce(F.lower("client_industry").contains(part.lower()), F.lit(False))
    return top(refs.filter(hit), [F.col("client_name"), F.col("partner_id")], n)


def dedupe_refs(refs: DataFrame, position: Column) -> DataFrame:
    """Per partner one reference per client name, whatever its case: the first."""
    return first_rows(refs, [F.col("partner_id"), F.lower("client_name")], position)


def client_facts(refs: DataFrame) -> DataFrame:
    """Per client: partner count, sorted industries and the first description (100 characters)."""
    edges = refs.groupBy("client_name", "partner_id").agg(F.collect_set("client_industry").alias("i"), F.min_by("description", "partner_id").alias("d"))
    return edges.groupBy("client_name").agg(
        F.count(F.lit(1)).alias("partner_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("i")))).alias("industries"),
        F.substring(F.min_by("d", "partner_id"), 1, 100).alias("description"))


def client_partners(refs: DataFrame, page: int = 1000) -> DataFrame:
    """Ordered distinct partners per client, in pages of the partner id range so that no list is unbounded."""
    edges = refs.select("client_name", "partner_id").distinct()
    return edges.groupBy("client_name", F.floor(F.col("partner_id") / page).alias("page")).agg(F.array_sort(F.collect_list("partner_id")).alias("partners"))


# One region's country words, codes, company suffixes and cities.
REGION_COUNTRIES = ["germany", "france", "italy", "spain", "uk", "united kingdom", "belgium", "netherlands", "austria", "switzerland", "poland", "portugal", "greece",
                    "sweden", "norway", "denmark", "finland", "ireland", "hungary", "czech", "romania", "bulgaria", "croatia", "slovenia", "slovakia", "lithuania",
                    "latvia", "estonia", "cyprus", "luxembourg", "malta", "iceland"]
REGION_CODES = ["DE", "FR", "IT", "ES", "UK", "GB", "BE", "NL", "AT", "CH", "PL", "PT", "GR", "SE", "NO", "DK", "FI", "IE", "HU", "CZ", "RO", "BG", "HR", "SI", "SK",
                "LT", "LV", "EE", "CY", "LU", "MT", "IS"]
REGION_SUFFIXES = ["gmbh", "sarl", "s.a.", "s.a.r.l.", "ltd", "b.v.", "a.s.", "sp.z.o.o", "srl", "société", "gesellschaft", "company", "ag", "oy", "ab", "nv"]
REGION_CITIES = ["london", "paris", "berlin", "amsterdam", "brussels", "zurich", "warsaw", "prague", "budapest", "athens", "madrid", "barcelona", "lisbon", "stockholm",
                 "copenhagen", "dublin", "rome", "vienna", "geneva", "bern", "hamburg", "munich", "cologne", "lyon", "marseille", "milan", "italy"]


def in_region(company: str, others: Sequence[str], countries: Sequence[str] = REGION_COUNTRIES, suffixes: Sequence[str] = REGION_SUFFIXES,
              cities: Sequence[str] = REGION_CITIES, codes: Sequence[str] = ()) -> Column:
    """Likely in a region by country or city word, company suffix, or (if given) a code in the original case."""
    whole = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (company, *others)])
    text, name = F.lower(whole), F.lower(F.coalesce(F.col(company), F.lit("")))
    words = M.any_of(text.contains(w) for w in [*countries, *cities])
    tail = M.any_of(name.endswith(s) | F.concat(F.lit(" "), name, F.lit(" ")).contains(f" {s} ") for s in suffixes)
    code = M.any_of(whole.contains(f" {c}") | whole.contains(f"({c})") | whole.contains(f"-{c}") for c in codes)
    return words | tail | code


def crawl_progress(log: DataFrame, item: str, at: str, expected: int) -> DataFrame:
    """Done, rate per minute, remaining and minutes left from a log of finished items."""
    agg = log.agg(F.countDistinct(item).alias("done"), (F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))).alias("seconds"))
    rate = safe_div(F.col("done") * 60.0, F.col("seconds"))
    left = F.greatest(F.lit(0), F.lit(expected) - F.col("done"))
    return agg.select("done", "seconds", rnd(rate, 6).alias("per_minute"), left.alias("remaining"), rnd(safe_div(left, rate), 3).alias("minutes_left"),
                      rnd(F.col("done") * 100.0 / F.lit(float(expected)), 2).alias("pct"))
