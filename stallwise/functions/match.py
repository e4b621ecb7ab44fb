"""Keyword matching: one scan for any number of niches.

Small keyword lists become an array of literal tests that is exploded, so a
listing is read once and lands in every niche it matches.  Keyword tables that
grow with the data go through ``contains_join``, an equi-join on leading
characters that is exact and needs no nested loop.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD_EDGE = r"[^\p{L}\p{N}_]"  # what may stand next to a whole word, in any script
LITERAL_LIMIT = 2000  # keywords that may be compiled into one expression


@dataclass(frozen=True)
class Niche:
    """One row of a keyword dimension."""

    label: str
    keywords: tuple[str, ...]
    attrs: dict = field(default_factory=dict, compare=False)


def niche(label: str, *keywords: str, **attrs) -> Niche:
    return Niche(label, tuple(keywords), attrs)


def from_frame(dim: DataFrame, label: str = "label", keyword: str = "keyword", attrs: Sequence[str] = ()) -> list[Niche]:
    """Collect a keyword table after checking that it is small; refuse otherwise."""
    rows = dim.select(label, keyword, *attrs).limit(LITERAL_LIMIT + 1).collect()
    if len(rows) > LITERAL_LIMIT:
        raise ValueError(f"more than {LITERAL_LIMIT} keywords: use fan_out_table")
    grouped: dict[str, tuple[list[str], dict]] = {}
    for lab, kw, *values in rows:
        grouped.setdefault(lab, ([], dict(zip(attrs, values))))[0].append(kw)
    return [Niche(lab, tuple(kws), values) for lab, (kws, values) in grouped.items()]


def to_frame(spark: SparkSession, dim: Sequence[Niche], **types: str) -> DataFrame:
    """(pos, label, attrs...) rows of a dimension; ``types`` names the attributes to keep."""
    ddl = "pos int, label string" + "".join(f", {n} {t}" for n, t in types.items())
    return spark.createDataFrame([(i, n.label, *[n.attrs.get(a) for a in types]) for i, n in enumerate(dim)], ddl)


def explode_once(df: DataFrame, out: str, array: Column) -> DataFrame:
    """``explode`` that evaluates a costly array once.

    For a plain explode the optimizer adds a filter on the array's size and so
    computes it twice; the outer form is filtered on its result instead.
    """
    return df.withColumn(out, F.explode_outer(array)).filter(F.col(out).isNotNull())


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains(fields: Sequence[str], keywords: Sequence[str]) -> Column:
    """Case-insensitive substring in any field; NULL fields never match."""
    return any_of(F.coalesce(F.lower(F.col(f)).contains(k.lower()), F.lit(False)) for k in keywords for f in fields)


def like(fields: Sequence[str], patterns: Sequence[str]) -> Column:
    """Case-insensitive LIKE, where ``_`` and ``%`` inside a pattern stay wildcards."""
    return any_of(F.coalesce(F.lower(F.col(f)).like(p.lower()), F.lit(False)) for p in patterns for f in fields)


def joined_text(fields: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def word(fields: Sequence[str], keywords: Sequence[str]) -> Column:
    """Whole-word match on the joined fields; blanks in a keyword match any run of whitespace."""
    body = "|".join(r"\s+".join(re.escape(p) for p in k.lower().split()) for k in keywords)
    text = joined_text(fields)
    # A cheap substring test keeps most rows away from the pattern.
    return any_of(text.contains(k.lower().split()[0]) for k in keywords) & text.rlike(f"(^|{WORD_EDGE})({body})($|{WORD_EDGE})")


def regex(fields: Sequence[str], patterns: Sequence[str]) -> Column:
    """Any pattern found in the lower-cased first field."""
    return F.coalesce(F.lower(F.col(fields[0])).rlike("|".join(f"({p})" for p in patterns)), F.lit(False))


MODES: dict[str, Callable[[Sequence[str], Sequence[str]], Column]] = {
    "contains": contains, "like": like, "word": word, "regex": regex,
}


def matched_labels(dim: Sequence[Niche], fields: Sequence[str], mode: str = "contains") -> Column:
    """Array of the labels a row matches; very long lists are still right, but run outside of generated code."""
    test = MODES[mode]
    return F.array_compact(F.array(*[F.when(test(fields, n.keywords), F.lit(n.label)) for n in dim]))


def fan_out(df: DataFrame, dim: Sequence[Niche], fields: Sequence[str] = ("display_name", "summary"),
            mode: str = "contains", out: str = "label") -> DataFrame:
    """One row per (row, matching niche); a single scan of ``df``.

    Substring lists too long for one expression become a keyword table and an equi-join, with the same rows.
    """
    if mode == "contains" and sum(len(n.keywords) for n in dim) > LITERAL_LIMIT:
        words = df.sparkSession.createDataFrame([(n.label, k) for n in dim for k in n.keywords], "label string, keyword string")
        return fan_out_table(df, fields, words).withColumnRenamed("label", out)
    return explode_once(df, out, matched_labels(dim, fields, mode))


def keep_zero(agg: DataFrame, dim_frame: DataFrame, key: str = "label", zeros: Sequence[str] = ()) -> DataFrame:
    """Put niches without any match back, with 0 in the ``zeros`` columns.

    The dimension side is the small, literal one, so it is the streamed side of
    a plain equi-join; Spark chooses the strategy from the sizes it measures.
    """
    return dim_frame.join(agg, key, "left").fillna(0, subset=list(zeros))


def contains_join(texts: DataFrame, text: str, words: DataFrame, word_col: str, widths: Sequence[int] = (1, 2, 3, 4, 8)) -> DataFrame:
    """Every (text row, word row) where the text contains the word, as an equi-join.

    Each word is filed under its leading characters, as many as the greatest
    width it can fill; each text under all its substrings of those widths.  A
    pair meets exactly once and is then verified.  Feed distinct texts and words.
    """
    t, w = F.col(text), F.col(word_col)

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
        return F.when(F.length(t) >= n, F.transform(starts, lambda i: t.substr(i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.array(*[pieces(n) for n in widths])))
    left = explode_once(texts, "_gram", grams)
    fill = F.coalesce(*[F.when(F.length(w) >= n, F.lit(n)) for n in sorted(widths, reverse=True)])
    right = words.filter(F.length(w) > 0).withColumn("_gram", w.substr(F.lit(1), fill))
    return left.join(right, "_gram").filter(t.contains(w)).drop("_gram")


def fan_out_table(df: DataFrame, fields: Sequence[str], dim: DataFrame, label: str = "label", keyword: str = "keyword") -> DataFrame:
    """``fan_out`` for keyword tables of any size: substring matches in any of the fields, each label once per row."""
    words = dim.select(F.col(label), F.lower(keyword).alias("_word"))
    names = [f"_t{i}" for i in range(len(fields))]
    lowered = [F.lower(f).alias(n) for f, n in zip(fields, names)]
    texts = df.select(*lowered).distinct()
    found = None
    for n in names:
        pairs = contains_join(texts.select(F.col(n).alias("_text")).filter("_text is not null").distinct(), "_text", words.select("_word").distinct(), "_word")
        labels = pairs.join(words, "_word").select("_text", label).distinct()
        hits = texts.join(labels, F.col(n) == F.col("_text")).select(*names, label)
        found = hits if found is None else found.unionByName(hits)
    # Labels belong to distinct texts and are joined back, so equal input rows all stay.
    found = found.distinct().select(*[F.col(n).alias(f"_u{n}") for n in names], label)
    same = [F.col(n).eqNullSafe(F.col(f"_u{n}")) for n in names]
    return df.select("*", *lowered).join(found, same).select(*df.columns, label)
