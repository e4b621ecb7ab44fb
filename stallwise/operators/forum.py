"""Posts and comments: signals, themes, tops, word and pair counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import columns as C, match as M, tokens as T
from stallwise.functions.columns import rnd, safe_div, zero
from stallwise.operators.market import desc, rank_within, top, total


def tag_signals(posts: DataFrame, patterns: Mapping[str, str], needs: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``signals``: names of the patterns found in title and body, in the order given.

    ``needs`` may name, per pattern, texts of which one occurs in every match; the
    quick substring test then keeps other rows away from the pattern.
    """
    text = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))))
    tagged = posts.withColumn("_text", text)
    body = F.col("_text")
    quick = lambda n: M.any_of(body.contains(w) for w in needs[n]) if needs and n in needs else F.lit(True)
    found = F.array_compact(F.array(*[F.when(quick(n) & body.rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return tagged.withColumn("signals", found).drop("_text")


def signal_counts(tagged: DataFrame) -> DataFrame:
    return M.explode_once(tagged.select("signals"), "signal", F.col("signals")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def relevant(posts: DataFrame, own: Sequence[str], terms: Sequence[str]) -> DataFrame:
    return posts.filter(F.col("community").isin(list(own)) | M.contains(["title", "selftext"], terms))


def recent(posts: DataFrame, as_of: str, days: int) -> DataFrame:
    """First seen within ``days`` before ``as_of``; no wall clock."""
    return posts.filter(F.col("first_seen") >= F.date_sub(F.lit(as_of).cast("date"), days))


def with_signal(tagged: DataFrame, signal: str) -> DataFrame:
    return tagged.filter(F.array_contains("signals", signal))


def top_by_signal(tagged: DataFrame, as_of: str, days: int, n: int) -> DataFrame:
    """The n most engaging recent posts of every signal, with their other tags."""
    rows = M.explode_once(recent(tagged, as_of, days), "signal", F.col("signals")).withColumn("engagement", C.engagement())
    best = rank_within(rows, ["signal"], [desc("engagement"), F.col("id")], n)
    return best.select("signal", "rank", "id", "engagement", F.date_format("first_seen", "yyyy-MM-dd").alias("day"),
                       F.array_join(F.array_remove(F.col("signals"), F.col("signal")), ",").alias("also"))


def by_community(posts: DataFrame, n: int = 20) -> DataFrame:
    agg = posts.groupBy("community").agg(F.count(F.lit(1)).alias("posts"), total("score").alias("score"), total("num_comments").alias("comments"))
    return top(agg, [desc("posts"), F.col("community")], n)


def repeat_authors(posts: DataFrame, n: int = 15) -> DataFrame:
    """Authors of more than one post with their communities; pairs are combined first."""
    named = posts.filter(~F.coalesce("author", F.lit("")).isin("", "[deleted]"))
    pairs = named.groupBy("author", "community").agg(F.count(F.lit(1)).alias("c"))
    best = top(pairs.groupBy("author").agg(F.sum("c").alias("n")).filter("n > 1"), [desc("n"), F.col("author")], n)
    # Only the n authors of the report have their communities listed.
    return pairs.join(best, "author").groupBy("author", "n").agg(F.array_join(F.array_sort(F.collect_list("community")), ", ").alias("communities"))


def window_totals(posts: DataFrame, as_of: str, days: int) -> DataFrame:
    inside = F.col("first_seen") >= F.date_sub(F.lit(as_of).cast("date"), days)
    return posts.agg(F.count(F.lit(1)).alias("all_posts"), F.count_if(inside).alias("in_window"))


def themes(rows: DataFrame, text: str, dim: Sequence[M.Niche], order: Column, n: int = 8, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Best n rows of every theme; a theme is any-of words, or a named condition in ``extra``."""
    tests = [F.when(M.contains([text], t.keywords), F.lit(t.label)) for t in dim]
    tests += [F.when(cond, F.lit(name)) for name, cond in (extra or {}).items()]
    hits = M.explode_once(rows, "theme", F.array_compact(F.array(*tests)))
    return rank_within(hits, ["theme"], [order, F.col("id")], n)


def dedupe_posts(copies: DataFrame, position: str) -> DataFrame:
    """One row per id: the first copy, with the signals of all copies.

    Distinct signal sets are few, so copies are combined map-side however many there are.
    """
    keep = [c for c in copies.columns if c not in ("signals", position)]
    return copies.groupBy(F.col("id").alias("_id")).agg(
        F.min_by(F.struct(*keep), position).alias("_row"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals")).select("_row.*", "signals")


def activity_window(rows: DataFrame, at: str) -> DataFrame:
    agg = rows.agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n"))
    days = F.greatest(F.lit(1), F.datediff("b", "a"))
    return agg.select(F.date_format("a", "yyyy-MM-dd").alias("first"), F.date_format("b", "yyyy-MM-dd").alias("last"), days.alias("span_days"), "n",
                      rnd(F.col("n") * 30.0 / days, 2).alias("per_30_days"))


# ---- words -------------------------------------------------------------------

def token_freq(posts: DataFrame, stop: Sequence[str] = tuple(T.FORUM_STOPWORDS), n: int = 40) -> DataFrame:
    """Most frequent words of titles and whole bodies; counted map-side, stopwords leave after counting."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))))
    words = M.explode_once(posts.select(text.alias("_t")), "token", T.words("_t", T.POST_TOKEN)).select("token")
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(~F.col("token").isin(sorted(stop)))
    return top(counts, [desc("n"), F.col("token")], n)


def terms_bigrams(rows: DataFrame, stop: Sequence[str] = tuple(T.TITLE_STOPWORDS), n: int = 40, min_count: int = 2, final: int = 50) -> DataFrame:
    """Leading words and word pairs of cleaned titles, merged."""
    clean = rows.select(T.title_terms("title", stop).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    both = clean.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("w").alias("t")), F.struct(F.lit(1).alias("kind"), pairs.alias("t")))).alias("s"))
    counts = M.explode_once(both.select("s.kind", "s.t"), "term", F.col("t")).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))
    best = rank_within(counts, ["kind"], [desc("n"), F.col("term")], n, "_r").filter(F.col("n") >= min_count)
    return top(best.select("term", "n"), [desc("n"), F.col("term")], final)


# Fixed value: two capitalised names around a connecting word.
PAIR = r"\b([A-Z][a-zA-Z0-9.]+)\s+(?:to|-->|->|→|with|and)\s+([A-Z][a-zA-Z0-9.]+)\b"


def pair_patterns(rows: DataFrame, title: str = "title", stop: Sequence[str] = tuple(T.TITLE_STOPWORDS), n: int = 30) -> DataFrame:
    side = lambda g: F.regexp_extract_all(F.col(title), F.lit(PAIR), F.lit(g))
    both = rows.select(F.explode(F.arrays_zip(side(1).alias("source"), side(2).alias("target"))).alias("p")).select("p.*")
    ok = lambda c: (F.length(c) >= 3) & ~F.lower(c).isin(sorted(stop))
    agg = both.filter(ok("source") & ok("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return top(agg, [desc("n"), F.col("source"), F.col("target")], n)


def topic_counts(rows: DataFrame, text: str, topics: Sequence[str], min_count: int = 3, n: int = 40) -> DataFrame:
    """Non-overlapping occurrences of each topic in all texts, summed in one scan."""
    low = rows.select(F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    hits = [F.sum((F.length("t") - F.length(F.replace(F.col("t"), F.lit(k), F.lit("")))) / F.lit(len(k))).cast("bigint").alias(f"c{i}") for i, k in enumerate(topics)]
    long = low.agg(*hits).select(F.explode(F.array(*[F.struct(F.lit(k).alias("topic"), F.col(f"c{i}").alias("n")) for i, k in enumerate(topics)])).alias("s")).select("s.*")
    return top(long.filter(F.col("n") >= min_count), [desc("n"), F.col("topic")], n)


def channel_summary(videos: DataFrame) -> DataFrame:
    date = F.when(F.col("upload_date") != "NA", F.col("upload_date"))
    return videos.agg(F.count(F.lit(1)).alias("videos"), total("views").alias("views"), rnd(F.avg("duration_s") / 60.0, 2).alias("mean_minutes"),
                      F.min(date).alias("first"), F.max(date).alias("last"))


def top_videos(videos: DataFrame, n: int = 30) -> DataFrame:
    return top(videos.select("id", "views", F.floor(F.col("duration_s") / 60).alias("minutes")), [desc("views"), F.col("id")], n)
