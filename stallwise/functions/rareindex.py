"""Substring joins through an index of rare pieces.

``contains_join`` files a text under all its pieces.  Here only the rarest piece
of each word counts: pieces of four letters are counted over all texts (in a
fixed number of hash buckets), each word is filed under its piece of least
count, and a text is scanned once for those heads alone.  Where a head is found,
the letters around it that a word would fill are cut out and joined to the
words by equality, which also verifies the match.  Texts are never shuffled:
what travels is the id and a string as long as a word, or a run between blanks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.match import explode_once
from stallwise.session import fresh_path

#: Letters of a piece (a shorter word is its own piece) and buckets of the piece counts.
WIDTH, BUCKETS = 4, 1 << 16
#: Heads that are broadcast at a time; more are looked for in further scans.
SHAPES = 100_000
#: Stands before a text; a word that has this non-character itself is not looked for.
PAD = "\uffff"


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS))


def _windows(texts: DataFrame, keys: Sequence[str], text: str, longest: int) -> tuple[DataFrame, int]:
    """Overlapping windows of each text (``_nth``, ``_win``) and their step; each has room for a word on both sides of its own part.

    A substring of a long text costs time in proportion to its place, so long
    texts are cut by one linear pattern first.
    """
    step = max(256, 4 * longest)
    padded = F.concat(F.lit(PAD * (longest - 1)), F.col(text))
    pattern = f"(?s)(?=(.{{1,{step + 2 * (longest - 1)}}})).{{1,{step}}}"
    cut = texts.filter(F.length(text) > 0).select(*keys, F.posexplode(F.regexp_extract_all(padded, F.lit(pattern), F.lit(1))).alias("_nth", "_win"))
    return cut, step


def _pieces(windows: DataFrame, step: int, longest: int) -> DataFrame:
    """One row for each piece of ``WIDTH`` letters that begins in a window's own part: ``_at`` (from 1, in the window) and ``_piece``."""
    win = F.col("_win")
    last = F.least(F.lit(longest - 1 + step), F.length(win) - WIDTH + 1)
    places = F.when(last >= longest, F.sequence(F.lit(longest), last))
    each = explode_once(windows, "_at", places)
    return each.withColumn("_piece", win.substr(F.col("_at"), F.lit(WIDTH)))


def _short(windows: DataFrame, keys: Sequence[str], step: int, longest: int, width: int) -> DataFrame:
    """The distinct strings of ``width`` letters of each window; a word that short is its own piece."""
    win = F.col("_win")
    last = F.least(F.lit(longest - 1 + step), F.length(win) - width + 1)
    places = F.when(last >= longest, F.sequence(F.lit(longest), last))
    return explode_once(windows, "_found", F.array_distinct(F.transform(places, lambda i: win.substr(i, F.lit(width))))).select(*keys, "_found")


def heads(words: DataFrame, word: str, counts: DataFrame) -> DataFrame:
    """``_word``, ``_head`` and ``_off``: the rarest piece of each word by ``counts(_bucket, _cnt)`` and where it begins (from 0)."""
    w = F.col("_word")
    places = F.transform(F.sequence(F.lit(0), F.greatest(F.length(w) - WIDTH, F.lit(0))), lambda i: F.struct(w.substr(i + 1, F.lit(WIDTH)).alias("head"), i.alias("off")))
    each = words.select(F.col(word).alias("_word")).filter(F.length(w) > 0).distinct().withColumn("_h", F.explode(places)).select("_word", "_h.*")
    counted = each.join(F.broadcast(counts), _bucket(F.col("head")) == F.col("_bucket"), "left")  # at most BUCKETS rows
    rarest = F.min(F.struct(F.coalesce("_cnt", F.lit(0).cast("long")).alias("c"), "head", "off"))
    return counted.groupBy("_word").agg(rarest.alias("m")).select("_word", F.col("m.head").alias("_head"), F.col("m.off").alias("_off"))


def _scanned(texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, word: str, shapes_at_once: int) -> DataFrame:
    """``found_words`` by the pieces of whole windows."""
    lengths = words.select(F.length(word).alias("n")).filter("n > 0")
    top = lengths.agg(F.max("n").alias("longest"), F.sort_array(F.collect_set(F.least("n", F.lit(WIDTH)))).alias("widths")).first()
    longest, widths = top["longest"] or 1, top["widths"]
    windows, step = _windows(texts, keys, text, longest)
    # Before the words are met the strings may be anything, so the same schema serves for no words at all.
    candidates = [_short(windows, keys, step, longest, n) for n in widths if n < WIDTH] or [_short(windows.limit(0), keys, step, longest, 1)]
    filed = words.select(F.col(word).alias("_word")).filter(F.length("_word") > 0).distinct()
    if WIDTH in widths:
        pieces = _pieces(windows, step, longest)
        counts = pieces.groupBy(_bucket(F.col("_piece")).alias("_bucket")).agg(F.count("*").alias("_cnt"))
        # The heads decide what the scans below look for: a stored table keeps them the same for every task and retry.
        path = fresh_path(texts.sparkSession, "heads")
        heads(filed.filter(F.length("_word") >= WIDTH), "_word", counts).select("_head", "_off", F.length("_word").alias("_len")).distinct().write.parquet(path)
        shapes = texts.sparkSession.read.parquet(path)
        parts = max(1, -(-shapes.count() // shapes_at_once))
        for part in range(parts):
            some = shapes.filter(F.pmod(F.xxhash64("_head", F.lit(3)), F.lit(parts)) == part)
            met = pieces.join(F.broadcast(some), F.col("_piece") == F.col("_head"))  # about ``shapes_at_once`` rows
            begin = F.col("_at") - F.col("_off")
            candidates.append(met.select(*keys, F.col("_win").substr(begin, F.col("_len")).alias("_found")))
    # A string that reaches into the padding is no word of real letters.
    return reduce(DataFrame.unionByName, candidates).join(filed.filter(~F.col("_word").contains(PAD)), F.col("_found") == F.col("_word")).select(
        *keys, F.col("_word").alias(word)).distinct()


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def found_words(texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame, word: str, shapes_at_once: int = SHAPES) -> DataFrame:
    """``keys`` and ``word`` of every pair in which the text contains the word, each pair once.

    Exact and case-sensitive, for words and texts of any length.  Null and empty
    texts and words meet nothing; texts that share their keys count as one.

    A word without a blank lies inside one run of a text between blanks, so such
    words are looked for in the distinct runs of all texts, and texts meet them
    by their runs.  Words with a blank, and runs too long to be words of a
    language, go through whole windows.
    """
    size, w = F.length(word), F.col(word)
    blank = w.contains(" ")
    facts = words.filter(size > 0).agg(F.min(F.when(~blank, size)).alias("least"), F.max(size).alias("most"), F.max(blank).alias("blank")).first()
    if facts["least"] is None:
        return _scanned(texts, keys, text, words, word, shapes_at_once)
    limit = max(256, 4 * facts["most"])
    runs = explode_once(texts.filter(F.length(text) > 0).select(*keys, F.array_distinct(F.split(text, " ")).alias("_runs")), "_run", F.col("_runs")).select(*keys, "_run")
    runs = runs.filter(F.length("_run") >= facts["least"])
    # A null stands for all runs above the limit.
    every = _stored(runs.select(F.when(F.length("_run") <= limit, F.col("_run")).alias("_run")).distinct(), "runs")
    met = _stored(_scanned(every.filter("_run is not null"), ["_run"], "_run", words.filter(~blank), word, shapes_at_once), "met")
    found = [runs.join(met, "_run").select(*keys, word)]
    if not every.filter("_run is null").isEmpty():
        found.append(_scanned(runs.filter(F.length("_run") > limit), keys, "_run", words.filter(~blank), word, shapes_at_once))
    if facts["blank"]:
        found.append(_scanned(texts, keys, text, words.filter(blank), word, shapes_at_once))
    return reduce(DataFrame.unionByName, found).distinct()
