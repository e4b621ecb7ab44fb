"""Exact order statistics over any number of rows.

A quantile sketch guides the work and never the result.  To *select* values at
given positions, the sketch brackets each position; rows below the bracket are
only counted, those inside are counted by value and by narrow buckets, and only
the bucket that holds the position is ordered (``selected``).  To *rank* all
values, the sketch gives split points per key, so that every (key, bucket) has
a like number of distinct values whatever their distribution (``ranked``).  No
task ever holds a whole key, and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Steps of the sketch, its accuracy (ranks are off by one in that many), and buckets of a bracket.
GRID, ACCURACY, NARROW = 200, 10_000, 1024
#: Distinct values per key are dealt over so many buckets to be ranked.
SPLITS = 128


def _steps(n: int) -> Column:
    return F.array(*[F.lit(i / n) for i in range(n + 1)])


def counted(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """Distinct non-NULL values per key with their row count ``cnt`` (and optional extra sums).

    ``weight`` names the row count of input that is already combined.
    """
    aggs = [(F.sum(weight) if weight else F.count(F.lit(1))).alias("cnt")] + [c.alias(n) for n, c in (sums or {}).items()]
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs)


def ranked(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """Per (keys, value): ``cnt``, ``below`` (rows strictly smaller in the key) and ``n`` (rows of the key)."""
    keys = list(keys)
    vc = counted(df, keys, value, sums, weight)
    splits = vc.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, _steps(SPLITS), F.lit(ACCURACY))).alias("_splits"))
    v = F.col(value)
    # Declared non-NULL, so that no filter is inferred below and all sides read the very same counts from one reused exchange.
    bucket = F.coalesce(F.size(F.filter("_splits", lambda s: s < v)), F.lit(0))
    dealt = _joined(vc, splits, keys).withColumn("_b", bucket).drop("_splits")
    group = [F.col(k) for k in keys] or [F.lit(0)]
    by_key = W.partitionBy(*group)
    upto = by_key.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = dealt.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_bn")).select(
        *keys, "_b", (F.sum("_bn").over(upto) - F.col("_bn")).alias("_start"), F.sum("_bn").over(by_key).alias("n"))
    before = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = _joined(dealt, starts, [*keys, "_b"])
    return placed.withColumn("below", F.col("_start") + F.sum("cnt").over(before) - F.col("cnt")).drop("_b", "_start")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row per key; NULL keys meet, without keys all rows meet its one row."""
    if not keys:
        packed = right.select(F.struct(*right.columns).alias("p")).scalar()
        return left.withColumn("_p", packed).select(*left.columns, "_p.*")
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(named, cond).drop(*[f"_k{i}" for i in range(len(keys))])


def selected(df: DataFrame, keys: Sequence[str], value: str, picks: Mapping[str, Column]) -> DataFrame:
    """Per key ``_n``, the number of non-NULL values, and the values at 0-based sorted positions; each pick is an expression over ``n``.

    A position outside of 0 to n - 1 gives NULL.
    """
    keys, names = list(keys), list(picks)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, _steps(GRID), F.lit(ACCURACY)).alias("_grid"))
    brackets = []
    for i, name in enumerate(names):
        at = picks[name].cast("long")
        step = F.floor((at + 0.5) / F.col("n") * GRID).cast("int")
        # One step more on each side than the sketch may err.
        edge = lambda k: F.when((k >= 0) & (k <= GRID), F.get("_grid", k))
        brackets.append(F.struct(F.lit(i).alias("i"), at.alias("at"), edge(step - 1).alias("lo"), edge(step + 2).alias("hi")))
    sketch = sketch.select(*keys, F.col("n").alias("_n"), F.array(*brackets).alias("_picks"))
    v = F.col(value)

    def placed(p: Column) -> Column:
        lo, hi = p["lo"].cast("double"), p["hi"].cast("double")
        part = F.floor((v.cast("double") - lo) / (hi - lo) * NARROW)
        inner = F.when(lo.isNull() | hi.isNull() | (hi <= lo), F.lit(0)).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(NARROW)))
        below = F.coalesce(v < p["lo"], F.lit(False))
        above = F.coalesce(v > p["hi"], F.lit(False))
        return F.when(~above, F.struct(p["i"].alias("_i"), p["at"].alias("_at"), F.when(below, F.lit(-1)).otherwise(inner).alias("_b"), F.when(~below, v).alias("_v")))

    met = _joined(rows, sketch, keys).select(*keys, "_n", F.explode(F.array_compact(F.transform("_picks", placed))).alias("_p")).select(*keys, "_n", "_p.*")
    found = met.groupBy(*keys, "_n", "_i", "_at", "_b", "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    upto = W.partitionBy(*keys, "_i").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = found.groupBy(*keys, "_i", "_at", "_b").agg(F.sum("_cnt").alias("_bn")).withColumn("_start", F.sum("_bn").over(upto) - F.col("_bn"))
    right = totals.filter((F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_start") + F.col("_bn"))).select(*keys, "_i", "_b", "_start")
    inside = W.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = _joined(found, right, [*keys, "_i", "_b"]).withColumn("_upto", F.col("_start") + F.sum("_cnt").over(inside))
    hit = (F.col("_upto") - F.col("_cnt") <= F.col("_at")) & (F.col("_at") < F.col("_upto"))
    return ordered.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when((F.col("_i") == i) & hit, F.col("_v"))).alias(name) for i, name in enumerate(names)])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolation quantiles, one column per entry of ``probs``."""
    picks, outs = {}, []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        picks |= {f"_lo_{name}": F.floor(pos), f"_hi_{name}": F.ceil(pos)}
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return selected(df, keys, value, picks).select(*keys, *outs)


def positions(df: DataFrame, keys: Sequence[str], value: str, picks: Mapping[str, Column]) -> DataFrame:
    """Values at explicit 0-based positions; each pick is an expression over ``n``."""
    return selected(df, keys, value, picks).select(*keys, *picks)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """``ranked`` plus ``avg_rank``: the 1-based mean rank shared by ties."""
    return ranked(df, keys, value, sums, weight).withColumn("avg_rank", F.col("below") + (F.col("cnt") + 1) / F.lit(2.0))
