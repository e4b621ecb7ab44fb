"""Incremental forms of the batch jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.operators import maintain as A
from stallwise.session import fresh_path


def read_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append",
                  checkpoint: str | None = None) -> None:
    """Process what is there and stop; progress is kept in ``checkpoint``."""
    checkpoint = checkpoint or fresh_path(stream.sparkSession, "stream-progress")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink else w.format("parquet").option("path", path).start()
    q.awaitTermination()


def dedupe(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """First copy of every key within the watermark; later and late copies are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, by: str, at: str, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Counts per tumbling or sliding event-time window."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, delay).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, by: str, at: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Bursts of activity per ``by``, closed once the watermark passes their end."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n"))


SESSION = "start timestamp, last timestamp, n long, final boolean"


#: Groups that users are dealt to; each is one call a batch, over all its users at once.
USER_GROUPS = 1024


def _merged_spans(spans, gap: int):
    """Spans (``key``, ``first``, ``last``, ``n``, ``held``) at most ``gap`` apart put together per key, and the place of each span's own among them.

    ``held`` is then true where a span is a held one that nothing was added to.
    """
    import numpy as np
    import pandas as pd
    spans = spans.assign(code=pd.factorize(spans["key"], use_na_sentinel=False)[0]).sort_values(["code", "first"], ignore_index=True)
    if spans.empty:
        return spans.drop(columns="code"), spans, np.zeros(0, "int64")
    first, code, ends = (spans[c].to_numpy() for c in ("first", "code", "last"))
    reach = spans.groupby("code")["last"].cummax().to_numpy()
    new = np.append(True, (code[1:] != code[:-1]) | (first[1:] > reach[:-1] + gap))
    starts, own = np.flatnonzero(new), np.cumsum(new) - 1
    alone = np.diff(np.append(starts, len(spans))) == 1
    out = pd.DataFrame({"key": spans["key"].to_numpy()[starts], "first": first[starts], "last": np.maximum.reduceat(ends, starts),
                        "n": np.add.reduceat(spans["n"].to_numpy(), starts), "held": spans["held"].to_numpy()[starts] & alone})
    return out, spans, own


def _spans(key, first, last, n, held: bool):
    import pandas as pd
    out = pd.DataFrame({"key": pd.Series(key, dtype=object), "first": pd.Series(first, dtype="int64"), "last": pd.Series(last, dtype="int64"), "n": pd.Series(n, dtype="int64")})
    return out.assign(held=held)


def merged_sessions(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, count) spans that lie at most ``gap`` apart, put together."""
    out, _, _ = _merged_spans(_spans([0] * len(spans), *([s[k] for s in spans] for k in range(3)), False), gap)
    return list(zip(*(out[c].tolist() for c in ("first", "last", "n")), strict=True))


def live_sessions(stream: DataFrame, by: str, at: str, gap_seconds: int, delay: str = "1 hour", groups: int = USER_GROUPS) -> DataFrame:
    """Sessions as they are known after each batch: ``by``, ``start``, ``last``, ``n`` and whether the session is ``final``.

    Open sessions come out provisionally whenever they change; a timer on event
    time closes them once the watermark has passed their end, and only open ones
    are kept as state.  A late event may join two sessions or move a start; the
    start that is gone then comes out with ``n`` 0.  ``latest_sessions`` folds the updates.

    Values of ``by``, of a type that reads back from its text, are dealt to
    ``groups``; a call handles all of a group, so that its cost is spread over them.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    gap = gap_seconds * 1_000_000

    def step(key: tuple, frames, state: GroupState):
        held = _spans(*state.get, True) if state.exists else _spans([], [], [], [], True)
        new = _spans([], [], [], [], False)
        for pdf in () if state.hasTimedOut else frames:
            new, _, _ = _merged_spans(pd.concat([new, _spans(pdf["_key"], pdf["_at"], pdf["_at"], [1] * len(pdf), False)], ignore_index=True), gap)
        now, old, own = _merged_spans(pd.concat([held, new], ignore_index=True), gap)
        mark = state.getCurrentWatermarkMs() * 1000
        final = now["last"] + gap <= mark
        still = now[~final]
        gone = old[old["held"].to_numpy() & (old["first"].to_numpy() != now["first"].to_numpy()[own])]
        out = pd.concat([now[final].assign(final=True), still[~still["held"]].assign(final=False), gone.assign(last=gone["first"], n=0, final=True)], ignore_index=True)
        if len(still):
            state.update(tuple(still[c].tolist() for c in ("key", "first", "last", "n")))
            # A timer has to lie after the watermark; it fires once the first of the open sessions has ended.
            state.setTimeoutTimestamp(max(int(still["last"].min()) + gap, mark + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"_key": out["key"], "start": pd.to_datetime(out["first"], unit="us"), "last": pd.to_datetime(out["last"], unit="us"),
                            "n": out["n"].astype("int64"), "final": out["final"].astype(bool)})

    kind = stream.schema[by].dataType
    micros = stream.withWatermark(at, delay).withColumns({"_at": F.unix_micros(F.col(at).cast("timestamp")), "_key": F.col(by).cast("string"),
                                                          "_group": F.pmod(F.xxhash64(by), F.lit(groups))})
    found = micros.select("_group", "_key", at, "_at").groupBy("_group").applyInPandasWithState(
        step, f"_key string, {SESSION}", "key array<string>, first array<long>, last array<long>, n array<long>", "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("_key").cast(kind).alias(by), "start", "last", "n", "final")


def latest_sessions(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The newest word on every session; starts that are gone are left out."""
    newest = spark.read.parquet(path).groupBy(by, "start").agg(F.max_by(F.struct("last", "n", "final"), F.struct("batch", "n")).alias("s"))
    return newest.select(by, "start", "s.*").filter("n > 0")


def keep_updates(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for update mode: each batch's changed groups in a folder of its own, safe to write again."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def latest_updates(spark: SparkSession, path: str, keys: list[str | Column], value: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def _merged_posts(rows: DataFrame) -> DataFrame:
    """One row per post: fixed columns from its earliest pull, changing ones from its latest; equal pulls are settled by value."""
    marks = ("first_pulled", "last_pulled")
    value = lambda c: F.max_by(c, F.struct("last_pulled", c)) if c in A.POST_UPDATES else F.min_by(c, F.struct("first_pulled", c))
    columns = [value(c).alias(c) for c in rows.columns if c not in ("id", "batch", *marks)]
    return rows.groupBy("id").agg(*columns, F.min("first_pulled").alias("first_pulled"), F.max("last_pulled").alias("last_pulled"))


def posts_upsert(root: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps each batch's posts, with the times they were pulled, in a folder of its own.

    A batch costs what it brings, whatever the size of the table, and writing it
    again after a failure replaces it; ``current_posts`` merges on read.  How
    pulls fall into batches changes nothing.
    """
    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("first_pulled", F.col("pulled")).withColumnRenamed("pulled", "last_pulled")
        _merged_posts(rows).write.mode("overwrite").parquet(f"{root}/batch={number}")
    return keep


def current_posts(spark: SparkSession, root: str) -> DataFrame:
    """The merged table, combined map-side."""
    return _merged_posts(spark.read.parquet(root)).drop("first_pulled", "last_pulled")


def compact_posts(spark: SparkSession, root: str, target: str) -> None:
    """Write the merged table as the first batch of a new folder, for later batches to follow."""
    _merged_posts(spark.read.parquet(root)).write.mode("overwrite").parquet(f"{target}/batch=-1")


CARD_KEY = ("run_id", "version", "tech_name")


def run_ingest(root: str) -> Callable[[DataFrame, int], None]:
    """Sink that stages the cards of each batch in a folder of its own.

    A run may come in any number of batches; writing a batch again replaces it.
    """
    def load(batch: DataFrame, number: int) -> None:
        valid = batch.filter(F.col("version").isNotNull() & F.col("tech_name").isNotNull())
        A.first_rows(valid, [F.col(c) for c in CARD_KEY], F.struct("file_pos")).write.mode("overwrite").parquet(f"{root}/batch={number}")
    return load


def current_cards(spark: SparkSession, root: str) -> DataFrame:
    """All runs, one card per run, version and name: the first in its file, whatever the batches."""
    return A.first_rows(spark.read.parquet(root), [F.col(c) for c in CARD_KEY], F.struct("file_pos", "batch")).drop("batch")
