"""Streaming jobs over the given tables, read back after all data has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.plans import views as V
from stallwise.plans.q_tables import _post_copies
from stallwise.plans.registry import query
from stallwise.session import fresh_path
from stallwise.streaming import jobs as J

_fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def events(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return J.read_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st_dedupe", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st_dedupe(spark, sf):
    folder, out = fresh_path(spark, "events-twice"), fresh_path(spark, "events-once")
    rows = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.unionByName(rows).write.parquet(folder)
    J.run_available(J.dedupe(J.read_stream(spark, folder, rows.schema), "event_id", "ts"), path=out)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _windows(spark, sf, size, slide=None):
    out = fresh_path(spark, "windows")
    J.run_available(J.window_counts(events(spark, sf), "event_type", "ts", size, slide), J.keep_updates(out), mode="update")
    return J.latest_updates(spark, out, ["window", "event_type"], "n").select(_fmt("window.start").alias("start"), "event_type", "n")


@query("st_signal_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d 00:00:00') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_signal_counts(spark, sf):
    return _windows(spark, sf, "1 day")


@query("st_signal_counts_7d", """SELECT strftime(d - i::INT, '%Y-%m-%d 00:00:00') AS start, event_type, count(*) AS n
    FROM (SELECT ts::DATE AS d, event_type FROM events), range(7) r(i) GROUP BY 1, 2""")
def st_signal_counts_7d(spark, sf):
    return _windows(spark, sf, "7 days", "1 day")


@query("st_activity_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN ts <= p + INTERVAL 4 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s
    HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def st_activity_sessions(spark, sf):
    out = fresh_path(spark, "sessions")
    J.run_available(J.sessions(events(spark, sf), "user_id", "ts", "4 hours"), path=out)
    return spark.read.parquet(out).select("user_id", _fmt("s.start").alias("start"), "n")


_SESSIONS = """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN ts <= p + INTERVAL 4 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s"""


def _live(spark, stream, batches):
    J.run_available(J.live_sessions(stream, "user_id", "ts", 4 * 3600), sink=J.keep_updates(batches), mode="update")
    return J.latest_sessions(spark, batches, "user_id").select("user_id", _fmt("start").alias("start"), "n")


@query("st_live_sessions", _SESSIONS)
def st_live_sessions(spark, sf):
    """Closed sessions and those still open, in one batch."""
    return _live(spark, events(spark, sf), fresh_path(spark, "sessions"))


@query("st_live_sessions_batches", _SESSIONS)
def st_live_sessions_batches(spark, sf):
    """The same from several batches in the order of time: sessions that cross a border go on."""
    folder = fresh_path(spark, "events")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    for k in range(5):  # one after the other, so that files are as old as their events
        begin, end = (first + (last - first) / 5 * i for i in (k, k + 1))
        rows.filter((F.col("ts") >= begin) & (F.col("ts") < end) if k < 4 else F.col("ts") >= begin).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return _live(spark, stream.withColumn("ts", F.col("ts").cast("timestamp")), fresh_path(spark, "sessions"))


@query("st_posts_upsert", """SELECT id, CASE WHEN first_seen > '2024-01-20' THEN 'moved' ELSE community END AS community, CASE WHEN first_seen >= '2024-01-15' THEN score + 5 ELSE score END AS score,
    CASE WHEN first_seen >= '2024-01-15' THEN 'b' ELSE 'a' END AS signals FROM posts""")
def st_posts_upsert(spark, sf):
    """Two pulls land one after the other; the same progress folder picks up where it stopped."""
    folder, root, progress = fresh_path(spark, "pulls"), fresh_path(spark, "posts"), fresh_path(spark, "pulls-progress")
    for number, pull in enumerate(_post_copies(spark, sf)):
        rows = pull.withColumn("pulled", F.lit(number))
        rows.write.mode("append").parquet(folder)
        J.run_available(J.read_stream(spark, folder, rows.schema), J.posts_upsert(root), checkpoint=progress)
    return J.current_posts(spark, root).select("id", "community", "score", "signals")


@query("st_run_ingest", """SELECT run_id, count(*) AS n, sum(total_purchases)::BIGINT AS sales FROM (SELECT * FROM snapshots
    QUALIFY row_number() OVER (PARTITION BY run_id, version, tech_name ORDER BY file_pos) = 1) GROUP BY 1""")
def st_run_ingest(spark, sf):
    folder, table, progress = fresh_path(spark, "landing"), fresh_path(spark, "ingested"), fresh_path(spark, "ingest-progress")
    rows = V.snapshots(spark, sf).select("run_id", "version", "tech_name", "file_pos", "price_cents", "total_purchases")
    # Every run is split over three batches.
    for part in (rows.filter(F.pmod(F.xxhash64("run_id", "tech_name", "file_pos"), F.lit(3)) == k) for k in range(3)):
        part.write.mode("append").parquet(folder)
        J.run_available(J.read_stream(spark, folder, rows.schema), J.run_ingest(table), checkpoint=progress)
    return J.current_cards(spark, table).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_purchases").alias("sales"))
