from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.operators import maintain as A
from stallwise.streaming import jobs as J

POST = "id int, community string, score int, num_comments int, last_seen int, signals string"


def land(spark, folder, rows, ddl):
    spark.createDataFrame(rows, ddl).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_dedupe_drops_copies_and_late_rows_across_batches(spark, tmp_path):
    folder, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    ddl = "id int, ts string"
    batches = [[(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:05:00"), (2, "2024-01-01 12:00:00")],
               [(2, "2024-01-01 12:00:30"), (3, "2024-01-01 09:00:00"), (4, "2024-01-01 11:30:00")]]
    for rows in batches:
        land(spark, folder, rows, ddl)
        J.run_available(J.dedupe(J.read_stream(spark, folder, "id int, ts timestamp"), "id", "ts"), path=out, checkpoint=progress)
    # 3 is older than the watermark (12:00 less one hour) when it arrives; 4 is not.
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_window_counts_equal_batch_over_two_runs(spark, tmp_path):
    folder, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    for rows in ([("a", "2024-01-01 10:00:00"), ("a", "2024-01-02 01:00:00")], [("a", "2024-01-02 02:00:00"), ("b", "2024-01-02 03:00:00")]):
        land(spark, folder, rows, "kind string, ts string")
        counts = J.window_counts(J.read_stream(spark, folder, "kind string, ts timestamp"), "kind", "ts", "1 day")
        J.run_available(counts, J.keep_updates(out), mode="update", checkpoint=progress)
    got = {(r["kind"], r["window"]["start"].day): r["n"] for r in J.latest_updates(spark, out, ["window", "kind"], "n").collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("b", 2): 1}


def test_upsert_is_the_batch_merge_and_survives_repeats(spark, tmp_path):
    root, compact = str(tmp_path / "posts"), str(tmp_path / "compact")
    old = spark.createDataFrame([(1, "a", 1, 1, 1, "x"), (2, "a", 1, 1, 1, "x")], POST)
    pull = spark.createDataFrame([(2, "b", 7, 7, 7, "y"), (3, "b", 7, 7, 7, "y")], POST)
    sink = J.posts_upsert(root)
    for number, rows in ((0, old), (1, pull), (1, pull)):
        sink(rows.withColumn("pulled", F.lit(number)), number)
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "community", "score", "num_comments", "last_seen", "signals").collect())
    want = rows(A.upsert_posts(old, pull))
    assert rows(J.current_posts(spark, root)) == want
    J.compact_posts(spark, root, compact)
    J.posts_upsert(compact)(pull.withColumn("pulled", F.lit(2)), 2)
    assert rows(J.current_posts(spark, compact)) == want


def test_a_run_in_many_batches_is_whole(spark, tmp_path):
    root = str(tmp_path / "cards")
    ddl = "run_id string, version string, tech_name string, file_pos int, price_cents int"
    sink = J.run_ingest(root)
    for number, rows in enumerate([[("r", "1", "a", 5, 50)], [("r", "1", "b", 2, 20), ("r", None, "c", 3, 0)], [("r", "1", "a", 1, 10), ("r", "1", "a", 9, 90)]]):
        for _ in range(2):
            sink(spark.createDataFrame(rows, ddl), number)
    assert sorted((r["tech_name"], r["price_cents"]) for r in J.current_cards(spark, root).collect()) == [("a", 10), ("b", 20)]


def test_pulls_in_one_batch_or_many_give_the_same(spark, tmp_path):
    pulls = [(1, "a", 1, 1, 1, "x", 0), (1, "b", 7, 7, 7, "y", 1), (2, "c", 2, 2, 2, "z", 1)]
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    ddl = POST + ", pulled int"
    J.posts_upsert(one)(spark.createDataFrame(pulls, ddl), 0)
    for number, row in enumerate(reversed(pulls)):
        J.posts_upsert(many)(spark.createDataFrame([row], ddl), number)
    got = [sorted((r["id"], r["community"], r["score"]) for r in J.current_posts(spark, path).collect()) for path in (one, many)]
    assert got[0] == got[1] == [(1, "a", 7), (2, "c", 2)]


def test_live_sessions_join_and_retract(spark, tmp_path):
    """A late event joins two sessions that came out provisionally; closed ones are final, the last stays open."""
    from pyspark.sql import functions as F
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = "u int, ts string"
    batches = [[(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:40:00"), (2, "2024-01-01 00:10:00")], [(1, "2024-01-01 00:50:00")], [(1, "2024-01-01 09:00:00"), (3, "2024-01-01 09:30:00")]]
    for rows in batches:
        spark.createDataFrame(rows, ddl).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("u int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    J.run_available(J.live_sessions(stream, "u", "ts", 3600, "2 hours"), sink=J.keep_updates(out), mode="update")
    got = sorted((r["u"], str(r["start"])[11:16], str(r["last"])[11:16], r["n"]) for r in J.latest_sessions(spark, out, "u").collect())
    assert got == [(1, "00:00", "01:40", 3), (1, "09:00", "09:00", 1), (2, "00:10", "00:10", 1), (3, "09:30", "09:30", 1)]


def test_spans_merge_in_any_order():
    assert J.merged_sessions([(10, 12, 2), (0, 1, 1), (5, 6, 1), (3, 3, 1)], 2) == [(0, 6, 3), (10, 12, 2)]


def test_users_of_a_group_share_a_call(spark, tmp_path):
    """All users in one group of state, a null one too: the same sessions as with a group for each."""
    folder, ddl = str(tmp_path / "in"), "u long, ts string"
    batches = [[(u, f"2024-01-01 0{h}:00:00") for u in (1, 2, 2**60 + 1, None) for h in (0, 3)], [(2, "2024-01-01 03:30:00"), (None, "2024-01-01 09:00:00"), (7, "2024-01-01 09:00:00")]]
    for rows in batches:
        land(spark, folder, rows, ddl)
    for groups in (1, 50):
        out = str(tmp_path / f"out{groups}")
        stream = spark.readStream.schema("u long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        J.run_available(J.live_sessions(stream, "u", "ts", 3600, "2 hours", groups), sink=J.keep_updates(out), mode="update")
        got = {(r["u"], str(r["start"])[11:16], str(r["last"])[11:16], r["n"]) for r in J.latest_sessions(spark, out, "u").collect()}
        each = {(u, t, t, 1) for u in (1, 2, 2**60 + 1, None) for t in ("00:00", "03:00")} - {(2, "03:00", "03:00", 1)}
        assert got == each | {(2, "03:00", "03:30", 2), (None, "09:00", "09:00", 1), (7, "09:00", "09:00", 1)}
