from __future__ import annotations

import json

from pyspark.sql import functions as F

from stallwise import schemas
from stallwise.operators import maintain as A, market as K
from stallwise.sources import readers as R, writers as O


def test_loading_a_run_twice_is_loading_it_once(spark, listing, tmp_path):
    path = str(tmp_path / "facts")
    old = listing({"run_id": "a"}, {"run_id": "a"})
    run = listing({"run_id": "b"}, {"run_id": "b"}, {"run_id": "b"})
    for df in (old, run, run):
        O.write_partitioned(df, path)
    assert {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"a": 2, "b": 3}


def test_latest_run_prunes_partitions(spark, listing, tmp_path):
    path = str(tmp_path / "pruned")
    O.write_partitioned(listing({"run_id": "a"}, {"run_id": "b"}), path)
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, started_at int")
    df = K.latest_run(spark.read.parquet(path), runs)
    assert [r["run_id"] for r in df.collect()] == ["b"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_stage_dedupe_keeps_the_first_and_drops_nameless(listing):
    df = listing({"tech_name": "x", "summary": "first"}, {"tech_name": "x", "summary": "second"}, {"tech_name": None}, {"version": None})
    assert [r["summary"] for r in A.stage_dedupe(df).collect()] == ["first"]


def test_merge_apps_moves_last_seen_even_back(spark):
    ddl = "app_key string, tech_name string, version string, first_seen int, last_seen int"
    old = spark.createDataFrame([("k", "t", "v", 1, 9), ("gone", "t", "v", 1, 2)], ddl)
    new = spark.createDataFrame([("k", "t", "v"), ("n", "t", "v")], "app_key string, tech_name string, version string")
    got = {r["app_key"]: (r["first_seen"], r["last_seen"]) for r in A.merge_apps(old, new, F.lit(5)).collect()}
    assert got == {"k": (1, 5), "gone": (1, 2), "n": (5, 5)}


def test_surrogate_ids_are_dense_and_follow_the_maximum(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"))
    ids = sorted(r["snapshot_id"] for r in A.surrogate_ids(F.lit(40), rows, "k").collect())
    assert ids == list(range(41, 541))


def test_upsert_twice_only_updates(spark):
    ddl = "id int, community string, score int, num_comments int, last_seen int, signals string"
    old = spark.createDataFrame([(1, "a", 1, 1, 1, "x"), (2, "a", 1, 1, 1, "x")], ddl)
    pull = spark.createDataFrame([(2, "b", 7, 7, 7, "y"), (3, "b", 7, 7, 7, "y")], ddl)
    once = A.upsert_posts(old, pull)
    assert tuple(A.change_counts(once).first()) == (1, 1)
    again = A.upsert_posts(once.drop("change"), pull)
    assert tuple(A.change_counts(again).first()) == (0, 2)
    assert {tuple(r)[:3] for r in again.collect()} == {(1, "a", 1), (2, "a", 7), (3, "b", 7)}


def test_best_row_prefers_sales_then_version_text(listing):
    df = listing({"tech_name": "x", "total_purchases": 5, "version": "9.0"}, {"tech_name": "x", "total_purchases": 5, "version": "17.0"},
                 {"tech_name": "x", "total_purchases": None, "version": "99.0"}, {"tech_name": "y", "total_purchases": None, "version": "1.0"})
    assert {r["tech_name"]: r["version"] for r in K.best_per_app(df).collect()} == {"x": "9.0", "y": "1.0"}


def test_cards_from_a_pretty_printed_array(spark, tmp_path):
    f = tmp_path / "apps.json"
    f.write_text(json.dumps([{"tech_name": "a", "version": "1", "price_cents": 5_000_000_000}, {"tech_name": "b"}], indent=2))
    got = R.read_cards(spark, str(f)).orderBy("tech_name").collect()
    assert [(r["tech_name"], r["price_cents"]) for r in got] == [("a", 5_000_000_000), ("b", None)]


def test_run_meta(spark, tmp_path):
    (tmp_path / "run.json").write_text('{"run_id": "r", "started_at": "2026-05-08T18:00:21Z"}\n{"run_id": "s", "started_at": "2026-05-08T20:00:21+02:00", "finished_at": "2026-05-08T19:00:00Z"}')
    got = R.read_run_meta(spark, str(tmp_path / "run.json")).select("run_id", F.date_format("started_at", "HH:mm:ss").alias("s"), F.col("finished_at").isNull().alias("open")).collect()
    assert [tuple(r) for r in got] == [("r", "18:00:21", True), ("s", "18:00:21", False)]


def test_video_lines(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("t\tid1\t10\t61.7\t20240101\nshort\tline\n\nt\tid2\tNA\tNA\tNA\textra\nt\tid3\tx\t\t20240101\n")
    got = R.read_videos_tsv(spark, str(tmp_path / "v.tsv"), "u/").collect()
    assert [(r["id"], r["views"], r["duration_s"], r["url"]) for r in got] == [("id1", 10, 61, "u/id1"), ("id2", 0, 0, "u/id2"), ("id3", 0, 0, "u/id3")]


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", twice\nnext')], "partner_id string, name string")
    O.append_csv(df, str(tmp_path / "c"), ["partner_id", "name"])
    assert R.read_csv(spark, str(tmp_path / "c"), "partner_id string, name string").first()["name"] == 'say "hi", twice\nnext'


def test_missing_table_is_created_empty(spark):
    assert A.widen(spark, None, schemas.SCORE).count() == 0


def test_arrays_are_written_by_tasks_of_bounded_size(spark, tmp_path):
    import json
    from stallwise.plans import q_tables as Q
    lines = spark.range(25).select(F.to_json(F.struct(F.col("id").alias("b"))).alias("value"))
    Q.write_arrays(lines, str(tmp_path / "many"), at_most=10)
    many = [json.loads(f.read_text()) for f in (tmp_path / "many").rglob("*.txt")]
    assert len(many) == 3 and all(a[-1] == {} for a in many) and sorted(r["b"] for a in many for r in a[:-1]) == list(range(25))
    Q.write_arrays(lines, str(tmp_path / "one"), at_most=25)
    assert len(list((tmp_path / "one").rglob("*.txt"))) == 1
    assert sorted(r["b"] for r in Q.read_json_array(spark, str(tmp_path / "many"), "b bigint").filter("b is not null").collect()) == list(range(25))


def test_partner_profiles_are_stored_compressed(spark, sf, tmp_path, monkeypatch):
    from stallwise.plans import q_tables as Q
    monkeypatch.setattr(Q, "fresh_path", lambda spark, name: str(tmp_path / name))
    Q.src_partner_json(spark, sf)
    stored = [f.name for f in (tmp_path / "profiles").iterdir() if f.name.startswith("part-")]
    assert stored and all(f.endswith(".json.gz") for f in stored)
