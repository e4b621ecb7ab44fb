from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stallwise.functions import match as M
from stallwise.operators import niches as N


def test_null_fields_never_match(listing):
    df = listing({"display_name": None, "summary": None}, {"display_name": "Big BOLT", "summary": None}, {"display_name": None, "summary": "a bolt"})
    assert [r[0] for r in df.filter(M.contains(["display_name", "summary"], ["bolt"])).select("app_key").orderBy("app_key").collect()] == ["k0001", "k0002"]


@pytest.mark.parametrize("name,hit", [("pos", True), ("a pos.", True), ("composite", False), ("pos_x", False), ("post", False), ("épos", False), ("POS", True)])
def test_word_mode(listing, name, hit):
    df = listing({"display_name": name, "summary": None})
    assert (df.filter(M.word(["display_name", "summary"], ["pos"])).count() == 1) is hit


def test_word_mode_takes_any_blank_between_words(listing):
    df = listing({"display_name": "field \t service", "summary": None}, {"display_name": "field", "summary": "service"}, {"display_name": "fields service", "summary": None})
    assert df.filter(M.word(["display_name", "summary"], ["field service"])).count() == 2


def test_like_keeps_wildcards(listing):
    df = listing({"tech_name": "e_invoice"}, {"tech_name": "exinvoice"}, {"tech_name": "einvoice"})
    assert df.filter(M.like(["tech_name"], ["%e_invoic%"])).count() == 2


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choice("abc é") for _ in range(rng.randint(lo, hi)))
    texts, words = sorted({word(0, 14) for _ in range(150)}), sorted({word(1, 7) for _ in range(80)})
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    w = spark.createDataFrame([(x,) for x in words], "w string")
    got = [(r["t"], r["w"]) for r in M.contains_join(t, "t", w, "w").collect()]
    assert sorted(got) == sorted((x, y) for x in texts for y in words if y in x)
    plan = M.contains_join(t, "t", w, "w")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fan_out_is_one_scan_without_python(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").withColumnRenamed("p_name", "display_name").withColumnRenamed("p_type", "summary")
    dim = [M.niche(f"n{i}", f"k{i}", "ring") for i in range(84)]
    plan = M.fan_out(df, dim).groupBy("label").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Python" not in plan
    assert "partial_count" in plan


def test_topk_per_niche_is_limited_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("display_name"), F.col("p_type").alias("summary"), F.col("p_size").alias("total_purchases"),
                                                         F.col("p_partkey").cast("string").alias("app_key"))
    plan = N.niche_topk(df, [M.niche("r", "ring")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_large_keyword_tables_are_refused_as_literals(spark):
    dim = spark.range(M.LITERAL_LIMIT + 1).select(F.lit("x").alias("label"), F.col("id").cast("string").alias("keyword"))
    with pytest.raises(ValueError):
        M.from_frame(dim)
    small = M.from_frame(dim.limit(3).withColumn("category", F.lit("c")), attrs=["category"])
    assert [(n.label, len(n.keywords), n.attrs) for n in small] == [("x", 3, {"category": "c"})]


def test_zero_matches_are_kept(listing):
    got = {r["label"]: r["listings"] for r in N.counts_keep_zero(listing({"display_name": "ring"}), [M.niche("a", "ring"), M.niche("b", "zeppelin")]).collect()}
    assert got == {"a": 1, "b": 0}


def test_fan_out_table_keeps_equal_rows(spark):
    rows = spark.createDataFrame([("Red chair", "wood"), ("Red chair", "wood"), (None, "red"), ("x", None)], "name string, note string")
    dim = spark.createDataFrame([("colour", "red"), ("stuff", "wood"), ("colour", "chair")], "label string, keyword string")
    got = sorted((r["name"] or "", r["label"]) for r in M.fan_out_table(rows, ["name", "note"], dim).collect())
    assert got == [("", "colour"), ("Red chair", "colour"), ("Red chair", "colour"), ("Red chair", "stuff"), ("Red chair", "stuff")]


def test_long_keyword_lists_give_the_same_rows(listing, monkeypatch):
    df = listing({"display_name": "Big BOLT", "summary": None}, {"display_name": None, "summary": "a bolt and a ring"}, {"display_name": "none", "summary": "x"}, {"display_name": "Big BOLT", "summary": None})
    dim = [M.niche("b", "bolt", "big"), M.niche("r", "ring"), M.niche("z", "zeppelin")]
    want = sorted((r["app_key"], r["kind"]) for r in M.fan_out(df, dim, out="kind").collect())
    monkeypatch.setattr(M, "LITERAL_LIMIT", 2)
    assert sorted((r["app_key"], r["kind"]) for r in M.fan_out(df, dim, out="kind").collect()) == want and len(want) == 4
    assert M.fan_out(df, dim, mode="word").count() == 4
