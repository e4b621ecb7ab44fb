from __future__ import annotations

import random

import pytest

from stallwise.functions import rareindex as R


@pytest.mark.parametrize("at_once", [100_000, 7])
def test_found_words_equal_brute_force(spark, at_once):
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choice("abc é") for _ in range(rng.randint(lo, hi)))
    texts = sorted({word(0, 14) for _ in range(100)} | {word(200, 900) for _ in range(10)})
    words = sorted({word(1, 7) for _ in range(80)} | {word(20, 30) for _ in range(5)} | {t[250:280] for t in texts if len(t) > 280} | {t[-9:] for t in texts[-5:]})
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(-1, None)], "id int, t string")
    w = spark.createDataFrame([(x,) for x in words] * 2 + [(None,), ("",), (R.PAD + "a",)], "w string")
    got = [(r["id"], r["w"]) for r in R.found_words(t, ["id"], "t", w, "w", at_once).collect()]
    assert sorted(got) == sorted((i, y) for i, x in enumerate(texts) for y in words if y and y in x)


def test_no_words_and_no_texts(spark):
    t, w = spark.createDataFrame([(1, "abc")], "id int, t string"), spark.createDataFrame([("abcd",)], "w string")
    assert R.found_words(t, ["id"], "t", w.limit(0), "w").count() == 0
    assert R.found_words(t.limit(0), ["id"], "t", w, "w").count() == 0


def test_texts_are_not_shuffled(spark):
    t, w = spark.createDataFrame([(1, "some text")], "id int, t string"), spark.createDataFrame([("text",)], "w string")
    plan = R.found_words(t, ["id"], "t", w, "w")._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "_win" not in line and "t#" not in line.replace("hint", "")
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_words_are_looked_for_in_distinct_runs(spark, monkeypatch):
    """Runs of many texts are scanned once; words with blanks and long runs still meet whole texts."""
    scanned = []
    old = R._scanned
    monkeypatch.setattr(R, "_scanned", lambda texts, *a: scanned.append(texts.count()) or old(texts, *a))
    t = spark.createDataFrame([(i, f"same running, words {i % 3} and more") for i in range(50)] + [(50, "x" * 700 + "running" + "y" * 700)], "id int, t string")
    w = spark.createDataFrame([("running",), ("unni",), ("d mor",), ("absent",)], "w string")
    got = sorted((r["w"], r["id"]) for r in R.found_words(t, ["id"], "t", w, "w").collect())
    assert got == [("d mor", i) for i in range(50)] + [("running", i) for i in range(51)] + [("unni", i) for i in range(51)]
    assert scanned == [4, 1, 51]
