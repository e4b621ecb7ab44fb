"""Toxicity and quality: held-out accuracy, scores against a plain reading of the model, edges."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import quality, queries, toxicity
from stallwise.llm.common import held_out, labelled_sample, table

FIT = [("you are a stupid clown and a moron", 1), ("what a worthless pathetic idiot", 1), ("the boat left the quiet harbour", 0),
       ("a recipe for bread and soup", 0), ("", 0), ("total trash you loser", 1), ("rain fell on the hills", 0)] * 12
TEXTS = ["", None, "   ", "stupidd morron", "word " * 40_000, "same text", "same text", "\x00 é 日本 🙂"]


def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string")


def plain_toxicity(model, text):
    """Every window of words, one n-gram bag at a time."""
    values = []
    for field in text.split():
        ids, _ = toxicity.subwords([toxicity.bare(field)], len(model.embeddings))
        values.append(float(np.mean((model.embeddings[ids] @ (model.softmax[:, 1] - model.softmax[:, 0])).astype(np.float64))))
    shift = float(model.bias[1] - model.bias[0])
    if not values:
        return 1 / (1 + np.exp(-shift))
    a, b = toxicity.window_ends(len(values), model.window)
    return 1 / (1 + np.exp(-(max(np.mean(values[i:j]) for i, j in zip(a, b, strict=True)) + shift)))


def test_toxicity_scores_and_edges(spark):
    model = toxicity.fit(FIT)
    rows = toxicity.score(frame(spark), model).orderBy("doc_id").collect()
    assert [r["score"] for r in rows] == ["x"] * len(TEXTS)
    for r in rows:
        assert r["toxicity"] == pytest.approx(plain_toxicity(model, r["text"] or ""), abs=1e-6)
    assert rows[3]["toxicity"] > 0.5 > rows[5]["toxicity"] == rows[6]["toxicity"]
    assert toxicity.score(frame(spark).limit(0), model).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(frame(spark), model, out="score")


def test_misspellings_share_ngrams():
    model = toxicity.fit(FIT)
    scorer = model.scorer()
    assert scorer.score("you stuppid morronn") > 0.5 > scorer.score("the boats left the harbours")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_one_class_or_no_rows(spark, module):
    for sample in ([], [("a b", 0)] * 5):
        rows = module.score(frame(spark), module.fit(sample)).collect()
        assert all(0 <= r[-1] < 0.6 for r in rows) and len(rows) == len(TEXTS)


def test_quality_scores_and_edges(spark):
    sample = [("The old mill stood by the river, and people came.", 1), ("buy buy buy CLICK http://x !!! 11 22 33", 0)] * 20
    model = quality.fit(sample)
    rows = quality.score(frame(spark), model).orderBy("doc_id").collect()
    for r in rows:
        found = quality.Indicators(len(model.weights)).of([r["text"] or ""])[0]
        assert r["quality_score"] == pytest.approx(model.probability(found), abs=1e-12)
    assert rows[0]["quality_score"] == rows[1]["quality_score"] == rows[2]["quality_score"]
    assert quality.score(frame(spark).limit(0), model).count() == 0


def test_dual_coordinate_descent_meets_the_margin():
    """Separable rows: all lie on their side of the margin, and the weights come from the rows."""
    sample = [(f"good{i % 7} fine{i % 3}", 1) for i in range(30)] + [(f"BAD{i % 7} 99{i % 3}", 0) for i in range(30)]
    model = quality.fit(sample)
    found = quality.Indicators(len(model.weights)).of([t for t, _ in sample])
    margins = np.array([model.margin(f) * (1 if y else -1) for f, (_, y) in zip(found, sample, strict=True)])
    assert margins.min() > 0.5


def test_fold_and_sample(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(7, "again"), (None, "n")], "doc_id long, text string")
    fold = {r[0]: r[1] for r in docs.select("doc_id", held_out().alias("h")).collect()}
    assert all(fold[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 1000, 100)
    ids = {int(t[1:]) for t, _ in rows if t != "again"}
    assert ids == {i for i in range(200) if not fold[i]} - {3} and len(labelled_sample(docs, labels, "toxic", 9, 100)) == 9


@pytest.mark.parametrize("name, label, cut, least", [("op2_toxicity", "toxic", 0.5, 0.95), ("op7_quality", "quality", 0.3, 0.97)])
def test_held_out_accuracy(spark, name, label, cut, least):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.schema["predicted"].dataType.typeName() == "integer"
    rows = got.join(table(spark, sf, "labels").select("doc_id", label), "doc_id").filter("held_out").select("score", "predicted", F.col(label).alias("y")).collect()
    assert all(r["predicted"] == int(r["score"] >= cut) for r in rows)
    assert sum(r["predicted"] == r["y"] for r in rows) / len(rows) >= least
