"""The recurrent network: gradients by differences, reading byte by byte, and held-out accuracy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import language as L, queries
from stallwise.llm.common import table

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = L.initial(3, 4, rng, np.float64)
    size = np.array([7, 5, 1, 3])
    codes, label = L.windows(rng.integers(0, 256, 200).astype(np.uint8), np.array([0, 50, 90, 100]), size), np.arange(4)
    _, g = L.loss_and_gradients(w, codes, size, label)
    for name, values in w.items():
        places = [tuple(i) for i in np.argwhere(g[name] != 0)]
        assert places
        for i in places[:: max(1, len(places) // 25)]:
            values[i] += 1e-6
            more = L.loss_and_gradients(w, codes, size, label)[0]
            values[i] -= 2e-6
            less = L.loss_and_gradients(w, codes, size, label)[0]
            values[i] += 1e-6
            assert g[name][i] == pytest.approx((more - less) / 2e-6, abs=1e-7)


def plain(model: L.LanguageModel, raw: bytes) -> np.ndarray:
    """Window by window, byte by byte, as the equations are written."""
    w, hidden = model.weights, model.weights["recur"].shape[1]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    total = np.zeros(len(model.langs))
    for at in range(0, len(raw), L.WINDOW):
        part = raw[at: at + L.WINDOW]
        states = []
        for d, order in enumerate((range(len(part)), range(len(part) - 1, -1, -1))):
            h, found = np.zeros(hidden), {}
            for k in order:
                x, u = w["table"][d][part[k]].astype(float), h @ w["recur"][d]
                z, r = sigmoid(x[:hidden] + u[:hidden]), sigmoid(x[hidden: 2 * hidden] + u[hidden: 2 * hidden])
                c = np.tanh(x[2 * hidden:] + r * u[2 * hidden:])
                h = (1 - z) * c + z * h
                found[k] = h
            states.append(found)
        for k in range(len(part)):
            logits = states[0][k] @ w["out"][0] + states[1][k] @ w["out"][1] + w["bias"]
            p = np.exp(logits - logits.max())
            total += p / p.sum()
    return total / len(raw)


def test_texts_are_read_whole_and_as_written(spark):
    rng = np.random.default_rng(1)
    model = L.LanguageModel(["a", "b", "c"], L.initial(4, 3, rng))
    texts = ["x", "Grüße, Welt!", "ab " * 100, "é" * 64, "日本語" * 50, "mixed 123 ", None, "", "12 34 --", "y" * 300_000 + "é"]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, "x", "k")], "doc_id int, text string, _read string")
    got = L.predict(rows, model).collect()
    assert len(got) == len(texts) + 1 and set(got[0].asDict()) == {"doc_id", "text", "_read", "lang_pred", "score"}
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(r["text"]) < 1000:
            want = plain(model, r["text"].encode())
            assert r["lang_pred"] == model.langs[want.argmax()] and r["score"] == pytest.approx(want.max(), abs=1e-4)
    with pytest.raises(ValueError):
        L.predict(rows.withColumn("score", F.lit(1)), model)
    assert L.predict(rows.limit(0), model).count() == 0


def test_few_languages(spark):
    rows = spark.createDataFrame([(1, "abc")], "doc_id int, text string")
    assert [tuple(r)[2:] for r in L.predict(rows, L.fit([])).collect()] == [("und", 0.0)]
    assert [r["lang_pred"] for r in L.predict(rows, L.fit([(b"abc", "xx")])).collect()] == ["xx"]


def test_sample_leaves_the_held_out_fold_and_unlabelled_rows_out(spark):
    import zlib

    rows = [(i, f"text {i} " * 40, "en" if i % 3 else None) for i in range(60)] + [(7, "text", "fr"), (None, "text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {b.split()[1] for b, lang in L.sample(docs, per_text=1) if lang == "en"}
    want = {str(i).encode() for i in range(60) if i % 3 and zlib.crc32(str(i).encode()) % 5 and i != 7}
    assert found == want
    assert len({b for b, _ in L.sample(docs, max_rows=5, per_text=1)}) == 5


def test_held_out_accuracy(spark):
    got = queries.op13_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
