"""Spelling variants against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from compare import differences, duck
from hypothesis import given, settings, strategies as st

from stallwise.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("letters,leaf,pairs", [("ab", 1, 5), ("abcé", 4, 1000), ("abcdefgÿ", 32, 1000)])
def test_search_finds_every_pair_once(monkeypatch, letters, leaf, pairs):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    rng = random.Random(leaf)
    for size in (1, 3, 7):
        a, b = (sorted({"".join(rng.choice(letters) for _ in range(n)) for _ in range(200)}) for n in (size, size + 1))
        for other in (a, b):
            got = [p for i, j in spelling.near(a, other) for p in zip(i.tolist(), j.tolist(), strict=True)]
            assert len(got) == len(set(got))
            assert set(got) == {(i, j) for i, x in enumerate(a) for j, y in enumerate(other) if one_edit(x, y)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=1, max_size=40), st.integers(1, 8))
def test_every_point_within_reach_is_visited(rows, leaf):
    points = np.zeros((len(rows), spelling.LETTERS))
    points[:, :4] = rows
    tree = spelling.grown(points, leaf)
    row, where = tree.visits(points, 0, 0)
    home = dict(zip(row.tolist(), where.tolist(), strict=True))
    assert sorted(home) == list(range(len(rows)))
    seen = set(zip(*(x.tolist() for x in tree.visits(points, 1, 1)), strict=True))
    for i, p in enumerate(points):
        for j, q in enumerate(points):
            step = q - p
            if (step == 1).sum() <= 1 and (step == -1).sum() <= 1 and np.abs(step).max() <= 1:
                assert (i, home[j]) in seen


def brute(words):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, n, form[w] or "", words[form[w]] if form[w] else 0, root(w), len(near[w])) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["n"], r["form"] or "", r["form_n"] or 0, r["root"], r["n_near"]) for r in df.collect())


def test_variants_equal_brute_force_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PER_CELL", 4)
    rng = random.Random(5)
    # One class of counts (the shuffles of a word) holds a third of all words, so its cell is cut into blocks.
    words = {"".join(rng.sample("aabbccdd", 8)) for _ in range(150)} | {"".join(rng.choice("abcdé") for _ in range(rng.randint(7, 9))) for _ in range(300)} | {"z" * 3000, "z" * 3001}
    counted = {w: 10 ** rng.randint(0, 5) for w in sorted(words)}
    table = spark.createDataFrame([(w, n, 1, "x") for w, n in counted.items()] + [(None, 3, 1, "x")], "word string, n long, n_near int, best string")
    assert rows_of(spelling.variants(table, cell=30)) == brute(counted)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query_equals_sql(spark):
    assert differences(queries.op11_spelling(spark, SF), duck(SF), queries.ORACLES["op11_spelling"]) is None


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (None, "Longword longword"), (2, ""), (2, "ÀÉÎÕÜàé " * 3), (3, "short wordsß7letters" + " x" * 50_000)], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in queries.misspelled_words(docs).collect()}
    assert got.get("ÀÉÎÕÜàé") == 3 and "longword" in got and all(len(w) >= 7 for w in got)
