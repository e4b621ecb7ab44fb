"""SimHash groups, cosine groups and nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stallwise.llm import ann, components, cosine_dups, queries, simhash
from stallwise.llm.common import table

SF = "/root/testdata/sf0.01"


def closure(keys, pairs):
    """Smallest key that each key reaches."""
    least = {k: k for k in keys}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                moved = True
    return least


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    parts = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", " ", "\t", "\x0b", "\x1c", "\xa0", "\x85", "É", "日", "c d", "İ"]), max_size=30).map("".join))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_long_texts_count_every_shingle():
    text = " ".join(f"w{i % 977} q{i % 31}" for i in range(20_000))
    assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_anchors_lose_no_link(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 60, np.int64)
    values = set(base.tolist()) | {0, -1}
    for v in base.tolist():
        for _ in range(4):
            u = v & ((1 << 64) - 1)
            for b in rng.choice(64, rng.integers(1, distance + 3), replace=False):
                u ^= 1 << int(b)
            values.add(u - (1 << 64) if u >> 63 else u)
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance}
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "simhash long"), distance).distinct().collect()
    assert {(r["a"], r["b"]) for r in got} == want


def test_simhash_query_is_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, SF).collect()}
    docs = {r["doc_id"]: plain_print(r["text"] or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == docs
    ids = sorted(docs)
    values = np.array([docs[i] for i in ids], np.uint64)
    pairs = [(ids[i], ids[i + 1 + int(j)]) for i in range(len(ids)) for j in np.nonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= 2)[0]]
    assert {k: r["component_id"] for k, r in got.items()} == closure(ids, pairs)


def test_simhash_edges(spark):
    rows = [(5, None, "u"), (6, "", "v"), (3, " \t", "w"), (9, "one two three four", "x"), (9, "one two three four", "y"), (None, "One two THREE four", "z"), (8, "q", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, simhash string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 9), (3, 3), (5, 3), (6, 3), (8, 8), (9, 9), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
@example([(0, 0), (1, 2)])
def test_components(spark, edges):
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in closure(nodes, [(a, b) for a, b in edges if a != b]).items() if k in nodes}


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * 0.05 * (i // 12)).tolist(), "ab"[i % 2]) for i in range(96)]
    odd = [(200, None, "a"), (201, [0.0] * 16, "a"), (202, [1.0, None] + [0.0] * 14, "a"), (203, [float("nan")] * 16, "a"), (204, base[0].tolist(), None),
           (205, [float("inf")] + [1.0] * 15, "a"), (206, [1.0, 2.0], "a"), (207, [], "b"), (208, rows[0][1], "a"), (209, rows[0][1], "a")]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string"), rows + odd


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [1024, 3])
def test_cosine_groups_are_brute_force(spark, block):
    df, rows = vectors(spark)
    usable = [(i, np.array(v), lab) for i, v, lab in rows if good(v) and lab is not None]
    pairs = [(a[0], b[0]) for n, a in enumerate(usable) for b in usable[n + 1:]
             if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93]
    assert len(pairs) > 100
    least = closure([r[0] for r in rows], pairs)
    got = cosine_dups.near_duplicates(df, tables=96, block=block).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == least
    assert all(r["n_links"] == sum(r["vec_id"] in p for p in pairs) and r["kept"] == (least[r["vec_id"]] == r["vec_id"]) for r in got)
    assert cosine_dups.near_duplicates(df.limit(0)).count() == 0


def best(rows, k=20):
    usable = [(i, np.array(v)) for i, v in rows if good(v) and len(v) == 16]
    return {q: sorted(((-float(x @ y), j) for j, y in usable if j != q))[:k] for q, x in usable if q % 20 == 0}


def test_nearest_neighbours(spark):
    df, rows = vectors(spark)
    got = ann.search(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    want = best([(i, v) for i, v, _ in rows])
    assert {r["query_id"] for r in got} == set(want)
    found = {q: [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q] for q in want}
    hits = sum(len({j for j, _ in found[q]} & {j for _, j in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    by = {i: np.array(v, float) for i, v, _ in rows if good(v)}
    assert all(s == pytest.approx(float(by[q] @ by[j]), rel=1e-12) for q in found for j, s in found[q])
    assert all(f == sorted(f, key=lambda p: (-p[1], p[0])) for f in found.values())
    assert all([r["rank"] for r in got if r["query_id"] == q] == list(range(1, len(found[q]) + 1)) for q in want)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf):
    got = queries.op4_nearest(spark, sf).collect()
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").filter(F.col("embedding").isNotNull()).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for n in np.nonzero(ids % 20 == 0)[0]:
        score = x @ x[n]
        score[n] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits, total = hits + len(want & found[ids[n]]), total + len(want)
    assert len(found) == (ids % 20 == 0).sum() and hits / total >= 0.9
