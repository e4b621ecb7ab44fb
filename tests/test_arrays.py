from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from stallwise.sources import arrays as A

SCHEMA = "a string, b bigint, c struct<d: array<string>, e: double>"


def records(n, rng):
    odd = ['}', '{', '"', '\\', '[', ']', 'é', '\n', '\\"}', '{"x": "}"}', '日本', ' , ', '']
    text = lambda: "".join(rng.choice(odd + list("abc ")) for _ in range(rng.randint(0, 12)))
    return [{"a": text(), "b": rng.randint(0, 99), "c": {"d": [text() for _ in range(rng.randint(0, 3))], "e": rng.random()}} for _ in range(n)]


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("indent,ascii_only", [(2, False), (None, True), (None, False)])
@pytest.mark.parametrize("size", [150, 1 << 20])
def test_same_rows_as_one_task(spark, tmp_path, small_splits, indent, ascii_only, size):
    rng = random.Random(size)
    for k, n in enumerate((40, 0, 1)):
        (tmp_path / f"f{k}.json").write_text(json.dumps(records(n, rng), indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    want = sorted(map(str, spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path)).collect()))
    small_splits(size)
    got = A.read_json_array(spark, str(tmp_path), SCHEMA)
    assert sorted(map(str, got.drop("_file", "_pos").collect())) == want and len(want) == 41
    text = {f"f{k}.json": (tmp_path / f"f{k}.json").read_bytes() for k in range(3)}
    for r in got.collect():
        at = text[r["_file"].rsplit("/", 1)[1]][r["_pos"]:]
        assert json.JSONDecoder().raw_decode(at.decode("utf-8"))[0]["a"] == r["a"]
    if size == 150:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.text(max_size=5) | st.integers(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=10), st.integers(0, 50))
def test_states_chain_wherever_a_text_is_cut(value, cut):
    text = json.dumps([{"v": value}, {"w": 1}], ensure_ascii=False)
    pieces = [p + "}" for p in text.split("}")]
    cut %= len(pieces) + 1
    rows = []
    for block, part in enumerate((pieces[:cut], pieces[cut:])):
        s = A._Summary()
        for p in part:
            s.add(p)
        rows.append({"file": "f", "block": block, "bytes": s.bytes, "quoted": s.quoted, "depth": s.depth, "level": [list(e) for e in s.entered], "place": [list(e.values()) for e in s.entered]})
    _, _, first, quoted, depth, opened = A.chained(rows)[1]
    before = "".join(pieces[:cut])
    states = [(False, 0), *((q, d) for _, q, d in A.walk(before, False, 0))]
    assert (quoted, depth) == states[-1] and first == len(before.encode())
    assert (opened >= 0) == (depth >= 2)
