"""Token tables, packing, token files and pieces against the libraries themselves."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallwise.llm import chunks, packing, pieces, token_orc
from stallwise.session import fresh_path

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER, MODEL = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=SP)
HARD = st.lists(st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "\x1c", "▁", "a", "the", "The.", "!!", "%%%", ".&&&", ",", "'s", "'", "12", "é", "日本", "🙂", "<|endoftext|>", "<s>", "</s>", "\x00", "ﬁ", "́"]), max_size=14).map("".join)
TEXTS = ["", None, " ", "a", "  a  b ", "x\n\n y", "long " * 30_000, "z" * 5_000, "same", "same"]


@settings(max_examples=600, deadline=None)
@given(HARD)
def test_bpe_table_is_the_library(text):
    assert np.frombuffer(chunks.byte_bpe(BPE).ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(HARD)
def test_pieces_table_is_the_library(text):
    assert np.frombuffer(chunks.sentence_pieces(SP).ids(text), "<u4").tolist() == MODEL.encode(text)


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(chunks, "TABLE", 3)
    table = chunks.ByteBpe(BPE)
    for text in ("a b c d e f", "g h a b", "b a h g x y z", "a"):
        assert np.frombuffer(table.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_long_fields_fill_the_table_too(monkeypatch):
    monkeypatch.setattr(chunks, "TABLE_CHARS", 100)
    table = chunks.ByteBpe(BPE)
    for text in ("z" * 200 + " a b", "c " + "y" * 300 + "!!!!!!!!!!!!", "a b c"):
        assert np.frombuffer(table.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert table.rest.chars < 100


class Counting:
    """The library, and how many characters its texts had."""

    def __init__(self, library):
        self.library, self.chars = library, 0

    def _counted(self, texts):
        self.chars += sum(map(len, texts))

    def encode(self, text, **how):
        self._counted([text])
        return self.library.encode(text, **how)

    def encode_batch_fast(self, texts, **how):
        self._counted(texts)
        return self.library.encode_batch_fast(texts, **how)


def test_texts_with_doubled_blanks_are_cut_too():
    table = chunks.ByteBpe(BPE)
    table.tokenizer = counting = Counting(table.tokenizer)
    text = "One  more line,\n\nand a café; naïve!!!\nThen\n  some\tmore. " * 300
    assert np.frombuffer(table.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert counting.chars < 300


def test_words_are_segmented_once_whatever_ends_their_line():
    table = chunks.ByteBpe(BPE)
    words = [f"w{'abcdefghij'[k // 10]}{'klmnopqrst'[k % 10]}" for k in range(100)]
    text = " ".join(f"{a}.\n{b}" for a in words for b in words)
    assert np.frombuffer(table.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert len(table.rest.ids) <= 2 * len(words) + 3


ODD = st.lists(st.sampled_from([" ", "\n", "\t", "\r\n", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "a", "The", "é", "×", "ß", "Ж", "日", "”", "—", "µ", "ʰ", ".", "!!", ";", "'s", "7", "<|endoftext|>", None]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=5), st.sampled_from([pa.string(), pa.large_string()]), st.integers(0, 2))
def test_columns_of_texts_are_cut_as_single_ones(made, kind, skip):
    texts = [None if None in t else "".join(t) for t in made]
    ids, bounds = chunks.with_end(*chunks.byte_bpe(BPE).rows(pa.array(texts, kind).slice(skip)), 0)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [[*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0] for t in texts[skip:]]


def test_checksums_without_ids(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    with_ids, without = packing.cut(docs, BPE), packing.cut(docs, BPE, ids=False)
    assert "ids" not in without.columns and with_ids.filter(F.crc32("ids") != F.col("ids_crc32")).count() == 0
    assert sorted(without.collect()) == sorted(with_ids.drop("ids").collect())


def one_by_one(lengths, size):
    """Best fit decreasing, piece by piece: how full each window is."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(size - n)
    return Counter(size - r for r in room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_best_fit_is_that_of_single_pieces(lengths):
    windows: dict[int, list] = {}
    for length, number, n, each, first, offset in packing.best_fit(Counter(lengths), 24).tolist():
        for k in range(n):
            windows.setdefault(first + k // each, []).append((offset + k % each * length, length))
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
    assert Counter(sum(n for _, n in p) for p in windows.values()) == one_by_one(lengths, 24)
    assert sorted(windows) == list(range(len(windows)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i - 1 if i else None, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int").repartition(3)


def test_packing(spark, docs):
    placed = packing.place(packing.cut(docs, BPE)).collect()
    by_doc: dict = {}
    for r in placed:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        want = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]
        got = sorted(by_doc[i - 1 if i else None], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in got), "<u4").tolist() == want
        assert all(r["doc_tokens"] == len(want) and len(r["ids"]) == 4 * r["length"] for r in got)
    rows = packing.sequences(packing.place(packing.cut(docs, BPE))).collect()
    assert all(len(r["ids"]) // 4 in {1024, *(1 << k for k in range(10))} for r in rows)
    assert packing.place(packing.cut(docs.limit(0), BPE)).count() == 0


def test_pieces_of_a_batch_are_those_of_each_text(spark, docs):
    got: dict = {}
    for r in packing.cut(docs, BPE, size=7, end_id=None).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])))
    for i, t in enumerate(TEXTS):
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids
        parts = [(a, np.array(ids[a: a + 7], "<u4").tobytes()) for a in range(0, len(ids), 7)]
        assert sorted(got.get(i - 1 if i else None, [])) == [(a, len(p) // 4, len(ids), zlib.crc32(p), p) for a, p in parts]


def test_many_equal_lengths_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11 + 1).cast("long").alias("length"))
    seen = Counter()
    for r in packing.place(df, size=16).collect():
        seen.update((r["sequence_id"], r["offset"] + k) for k in range(r["length"]))
    assert max(seen.values()) == 1
    fill = Counter(s for s, _ in seen)
    assert all(max(o for s2, o in seen if s2 == s) + 1 == n <= 16 for s, n in fill.items())


def test_token_files(spark, docs):
    target = fresh_path(spark, "orc-test")
    token_orc.write(docs, target, BPE)
    tokens = token_orc.read(spark, target)
    rows = tokens.join(token_orc.starts(tokens), ["part", "row"]).join(token_orc.checksums(tokens).drop("doc_id"), ["part", "row"]).collect()
    at = 0
    for i, t in enumerate(TEXTS):
        want = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2]
        (r,) = [r for r in rows if r["doc_id"] == (i - 1 if i else None)]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert [r["doc_id"] for r in token_orc.lookup(spark, target, [3]).collect()] == [3]
    empty = fresh_path(spark, "orc-empty")
    token_orc.write(docs.limit(0), empty, BPE)
    assert token_orc.read(spark, empty).count() == 0


def test_pieces_and_back(spark, docs):
    for r in pieces.decode(pieces.encode(docs, SP), SP).collect():
        ids = MODEL.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["piece_ids"], "<u4").tolist() == ids and r["decoded"] == MODEL.decode(ids)
    both = pieces.encode(docs, SP, decoded="back", keep=["doc_id"])
    assert both.columns == ["doc_id", "piece_ids", "back"]
    apart = pieces.decode(pieces.encode(docs, SP), SP).select("doc_id", "piece_ids", "decoded")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, both.collect()), key=key) == sorted(map(tuple, apart.collect()), key=key)
    assert pieces.encode(docs.limit(0), SP).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs, SP, out="length")


def test_portions_keep_order_and_bounds(monkeypatch):
    monkeypatch.setattr(pieces, "ROWS", 3)
    monkeypatch.setattr(pieces, "BYTES", 10)
    texts = ["a" * 4, None, "b" * 30, "", "c" * 5, "d" * 5, "e", "", "", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = [p.column(0).to_pylist() for p in pieces._portions(batch, 0)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in parts)
