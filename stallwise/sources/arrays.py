"""One JSON array of records in one file, read by many tasks.

``multiLine`` gives a whole file to one task.  Here the file is cut at every
closing brace, which Spark's text reader does split by split, and two passes put
the records back together.  The first learns what each split does to the state
of the text (inside a string or not, depth, open record), under both states it
may start in; the states are chained over the splits of a file, a few numbers
each.  The second cuts records; those that cross a border come out as pieces and
are joined.  A record's position is its byte offset, so it doesn't depend on how
the file was split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.session import fresh_path

_ESCAPED = re.compile(r"\\.", re.S)
_MARKS = re.compile(r'["{}\[\]]')


def walk(text: str, quoted: bool, depth: int) -> Iterator[tuple[int, bool, int]]:
    """(place, inside a string, depth) after each quote and bracket that counts."""
    plain = _ESCAPED.sub("__", text) if "\\" in text else text
    for m in _MARKS.finditer(plain):
        mark = m.group()
        if mark == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if mark in "{[" else -1
        else:
            continue
        yield m.start(), quoted, depth


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The texts of a batch, split by split; all but a file's last end at a closing brace."""
    for batch in batches:
        names, blocks, texts = (batch.column(k).to_pylist() for k in ("file", "block", "value"))
        at = 0
        while at < len(texts):
            key, end = (names[at], blocks[at]), at
            while end < len(texts) and (names[end], blocks[end]) == key:
                end += 1
            yield key, texts[at:end]
            at = end


class _Summary:
    """What a split does, if it starts outside (0) or inside (1) of a string: the end state, the change of depth, and for
    each level, seen from the start, where it was last entered by a brace."""

    def __init__(self) -> None:
        self.bytes, self.quoted, self.depth, self.entered = 0, [False, True], [0, 0], [{}, {}]

    def add(self, text: str) -> None:
        for k in (0, 1):
            before = self.depth[k]
            for place, quoted, depth in walk(text, self.quoted[k], before):
                if depth > before and text[place] == "{":
                    self.entered[k][depth] = self.bytes + len(text[:place].encode())
                self.quoted[k], before = quoted, depth
            self.depth[k] = before
        self.bytes += len(text.encode())


SUMMARY = "file string, block long, bytes long, quoted array<boolean>, depth array<int>, level array<array<int>>, place array<array<long>>"
PIECES = "file string, pos long, part long, closed boolean, text string"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("bytes", pa.int64()), ("quoted", pa.list_(pa.bool_())), ("depth", pa.list_(pa.int32())),
                        ("level", pa.list_(pa.list_(pa.int32()))), ("place", pa.list_(pa.list_(pa.int64())))])
    found: dict[tuple[str, int], _Summary] = {}
    for key, texts in _splits(batches):
        summary = found.setdefault(key, _Summary())
        for text in texts:
            summary.add(text)
    rows = [{"file": f, "block": b, "bytes": s.bytes, "quoted": s.quoted, "depth": s.depth, "level": [list(e) for e in s.entered],
             "place": [list(e.values()) for e in s.entered]} for (f, b), s in found.items()]
    yield pa.RecordBatch.from_pylist(rows, schema)


def chained(rows: list[dict]) -> list[tuple[str, int, int, bool, int, int]]:
    """(file, block, first byte, inside a string, depth, first byte of the open record) at the start of each split."""
    out = []
    state = None
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if state is None or state[0] != r["file"]:
            state = (r["file"], 0, False, 0, -1)
        _, first, quoted, depth, opened = state
        out.append((r["file"], r["block"], first, quoted, depth, opened))
        k = int(quoted)
        after = depth + r["depth"][k]
        entered = dict(zip(r["level"][k], r["place"][k], strict=True)).get(2 - depth)
        opened = -1 if after < 2 else opened if entered is None else first + entered
        state = (r["file"], first + r["bytes"], r["quoted"][k], after, opened)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and parts of records that cross the border of a split, of splits whose start is known."""
    schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("part", pa.int64()), ("closed", pa.bool_()), ("text", pa.string())])
    key, state = None, None

    def rest() -> list[tuple]:
        return [(key[0], state[3], state[4], False, "".join(state[5]))] if key is not None and state[5] else []

    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(k).to_pylist() for k in ("file", "block", "value", "first", "quoted", "depth", "opened")]
        for file, block, text, first, quoted, depth, opened in zip(*columns, strict=True):
            if key != (file, block):
                out += rest()
                key, state = (file, block), [first, quoted, depth, opened, first, []]
            byte, quoted, depth, pos, part, held = state
            at = 0 if depth >= 2 else len(text)
            for place, now_quoted, now in walk(text, quoted, depth):
                if now == 2 and depth == 1 and text[place] == "{":
                    at, pos = place, byte + len(text[:place].encode())
                    part = pos
                elif now == 1 and depth == 2 and text[place] == "}":
                    out.append((file, pos, part, True, "".join(held) + text[at: place + 1]))
                    held, at, pos = [], len(text), -1
                quoted, depth = now_quoted, now
            if at < len(text):
                held.append(text[at:])
            state = [byte + len(text.encode()), quoted, depth, pos, part, held]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(5)], schema=schema)
    last = rest()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in last], schema.field(k).type) for k in range(5)], schema=schema)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of ``schema``, and ``_file`` and ``_pos`` (byte offset) of every object in the top-level array of each file.

    The same rows as ``multiLine`` gives for valid UTF-8 files, indented or on
    one line, with any braces and quotes inside strings.  Objects that aren't
    valid JSON read as NULL fields.  ``spark.sql.files.maxPartitionBytes`` sets how many tasks share a file.
    """
    # The reader drops the brace it splits at, but for a file's last text, which ends the array; so each gets it back.
    cut = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                                              F.concat("value", F.lit("}")).alias("value"))
    states = chained([r.asDict() for r in cut.mapInArrow(_summaries, SUMMARY).collect()])  # a few numbers per split
    starts = spark.createDataFrame(states, "file string, block long, first long, quoted boolean, depth int, opened long")
    keyed = cut.join(F.broadcast(starts), ["file", "block"])  # one row per split
    stored = fresh_path(spark, "records")
    keyed.mapInArrow(_pieces, PIECES).write.parquet(stored)
    pieces = spark.read.parquet(stored)
    whole = pieces.filter(F.col("closed") & (F.col("pos") == F.col("part"))).select("file", "pos", "text")
    # Only records that cross a border are grouped: at most two pieces for each split.
    crossing = pieces.filter(~(F.col("closed") & (F.col("pos") == F.col("part")))).groupBy("file", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"), F.max("closed").alias("closed"))
    records = reduce(DataFrame.unionByName, [whole, crossing.filter("closed").select("file", "pos", "text")])
    return records.select(F.from_json("text", schema).alias("r"), F.col("file").alias("_file"), F.col("pos").alias("_pos")).select("r.*", "_file", "_pos")
