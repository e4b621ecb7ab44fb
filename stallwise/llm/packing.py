"""Packing documents into sequences of bounded length: best-fit decreasing.

Documents longer than a sequence are first cut into full windows.  The rest
depends on lengths alone, so best fit runs over the counts of each length, of
which there are as many as a window has tokens: the driver sees that table and
nothing that grows with the corpus.  A segment tree indexed by remaining
capacity finds the tightest open window.  Each piece then reads its place from
its length and its number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.chunks import byte_bpe, with_end
from stallwise.llm.common import ragged, text_of, written
from stallwise.llm.pieces import _portions

#: Pieces of a bucket, within which pieces of one length are numbered in one task.
BUCKET = 50_000


class Capacities:
    """Segment tree over remaining capacities 0..size; each leaf counts the runs of windows with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int64)

    def add(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += change
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of an open window that is at least ``need``."""
        at = need + self.leaves
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], size: int) -> np.ndarray:
    """Places of all pieces, given how many there are of each length.

    Rows (length, first number, number of pieces, pieces per window, first
    window, offset): the k-th piece of a row lies in window ``first + k //
    per_window`` at ``offset + k % per_window * length``.  Windows that look
    alike are handled as runs, with the outcome of placing piece by piece: a
    window that has just been filled is the tightest until the next piece
    doesn't fit.
    """
    tree, runs, plan, windows = Capacities(size), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        placed, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = size, windows, -(-left // (size // length))
                windows += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -1)
            each = room // length
            take = min(left, n * each)
            full, part = divmod(take, each)
            plan.append((length, placed, take, each, first, size - room))
            put(room - each * length, first, full)
            put(room - part * length, first + full, 1 if part else 0)
            put(room, first + full + bool(part), n - full - bool(part))
            placed, left = placed + take, left - take
    return np.array(plan, np.int64).reshape(-1, 6)


def cut(docs: DataFrame, path: str, size: int = 1024, end_id: int | None = 0, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Pieces of at most ``size`` ids: key, start, length, doc_tokens, ids_crc32 and ids (little-endian unsigned 32-bit), in a written table.

    Full windows first, then what is left.  Null texts count as empty and have
    the end id only; without an end id an empty document has no piece.  With
    ``ids`` false their checksums alone are written.  Repeated rows are cut
    repeatedly, other columns are left out, and an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_bpe(path)
        for batch in batches:
            for some in _portions(batch, 1, batch.num_rows):
                data, ends = with_end(*table.rows(some.column(1)), end_id)
                total = np.diff(ends)
                count = -(-total // size)
                which = np.repeat(np.arange(len(total)), count)
                start = ragged(count) * size
                length = np.minimum(size, total[which] - start)
                first = ends[which] + start
                parts = [data[a:b] for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                columns = [some.column(0).take(pa.array(which)), pa.array(start), pa.array(length), pa.array(total[which]), pa.array(map(zlib.crc32, parts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in parts], pa.binary())] if ids else columns, names)

    shape = f"`{key}` {kind}, start long, length long, doc_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    names = [key, "start", "length", "doc_tokens", "ids_crc32"] + (["ids"] if ids else [])
    return written(docs.select(F.col(key), text_of(text).alias(text)).mapInArrow(run, shape), "pieces")


def place(pieces: DataFrame, size: int = 1024, key: str = "doc_id") -> DataFrame:
    """All columns of ``pieces`` and where each lies: ``sequence_id`` (from 0) and ``offset``.

    ``pieces`` needs ``key``, ``start`` and ``length`` (1 to ``size``); equal
    (key, start) are told apart arbitrarily but once and for all, as the table
    is numbered and written first.  An empty table gives an empty one.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= k <= size for k in histogram):
        raise ValueError(f"lengths must be 1 to {size}")
    plan = best_fit(histogram, size)
    buckets = 1 + sum(histogram.values()) // BUCKET
    # Pieces are numbered within (length, bucket), and buckets of a length one after the other; no length is held in one task.
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "start"), F.lit(buckets)))
    inner = Window.partitionBy("length", "_bucket").orderBy(key, "start")
    numbered = written(dealt.withColumn("_number", F.row_number().over(inner) - 1), "numbered")
    outer = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy("length", "_bucket").agg(F.count("*").alias("n")).select(
        "length", "_bucket", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("_base"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def spot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        rows = np.lexsort((plan[:, 1], plan[:, 0]))
        mine = plan[rows]
        width = int(mine[:, 1].max()) + 1 if len(mine) else 1
        width = max(width, int(number.max()) + 1) if len(number) else width
        at = np.searchsorted(mine[:, 0] * width + mine[:, 1], length.to_numpy() * width + number.to_numpy(), side="right") - 1
        k = number.to_numpy() - mine[at, 1]
        return pd.DataFrame({"sequence_id": mine[at, 4] + k // mine[at, 3], "offset": mine[at, 5] + k % mine[at, 3] * mine[at, 0]})

    joined = numbered.join(base, ["length", "_bucket"]).withColumn("_spot", spot("length", F.col("_number") + F.col("_base")))
    return joined.select(*pieces.columns, "_spot.sequence_id", "_spot.offset")


def sequences(placed: DataFrame, size: int = 1024, pad_id: int = 0) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``ids`` and ``padding``.

    A sequence is padded to ``size`` ids, except where its length is a power of
    two.  It has at most ``size`` pieces, so a group is bounded.
    """
    joined = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n"))
    padding = F.when(F.bit_count("n") == 1, F.lit(0)).otherwise(F.lit(size) - F.col("n")).cast("int")
    filler = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), padding))
    flat = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return joined.select("sequence_id", F.concat(flat, filler).alias("ids"), padding.alias("padding"))
