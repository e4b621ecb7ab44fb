"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are sorted by id over all files, so row indexes and stripe
statistics prune ranges of ids, and Bloom filters prune single ids; readers
take stripes in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.llm.chunks import byte_bpe, with_end
from stallwise.llm.common import text_of
from stallwise.llm.pieces import _portions


def write(docs: DataFrame, target: str, path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", stripe_mb: int = 64, stride: int = 2_000) -> None:
    """Writes ``part``, ``row``, the key, ``n_tokens`` and ``ids`` in ascending order of the key to the folder ``target``.

    Null texts count as empty; null keys come first, equal keys are ordered by
    a hash of their text.  ``part`` numbers the files in the order of the keys and
    ``row`` the documents of a file.  An empty table gives an empty folder of
    the same schema.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, row = byte_bpe(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in _portions(batch, 1, batch.num_rows):
                data, ends = with_end(*table.rows(some.column(1)), end_id)
                n = np.diff(ends)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(data.view("<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), some.column(0), pa.array(n), ids],
                                                 ["part", "row", key, "n_tokens", "ids"])
                row += len(n)

    # Boundaries are sampled from the keys; the text is a second key only to split one key that has very many rows.
    ordered = docs.select(F.col(key), text_of(text).alias(text)).repartitionByRange(F.col(key), F.xxhash64(text))
    tokens = ordered.sortWithinPartitions(F.col(key), F.xxhash64(text), text).mapInArrow(run, f"part int, row long, `{key}` {kind.simpleString()}, n_tokens long, ids array<int>")
    (tokens.write.format("orc").option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_mb << 20).option("orc.row.index.stride", stride)
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", 0.01).save(target))


def read(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.format("orc").load(target)


def lookup(spark: SparkSession, target: str, keys: Iterable[int], key: str = "doc_id") -> DataFrame:
    """Rows of a few documents; stripes and row groups without them are skipped by the files' metadata."""
    return read(spark, target).filter(F.col(key).isin(list(keys)))


def starts(tokens: DataFrame) -> DataFrame:
    """``part``, ``row`` and ``start``, the number of ids of all documents before: sums of files, then sums within a file.

    Only three narrow columns are shuffled; a file's rows meet in one task, and
    files are cut evenly when they are written.
    """
    narrow = tokens.select("part", "row", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = narrow.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return narrow.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, "part").select(
        "part", "row", (F.col("base") + F.col("inner")).alias("start"))


def checksums(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``part``, ``row``, the key, the number of ids read and their crc32 as little-endian unsigned 32-bit integers."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                                             ["part", "row", key, "n_read", "ids_crc32"])

    return tokens.select("part", "row", key, "ids").mapInArrow(run, f"part int, row long, `{key}` {kind}, n_read long, ids_crc32 long")
