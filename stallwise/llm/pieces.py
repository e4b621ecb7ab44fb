"""SentencePiece encoding and decoding by a table of distinct marked words (see ``chunks``).

Both run over Arrow batches and give back small ones, so a task holds one batch
of texts, a few results and the table of its worker, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from stallwise.llm.chunks import _packed, sentence_pieces

#: Rows and bytes that are worked on at a time; a longer text is worked on alone.
ROWS, BYTES = 500, 4 << 20


def _portions(batch: pa.RecordBatch, column: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of bounded size."""
    rows = rows or ROWS
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    total = np.append(0, np.cumsum(sizes))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(total, total[at] + BYTES, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "piece_ids", begin: bool = True, end: bool = True, decoded: str | None = None,
           keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the ids of the whole text, as little-endian unsigned 32-bit integers.

    Exactly what the library's ``encode`` gives without sampling.  Null texts
    count as empty: only begin and end ids.  ``decoded`` names one more column,
    the library's ``decode`` of these ids, made in the same pass.  Repeated rows
    come back repeated; an empty table gives an empty one.  ``path`` is where
    every machine has the model.  ``out`` and ``decoded`` must not be columns already.
    """
    kept = list(docs.columns if keep is None else keep)
    new = [out] if decoded is None else [out, decoded]
    if taken := set(new) & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} exist")
    fields = [docs.schema[c] for c in kept] + [StructField(out, BinaryType())] + ([] if decoded is None else [StructField(decoded, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sentence_pieces(path)
        before = _packed([table.model.bos_id()]) if begin else b""
        after = _packed([table.model.eos_id()]) if end else b""
        for batch in batches:
            for some in _portions(batch, 0):
                ids = [before + d + after for d in table.many([t or "" for t in some.column(0).to_pylist()])]
                made = [pa.array(ids, pa.binary())] + ([] if decoded is None else [pa.array([_decoded(table.model, b) for b in ids], pa.string())])
                yield pa.RecordBatch.from_arrays(some.columns[1:] + made, kept + new)

    return docs.select(F.col(text).alias("_text"), *kept).mapInArrow(run, StructType(fields))


def _decoded(model, ids: bytes) -> str:
    return model.decode(np.frombuffer(ids, "<u4").tolist())


def decode(rows: DataFrame, path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the library's ``decode`` of the ids; null ids decode to the empty text."""
    if out in rows.columns:
        raise ValueError(f"column {out} exists")
    names = [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentence_pieces(path).model
        for batch in batches:
            for some in _portions(batch, 0):
                texts = pa.array([_decoded(model, b or b"") for b in some.column(0).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns[1:], texts], names)

    return rows.select(F.col(ids).alias("_ids"), "*").mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))
