"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components.

Each table cuts space by ``bits`` random hyperplanes; vectors of one label and
one bucket are compared exactly.  A pair counts in the first table where it
meets, so every link is counted once though no list of pairs is made: a task
gives back, per vector, how many links it found, and a spanning set of edges.
Buckets of many vectors are cut into blocks, and pairs of blocks are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import written
from stallwise.llm.components import components

#: Vectors of a bucket's block; a comparison holds two blocks.
BLOCK = 1024


def usable(vector: str) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One bucket number for each vector and table; the planes follow from the seed and the dimension."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).normal(size=(vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _spanning(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that suffice to connect what the given pairs connect: fewer than n."""
    parent, kept = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            kept.append((a, b))
    return kept


def _compare(group: pd.DataFrame, cosine: float) -> tuple[list, list]:
    """Links of one bucket or pair of blocks: (node, weight of new neighbours) and spanning edges."""
    i, j, table = int(group["i"].iloc[0]), int(group["j"].iloc[0]), int(group["tab"].iloc[0])
    x = np.stack(group["vector"].to_numpy()).astype(np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    code = np.stack(group["codes"].to_numpy())
    node, weight, block = group["node"].to_numpy(), group["copies"].to_numpy(), group["block"].to_numpy()
    left, right = (np.arange(len(x)),) * 2 if i == j else (np.where(block == i)[0], np.where(block == j)[0])
    if not len(left) or not len(right):
        return [], []
    a, b = np.nonzero(x[left] @ x[right].T >= cosine)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    if table and len(a):
        new = np.concatenate([~(code[a[k: k + 65536], :table] == code[b[k: k + 65536], :table]).any(1) for k in range(0, len(a), 65536)])
        a, b = a[new], b[new]
    if not len(a):
        return [], []
    gain = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
    return [(int(node[k]), int(gain[k])) for k in np.nonzero(gain)[0]], [(int(node[p]), int(node[q])) for p, q in _spanning(len(x), a, b)]


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, bits: int = 16, tables: int = 32, seed: int = 9, key: str = "vec_id",
                    vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: key, ``n_links``, ``component_id`` and ``kept``.

    Vectors link when their labels are equal and not null, their dimensions
    are equal and their cosine, in double precision, is at least ``cosine``; a
    pair at exactly 0.93 meets in some of 32 tables of 16 bits with a
    probability of 0.98, one at 0.97 of 0.9999.  Vectors that are null, empty,
    zero or not finite, and rows without key or label, have no links and are
    their own component.  A key is one vector: if its rows differ, the least
    (label, vector) stands for it and all its rows get the same answer.  An
    empty table gives an empty one.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    fit = rows.filter(usable("vector") & F.col("key").isNotNull() & F.col("label").isNotNull())
    one = fit.groupBy("key").agg(F.min(F.struct("label", "vector")).alias("v")).select("key", "v.label", "v.vector")
    members = written(one, "vectors")
    # Equal vectors are one node, whatever their number.
    nodes = members.groupBy("label", "vector").agg(F.min("key").alias("node"), F.count("*").alias("copies"))

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, same in part.groupby(part["vector"].map(len)):
                codes = _codes(np.stack(same["vector"].to_numpy()), bits, tables, seed)
                yield same.assign(codes=list(codes))

    coded = written(nodes.mapInPandas(hashed, "label string, vector array<double>, node long, copies long, codes array<long>"), "codes")
    met = coded.select("node", "label", F.size("vector").alias("dim"), F.posexplode("codes").alias("tab", "bucket"))
    place = ["label", "dim", "tab", "bucket"]
    busy = met.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1")
    cut = F.ceil(F.col("n") / block).cast("int")
    dealt = met.join(busy, place).withColumn("blocks", cut).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.select("node", *place, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("node", *place, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    group = [*place, "i", "j"]
    full = pairs.join(coded.select("node", "vector", "codes", "copies"), "node").repartition(*group).sortWithinPartitions(*group)

    def compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups lie together; only the last one of a batch can go on in the next."""
        rest = None
        for part in parts:
            rest = part if rest is None else pd.concat([rest, part], ignore_index=True)
            last = (rest[group] == rest[group].iloc[-1]).all(axis=1)
            yield out(rest[~last])
            rest = rest[last].reset_index(drop=True)
        if rest is not None:
            yield out(rest)

    def out(some: pd.DataFrame) -> pd.DataFrame:
        gains, edges = [], []
        for _, g in some.groupby(group, sort=False):
            gained, linked = _compare(g, cosine)
            gains += gained
            edges += linked
        return pd.DataFrame([(a, n, None) for a, n in gains] + [(a, 0, b) for a, b in edges], columns=["node", "gain", "other"]).astype({"node": "int64", "gain": "int64", "other": "Int64"})

    found = written(full.mapInPandas(compared, "node long, gain long, other long"), "cosine-links")
    degree = found.groupBy("node").agg(F.sum("gain").alias("gain"))
    group_of = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    node = coded.select("label", "vector", "node", "copies").join(degree, "node", "left").join(group_of, "node", "left").select(
        "label", "vector", "node", (F.coalesce("gain", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    known = members.join(node, ["label", "vector"]).select("key", "n_links", "component_id")
    return rows.select("key").join(known, "key", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "key") == F.col("key"), F.lit(True)).alias("kept"))
