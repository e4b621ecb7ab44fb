"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component that makes all lengths equal, which turns the
largest inner product into the smallest distance, and are rotated at random,
so that any few components speak for all.  Within a probed list the components
are read in blocks of columns: after each block a hypothesis test compares the
distance so far, scaled up, with what the query needs, and abandons candidates
that almost certainly miss it.  Survivors are scored exactly, in double
precision, on the original vectors.

What a query needs is known before its lists are read: the sample that the
index was fitted on gives its first k results, and no neighbour in the end
scores less than the last of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.common import written
from stallwise.llm.cosine_dups import usable

#: Candidates and queries that one task group holds at most, about.
BLOCK, QUERIES = 4096, 2048


@dataclass
class Index:
    """Bounded by the sample: centroids and the sample itself; ``top`` is the squared length that all vectors get."""

    ids: np.ndarray
    sample: np.ndarray
    centroids: np.ndarray
    rotation: np.ndarray
    top: float
    probes: int
    recall: float

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.column_stack([x, extra]) @ self.rotation

    def order(self, lifted: np.ndarray) -> np.ndarray:
        """The lists, nearest centroid first, for each row."""
        return np.argsort((self.centroids ** 2).sum(1) - 2 * lifted @ self.centroids.T, axis=1, kind="stable")

    def nearest(self, lifted: np.ndarray) -> np.ndarray:
        return np.argmin((self.centroids ** 2).sum(1) - 2 * lifted @ self.centroids.T, axis=1)

    def seeds(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The k best other vectors of the sample, their scores, and the score of the k-th (minus infinity if there is none)."""
        names, values, floor = [], [], np.full(len(x), -np.inf)
        scores = x @ self.sample.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        for i, row in enumerate(scores):
            best = np.lexsort((self.ids, -row))[:k] if len(row) <= 4 * k else _best(row, self.ids, k)
            best = best[np.isfinite(row[best])]
            exact = np.einsum("j,ij->i", x[i], self.sample[best])
            names.append(self.ids[best])
            values.append(exact)
            if len(best) == k:
                floor[i] = exact.min()
        return names, values, floor


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    near = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def kmeans(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = np.argmin((centers ** 2).sum(1) - 2 * x @ centers.T, axis=1)
        n = np.bincount(own, minlength=lists)
        sums = np.stack([np.bincount(own, x[:, d], lists) for d in range(x.shape[1])], 1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), lists)])
    return centers


def fit(ids: np.ndarray, sample: np.ndarray, top: float, total: int, k: int = 20, goal: float = 0.97, seed: int = 13) -> Index:
    """``total`` vectors get about the square root of as many lists; lists are probed until the sample's recall reaches ``goal``."""
    rng, n = np.random.default_rng(seed), len(sample)
    rotation = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))[0]
    index = Index(ids, sample, np.zeros((1, sample.shape[1] + 1)), rotation, top, 1, 1.0)
    lifted = index.lift(sample, False)
    lists = int(np.clip(round(total ** 0.5), 1, min(4096, max(1, n // 8))))
    index.centroids = kmeans(lifted, lists, rng)
    tried = rng.choice(n, min(n, 400), replace=False)
    own, place = index.nearest(lifted), np.empty((len(tried), lists), np.int64)
    np.put_along_axis(place, index.order(index.lift(sample[tried], True)), np.arange(lists)[None, :], axis=1)
    scores = sample[tried] @ sample.T
    scores[np.arange(len(tried)), tried] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, n - 1)]
    needed = np.take_along_axis(place, own[best], axis=1).ravel()
    hit = np.cumsum(np.bincount(needed, minlength=lists)) / max(1, needed.size)
    index.probes = int(np.argmax(hit >= goal - 1e-12)) + 1 if needed.size else lists
    index.recall = float(hit[index.probes - 1]) if needed.size else 1.0
    return index


def scan(index: Index, query: np.ndarray, floor: np.ndarray, x: np.ndarray, columns: int = 16, doubt: float = 2.1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query number, candidate number) that no test abandons.

    ``doubt`` widens the test at d of D components by ``doubt / sqrt(d)``: the
    larger, the fewer true neighbours are abandoned.
    """
    q, c = index.lift(query, True), index.lift(x, False)
    # A score of at least the floor is a squared distance of at most this; a little room for rounding keeps ties.
    need = (query * query).sum(1) + index.top - 2 * floor + 1e-9 * (1 + np.abs(index.top))
    size, part, alive = q.shape[1], np.zeros((len(q), len(c))), None
    for at in range(0, size, columns):
        to = min(size, at + columns)
        qb, cb = q[:, at:to], c[:, at:to]
        if alive is None:
            part += (qb ** 2).sum(1)[:, None] + (cb ** 2).sum(1)[None, :] - 2 * qb @ cb.T
        else:
            part = part + ((qb[alive[0]] - cb[alive[1]]) ** 2).sum(1)
        limit = need * ((to / size) * (1 + doubt / np.sqrt(to)) ** 2 if to < size else 1.0)
        stay = part <= (limit[:, None] if alive is None else limit[alive[0]])
        if alive is None:
            if stay.mean() < 0.1 or to == size:
                alive = np.nonzero(stay)
                part = part[alive]
        else:
            alive, part = (alive[0][stay], alive[1][stay]), part[stay]
    return alive


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = 4_096, goal: float = 0.97, key: str = "vec_id", vector: str = "embedding",
           block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` best candidates found for each query.

    The index is fitted on at most ``sample_rows`` vectors and a quarter of all
    (the first by a hash of the key), every vector is put in a list.  Keys that are null and vectors
    that are null, empty, zero or not finite take no part; nor do vectors
    whose dimension is not the commonest (of equally common ones the
    greatest).  A vector is no candidate for the query of its own key; equal
    keys with equal vectors count once.  Ties go to the smaller key.  A query
    without another candidate has no row; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    data = written(clean(vectors).withColumn("dim", F.size("v")), "vectors")
    shape = data.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), F.desc("dim")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], empty)
    data = data.filter(F.col("dim") == shape["dim"]).select("id", "v")
    asked = clean(queries).filter(F.size("v") == shape["dim"])
    chosen = data.orderBy(F.xxhash64("id"), "id").limit(min(sample_rows, shape["n"] // 4 + 1)).collect()
    index = fit(np.array([r["id"] for r in chosen]), np.array([r["v"] for r in chosen], np.float64), shape["top"], shape["n"], k, goal)
    shared = spark.sparkContext.broadcast(index)

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(list=shared.value.nearest(shared.value.lift(np.stack(part["v"].to_numpy()), False)))

    def probing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at: at + 256]
                x, own = np.stack(some["v"].to_numpy()), shared.value
                (names, scores, floor), lists = own.seeds(some["id"].to_numpy(), x, k), own.order(own.lift(x, True))[:, : own.probes]
                yield pd.DataFrame({"id": some["id"].to_numpy(), "v": some["v"].to_numpy(), "floor": floor, "lists": list(lists), "seeds": names, "scores": scores})

    in_lists = written(data.mapInPandas(listed, "id long, v array<double>, list long"), "lists")
    probes = written(asked.mapInPandas(probing, "id long, v array<double>, floor double, lists array<long>, seeds array<long>, scores array<double>"), "probes")
    # At most 4096 lists, so these tables of counts are small whatever the corpus; large lists and large sets of queries are cut.
    blocks = in_lists.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    parts = probes.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
    cut = F.broadcast(blocks.join(parts, "list"))
    stored = in_lists.join(cut, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    stored = stored.select("id", "v", "list", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    probed = probes.select("id", "v", "floor", F.explode("lists").alias("list")).join(cut, "list").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    probed = probed.select("id", "v", "floor", "list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values("id")
            left = left[~np.isin(left["id"].to_numpy(), shared.value.ids)]
        if len(left) and len(right):
            x, ids = np.stack(left["v"].to_numpy()), left["id"].to_numpy()
            for at in range(0, len(right), 256):
                some = right.iloc[at: at + 256]
                q, own = np.stack(some["v"].to_numpy()), some["id"].to_numpy()
                i, j = scan(shared.value, q, some["floor"].to_numpy(), x)
                other = own[i] != ids[j]
                i, j = i[other], j[other]
                score = np.einsum("ij,ij->i", q[i], x[j])
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, np.arange(len(q)))
                best = np.arange(len(i)) - first[i] < k
                out["query_id"].append(own[i[best]])
                out["vec_id"].append(ids[j[best]])
                out["score"].append(score[best])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    group = ["list", "block", "part"]
    found = stored.groupBy(*group).cogroup(probed.groupBy(*group)).applyInPandas(compared, "query_id long, vec_id long, score double")
    known = probes.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("seeds", "scores")).alias("s")).select("query_id", F.col("s.seeds").alias("vec_id"), F.col("s.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.unionByName(known).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
