"""Toxicity: subword bags, averaged into a linear softmax.

A word is the bag of its character n-grams and of itself, all hashed into one
embedding table; a window of words is the average of its words; a softmax over
two classes reads the average.  Embeddings and softmax are trained jointly, in
numpy, on a bounded sample of labelled rows.  An unseen misspelling shares
n-grams, hence vectors, with the word it comes from.

A few bad words in a long text would vanish in one average.  So a text is
read in windows of ``window`` words (the last one ends with the text), and the
most toxic window gives the text's score; in training, too, each text is
represented by the window that the model of the moment finds most toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import labelled_sample, ragged, text_of

#: Entries of a task's word table before it is emptied: bounds the memory of a task.
WORD_TABLE = 400_000
#: Words whose n-grams are made at a time when a model is fitted.
PART = 20_000
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SIZES = (3, 4, 5)


def bare(field: str) -> str:
    """A word without case and surrounding marks; a field of marks only stays as it is."""
    low = field.lower()
    return EDGES.sub("", low) or low


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of ``<word>`` and of the word itself, flat, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.fromiter((len(w) for w in words), np.int64, len(words)) + 2
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    mul, start = np.uint64(0x9E3779B97F4A7C15), np.cumsum(size) - size
    place = ragged(size).astype(np.uint64) + np.uint64(1)
    mixed = (code + place * np.uint64(0x100000001B3)) * mul
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), start)
    hashes, owners = [whole * mul + np.uint64(1)], [np.arange(len(words))]
    for n in SIZES:
        if len(code) < n:
            break
        inside = owner[: len(code) - n + 1] == owner[n - 1:]
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ code[k: len(code) - n + 1 + k]) * mul
            h ^= h >> np.uint64(31)
        hashes.append(h[inside] * mul)
        owners.append(owner[: len(code) - n + 1][inside])
    ids, who = (np.concatenate(hashes) >> np.uint64(20)) % np.uint64(buckets), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return ids[order].astype(np.int64), np.bincount(who, minlength=len(words))


def numbered(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """Each text as numbers of its bare words, and those words."""
    number: dict[str, int] = {}
    words: dict[str, int] = {}
    rows = []
    for text in texts:
        fields = text.split()
        for w in fields:
            if w not in number:
                number[w] = words.setdefault(bare(w), len(words))
        rows.append(np.fromiter(map(number.__getitem__, fields), np.int32, len(fields)))
    return rows, list(words)


def bags_of(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of many words, a part at a time: the work space of the driver stays small."""
    parts = [subwords(words[k: k + PART], buckets) for k in range(0, len(words), PART)]
    return np.concatenate([p[0].astype(np.int32) for p in parts] or [np.zeros(0, np.int32)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])


def word_means(pull: np.ndarray, ids: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The average pull of each word's bag."""
    out = np.zeros(len(counts), np.float64)
    for k in range(0, len(counts), PART):
        here, n = first[k: k + PART], counts[k: k + PART]
        out[k: k + PART] = np.add.reduceat(pull[ids[here[0]: here[-1] + n[-1]]], here - here[0]) / n
    return out


def window_ends(n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each window of a text of ``n`` words."""
    if n <= window:
        return np.array([0]), np.array([n])
    starts = np.append(np.arange(0, n - window, window), n - window)
    return starts, starts + window


@dataclass
class ToxicityModel:
    """``pull`` is what each bucket adds to the log-odds: the embedding table seen through the softmax."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    window: int

    @property
    def pull(self) -> np.ndarray:
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)

    def word_scores(self, words: list[str], pull: np.ndarray) -> np.ndarray:
        ids, n = subwords(words, len(pull))
        return np.add.reduceat(pull[ids], np.cumsum(n) - n) / n if len(words) else np.zeros(0)

    def log_odds(self, scores: np.ndarray) -> float:
        """Of a text whose words have these scores: the largest average of a window."""
        shift = float(self.bias[1] - self.bias[0])
        if not len(scores):
            return shift
        total = np.concatenate([[0.0], np.cumsum(scores)])
        a, b = window_ends(len(scores), self.window)
        return float(((total[b] - total[a]) / (b - a)).max()) + shift

    def scorer(self) -> TextScorer:
        return TextScorer(self)


class TextScorer:
    """Scores texts; knows the words it has met lately."""

    def __init__(self, model: ToxicityModel):
        self.model, self.pull, self.known = model, model.pull, {}

    def learn(self, fields: set[str]) -> None:
        if len(self.known) + len(fields) > WORD_TABLE:
            self.known.clear()
        names = list(fields)
        self.known.update(zip(names, self.model.word_scores([bare(w) for w in names], self.pull).tolist(), strict=True))

    def score(self, text: str) -> float:
        fields = text.split()
        values = list(map(self.known.get, fields))
        if None in values:
            self.learn({w for w, v in zip(fields, values, strict=True) if v is None})
            values = [self.known[w] if w in self.known else v for w, v in zip(fields, values, strict=True)]
        odds = self.model.log_odds(np.array(values, np.float64))
        return float(1 / (1 + np.exp(-np.clip(odds, -60, 60))))


def fit(sample: list[tuple[str, int]], buckets: int = 1 << 17, dim: int = 8, window: int = 4, epochs: int = 8, rate: float = 0.5,
        batch: int = 64, least_steps: int = 350, seed: int = 5) -> ToxicityModel:
    """Joint training of embeddings and softmax.

    At least ``epochs`` passes and ``least_steps`` minibatches.  Without rows of both classes the model answers their share.
    """
    rng = np.random.default_rng(seed)
    share = (sum(y for _, y in sample) + 0.5) / (len(sample) + 1)
    bias = np.array([0.0, np.log(share / (1 - share))])
    model = ToxicityModel(rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32), np.zeros((dim, 2), np.float32), bias, window)
    if len({y for _, y in sample}) < 2:
        return model
    model.softmax = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    texts, vocabulary = numbered([t for t, _ in sample])
    labels = np.array([y for _, y in sample])
    ids, counts = bags_of(vocabulary, buckets)
    first = np.cumsum(counts) - counts
    del vocabulary
    seen_e, seen_w = np.full(buckets, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32)
    for epoch in range(max(epochs, -(-least_steps // -(-len(texts) // batch)))):
        scores = word_means(model.pull, ids, first, counts)
        order, bags = rng.permutation(len(texts)), []
        for words in texts:
            a, b = window_ends(len(words), window)
            if epoch == 0:
                pick = rng.integers(len(a))
            else:
                total = np.concatenate([[0.0], np.cumsum(scores[words])])
                pick = int(np.argmax((total[b] - total[a]) / np.maximum(b - a, 1)))
            bags.append(words[a[pick]: b[pick]].astype(np.int64))
        for at in range(0, len(order), batch):
            some = [i for i in order[at: at + batch] if len(bags[i])]
            if some:
                _step(model, [bags[i] for i in some], labels[some], ids, counts, first, seen_e, seen_w, rate)
    return model


def _step(model: ToxicityModel, bags: list[np.ndarray], y: np.ndarray, ids, counts, first, seen_e, seen_w, rate: float) -> None:
    """One minibatch of softmax regression on averaged bags, with AdaGrad."""
    sizes = np.array([len(b) for b in bags])
    used, where = np.unique(np.concatenate(bags), return_inverse=True)
    n = counts[used]
    flat = ids[np.repeat(first[used], n) + ragged(n)]
    words = np.add.reduceat(model.embeddings[flat], np.cumsum(n) - n) / n[:, None]
    means = np.add.reduceat(words[where], np.cumsum(sizes) - sizes) / sizes[:, None]
    logits = means @ model.softmax + model.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    grad_w, grad_mean = means.T @ p, p @ model.softmax.T
    grad_word = np.zeros((len(used), grad_mean.shape[1]))
    spread = np.repeat(grad_mean / sizes[:, None], sizes, axis=0)
    for k in range(spread.shape[1]):
        grad_word[:, k] = np.bincount(where, spread[:, k], len(used))
    touched, slot = np.unique(flat, return_inverse=True)
    each = np.repeat(grad_word / n[:, None], n, axis=0)
    grad_e = np.stack([np.bincount(slot, each[:, k], len(touched)) for k in range(each.shape[1])], 1) * len(y)
    seen_e[touched] += (grad_e ** 2).mean(1)
    model.embeddings[touched] -= (rate * grad_e / np.sqrt(seen_e[touched])[:, None]).astype(np.float32)
    seen_w += grad_w ** 2
    model.softmax -= (0.2 * rate * grad_w / np.sqrt(seen_w)).astype(np.float32)
    model.bias = model.bias - 0.2 * rate * p.sum(0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_chars: int = 20_000, **settings) -> ToxicityModel:
    """Fits on at most ``max_rows`` labelled rows of at most ``max_chars`` characters: the bound of the sample."""
    return fit(labelled_sample(docs, labels, "toxic", max_rows, max_chars), **settings)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability that the whole text is toxic.

    Null and empty texts get the share of toxic rows the model knows; equal
    texts equal scores; rows and other columns stay as they are.  ``out`` must
    not be a column already.  An empty table gives an empty one.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    packed = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = packed.value.scorer()
        for part in parts:
            yield part.map(scorer.score)

    return docs.withColumn(out, run(text_of(text)))


def accuracy(pairs: Iterable[tuple[float, int]], cut: float = 0.5) -> float:
    pairs = list(pairs)
    return sum((s >= cut) == bool(y) for s, y in pairs) / max(1, len(pairs))
