"""Quality: naive Bayes support vectors over n-gram indicators.

Indicators (an n-gram is there or not, however often): words in lower case, and
one to three neighbouring word shapes.  A shape keeps what a word looks like
(runs of small letters, capitals, digits and each mark once); a word equal to
the one before it has a shape of its own, so that repetition is an n-gram, too.
Each indicator is scaled by the log ratio of its class counts, each text to
unit length, and a linear hinge-loss model is fitted by dual coordinate
descent; a logistic curve over its margin gives the probability.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import labelled_sample, ragged, text_of

#: Entries of a task's word table before it is emptied: bounds the memory of a task.
WORD_TABLE = 400_000
MUL = np.uint64(0x9E3779B97F4A7C15)
REPEAT = np.uint64(0xA5A5A5A5)
SMALL, CAPITAL, DIGIT = 1 << 21, (1 << 21) + 1, (1 << 21) + 2
#: Class of each character below 0x3000; those above stand for themselves.
CLASSES = np.array([{"Ll": SMALL, "Lo": SMALL, "Lm": SMALL, "Lu": CAPITAL, "Lt": CAPITAL, "Nd": DIGIT}.get(unicodedata.category(chr(c)), c) for c in range(0x3000)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * MUL
    return h ^ (h >> np.uint64(32))


def _hashed(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash for each run of codes."""
    place = ragged(size).astype(np.uint64) + np.uint64(1)
    return _mix(np.add.reduceat(_mix(code + place * np.uint64(0x100000001B3)), np.cumsum(size) - size))


def word_and_shape(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word in lower case and of its shape; no word is empty."""
    size = np.fromiter((len(w) for w in words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(code < len(CLASSES), CLASSES[np.minimum(code, len(CLASSES) - 1)], code.astype(np.uint64))
    owner = np.repeat(np.arange(len(words)), size)
    new = np.ones(len(code), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    low = [w.lower() for w in words]
    low_size = np.fromiter((len(w) for w in low), np.int64, len(low))
    low_code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _hashed(low_code, low_size), _hashed(kind[new], np.bincount(owner[new], minlength=len(words)))


class Indicators:
    """Turns texts into sorted lists of the buckets that they have; knows the words it has met lately."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.words, self.shapes = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def learn(self, fields: list[str]) -> None:
        new = list({w for w in fields if w not in self.number})
        if len(self.number) + len(new) > WORD_TABLE:
            self.forget()
            new = list(set(fields))
        words, shapes = word_and_shape(new)
        self.number.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.words, self.shapes = np.append(self.words, words), np.append(self.shapes, shapes)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        new = {w for fields in split for w in fields if w not in self.number}
        if new:
            if len(self.number) + len(new) > WORD_TABLE:
                self.forget()
                new = {w for fields in split for w in fields}
            self.learn(list(new))
        return [self._one(fields) for fields in split]

    def _one(self, fields: list[str]) -> np.ndarray:
        if not fields:
            return np.zeros(0, np.int64)
        at = np.fromiter(map(self.number.__getitem__, fields), np.int64, len(fields))
        words, shapes = self.words[at], self.shapes[at].copy()
        shapes[1:][at[1:] == at[:-1]] = REPEAT
        grams = [words, _mix(shapes + np.uint64(1))]
        two = _mix(shapes[:-1] * MUL + shapes[1:])
        grams += [two, _mix(two[:-1] * MUL + shapes[2:])] if len(shapes) > 1 else []
        return np.unique((np.concatenate(grams) >> np.uint64(24)) % self.buckets).astype(np.int64)


@dataclass
class QualityModel:
    """``weights`` already hold the class log-count ratios; ``norms`` are those ratios, for the length of a text."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = np.sqrt((self.ratios[found] ** 2).sum())
        return float(self.weights[found].sum() / length if length else 0.0) + self.bias

    def probability(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -60, 60))))


def fit(sample: list[tuple[str, int]], buckets: int = 1 << 18, cost: float = 1.0, alpha: float = 1.0, sweeps: int = 20, seed: int = 3) -> QualityModel:
    """Without rows of both classes the model answers the share of good ones."""
    y = np.array([1.0 if v else -1.0 for _, v in sample])
    share = ((y > 0).sum() + 0.5) / (len(y) + 1)
    if len(set(y)) < 2:
        return QualityModel(np.zeros(buckets, np.float32), np.zeros(buckets, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    maker = Indicators(buckets)
    # Each row holds a bucket at most once, so rows are added one by one; 32 bits keep the driver's share small.
    rows = [r.astype(np.int32) for k in range(0, len(sample), 256) for r in maker.of([t for t, _ in sample[k: k + 256]])]
    maker.forget()
    good, bad = np.full(buckets, float(alpha)), np.full(buckets, float(alpha))
    for r, v in zip(rows, y, strict=True):
        (good if v > 0 else bad)[r] += 1
    ratios = np.log((good / good.sum()) / (bad / bad.sum()))
    ratios[(good + bad) == 2 * alpha] = 0
    values = [(ratios[r] / max(1e-12, np.sqrt((ratios[r] ** 2).sum()))).astype(np.float32) for r in rows]
    # Dual coordinate descent for the hinge loss; a constant feature of one carries the bias.
    # A class gets the cost that makes both weigh the same.
    upper = cost * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    w, b, a = np.zeros(buckets), 0.0, np.zeros(len(y))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(a[i] - gradient / square[i], 0.0), upper[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[rows[i]] += step * values[i]
                b += step
                a[i] = new
    margins = np.array([w[r] @ v + b for r, v in zip(rows, values, strict=True)])
    slope, shift = logistic(margins, y > 0)
    return QualityModel(ratios.astype(np.float32), (w * ratios).astype(np.float32), float(b), slope, shift)


def logistic(margins: np.ndarray, good: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the curve over the margins, by damped Newton steps; targets are drawn in a little from 0 and 1."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -60, 60)))
        g, h = p - target, p * (1 - p) + 1e-9
        matrix = np.array([[(h * margins ** 2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(matrix, [(g * margins).sum(), g.sum()])
        move *= min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        slope, shift = slope - move[0], shift - move[1]
    return float(slope), float(shift)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_chars: int = 20_000, **settings) -> QualityModel:
    """Fits on at most ``max_rows`` labelled rows of at most ``max_chars`` characters: the bound of the sample."""
    return fit(labelled_sample(docs, labels, "quality", max_rows, max_chars), **settings)


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability that the whole text is good.

    Null, empty and blank texts have no indicator: they get the curve's value
    at the bias.  Equal texts get equal scores; rows and other columns stay as
    they are.  ``out`` must not be a column already.  An empty table gives an
    empty one.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    packed = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, maker = packed.value, Indicators(len(packed.value.weights))
        for part in parts:
            texts = part.tolist()
            yield part.map(dict(zip(texts, (model.probability(r) for k in range(0, len(texts), 64) for r in maker.of(texts[k: k + 64])), strict=True)))

    return docs.withColumn(out, run(text_of(text)))
