"""Language of a text: a bidirectional gated recurrent network over its bytes.

One network reads a window of bytes forwards, a second one backwards; a softmax
over both states labels every position with a language, and the mean of all
positions of a text is the text's probability.  Both directions and the softmax
are trained jointly in numpy by backpropagation through time, on windows of a
bounded sample of labelled documents.

Texts are read whole: as many windows as their bytes need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.common import free_name, held_out, ragged, texts_of
from stallwise.llm.pieces import _portions

#: Bytes of a window, windows read side by side, and the input that stands for "no byte".
WINDOW, SIDE_BY_SIDE, NONE = 128, 1024, 256
UNKNOWN = "und"
#: Parts in which the ids of a language are ranked for the sample.
PARTS = 32
Weights = dict[str, np.ndarray]


@dataclass
class LanguageModel:
    """``table`` (2, 257, 3H) is what a byte adds to update, reset and candidate of each direction, ``recur`` (2, H, 3H)
    what the state adds, ``out`` (2, H, L) and ``bias`` (L) the softmax over the languages."""

    langs: list[str]
    weights: Weights


def initial(hidden: int, langs: int, rng: np.random.Generator, dtype=np.float32) -> Weights:
    return {"table": rng.normal(0, 0.3, (2, NONE + 1, 3 * hidden)).astype(dtype), "recur": rng.normal(0, 0.6 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(dtype),
            "out": rng.normal(0, 0.3, (2, hidden, langs)).astype(dtype), "bias": np.zeros(langs, dtype)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(2, T, N) bytes of each window, first forwards, then backwards; ``NONE`` after its end."""
    step = np.arange(int(size.max(initial=0)))[:, None]
    inside = step < size
    forth = np.where(inside, start + step, 0)
    back = np.where(inside, start + size - 1 - step, 0)
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, np.stack([padded[forth], padded[back]]), NONE)


def turned(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(T, N, ...) values of a backward reading in the order of the text; positions after the end are arbitrary."""
    step = np.arange(len(values))[:, None]
    return values[np.maximum(size - 1 - step, 0), np.arange(len(size))]


def loss_and_gradients(w: Weights, codes: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross entropy of all positions of a batch, and its gradients by backpropagation through time."""
    _, steps, n = codes.shape
    hidden = w["recur"].shape[1]
    h = np.zeros((2, n, hidden), w["bias"].dtype)
    kept, states = [], []
    for t in range(steps):
        x = np.stack([w["table"][0][codes[0, t]], w["table"][1][codes[1, t]]])
        u = h @ w["recur"]
        gates = _sigmoid(x[..., :2 * hidden] + u[..., :2 * hidden])
        z, r = gates[..., :hidden], gates[..., hidden:]
        cand = np.tanh(x[..., 2 * hidden:] + r * u[..., 2 * hidden:])
        kept.append((h, z, r, cand, u[..., 2 * hidden:]))
        h = cand + z * (h - cand)
        states.append(h)
    both = np.stack(states, 1)
    forth, back = both[0], turned(both[1], size)
    logits = forth @ w["out"][0] + back @ w["out"][1] + w["bias"]
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    inside = np.arange(steps)[:, None] < size
    total = int(inside.sum())
    at = np.broadcast_to(label, (steps, n))
    truth = np.take_along_axis(p, at[..., None], -1)[..., 0]
    loss = float(-np.log(np.maximum(truth, 1e-30))[inside].sum() / total)
    grad = p.copy()
    np.put_along_axis(grad, at[..., None], (truth - 1)[..., None], -1)
    grad = (grad * inside[..., None] / total).astype(w["bias"].dtype)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["bias"] = grad.sum((0, 1))
    for d, state in enumerate((forth, back)):
        g["out"][d] = np.tensordot(state, grad, ((0, 1), (0, 1)))
    # Positions outside have no gradient, so turning back puts each one's where its backward step was.
    from_out = np.stack([grad @ w["out"][0].T, turned(grad, size) @ w["out"][1].T * inside[..., None]])
    into = np.zeros((2, n, hidden), w["bias"].dtype)
    byte_grad = np.zeros((2, steps, n, 3 * hidden), w["bias"].dtype)
    for t in range(steps - 1, -1, -1):
        before, z, r, cand, u_cand = kept[t]
        dh = into + from_out[:, t]
        d_cand = dh * (1 - z) * (1 - cand * cand)
        d_gates = np.concatenate([dh * (before - cand) * z * (1 - z), d_cand * u_cand * r * (1 - r)], -1)
        byte_grad[:, t] = np.concatenate([d_gates, d_cand], -1)
        du = np.concatenate([d_gates, d_cand * r], -1)
        g["recur"] += before.transpose(0, 2, 1) @ du
        into = dh * z + du @ w["recur"].transpose(0, 2, 1)
    for d in (0, 1):
        flat, code = byte_grad[d].reshape(-1, 3 * hidden), codes[d].reshape(-1)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        g["table"][d][code[order][first]] = np.add.reduceat(flat[order], first)
    return loss, g


def fit(sample: list[tuple[bytes, str]], hidden: int = 8, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 7) -> LanguageModel:
    """Trains on windows with their languages by Adam; each batch deals the languages evenly.

    Without any window the model knows no language; with one language it always answers that.
    """
    langs = sorted({lang for _, lang in sample})
    rng = np.random.default_rng(seed)
    w = initial(hidden, max(1, len(langs)), rng)
    if len(langs) < 2:
        return LanguageModel(langs, w)
    label = np.array([langs.index(lang) for _, lang in sample])
    size = np.array([len(b) for b, _ in sample])
    data, start = np.frombuffer(b"".join(b for b, _ in sample), np.uint8), np.cumsum(size) - size
    weight = 1.0 / np.bincount(label)[label]
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = rng.choice(len(label), batch, p=weight / weight.sum())
        _, g = loss_and_gradients(w, windows(data, start[some], size[some]), size[some], label[some])
        pull = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        length = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k in w:
            grad = g[k] * min(1.0, 1.0 / max(length, 1e-12))
            mean[k] += 0.1 * (grad - mean[k])
            square[k] += 0.01 * (grad * grad - square[k])
            w[k] -= (pull * mean[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(w[k].dtype)
    return LanguageModel(langs, w)


class Reader:
    """Reads many windows side by side; sigmoid and tanh are both taken from one exponential, whose factors are folded into the weights."""

    def __init__(self, model: LanguageModel):
        w = model.weights
        self.hidden, self.langs = w["recur"].shape[1], len(w["bias"])
        factor = np.repeat(np.array([-1.0, -1.0, 2.0], np.float32), self.hidden)
        self.table, self.recur = (w["table"] * factor).astype(np.float32), (w["recur"] * factor).astype(np.float32)
        self.out, self.bias = w["out"].astype(np.float32), w["bias"].astype(np.float32)

    def labels(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sum of the probabilities of all positions of each window: (N, L)."""
        _, steps, n = codes.shape
        h2 = 2 * self.hidden
        h = np.zeros((2, n, self.hidden), np.float32)
        x, u = (np.empty((2, n, 3 * self.hidden), np.float32) for _ in range(2))
        gates, cand = np.empty((2, n, h2), np.float32), np.empty((2, n, self.hidden), np.float32)
        logits = np.empty((2, steps, n, self.langs), np.float32)
        for t in range(steps):
            for d in (0, 1):
                np.take(self.table[d], codes[d, t], 0, out=x[d], mode="clip")
            np.matmul(h, self.recur, out=u)
            np.add(x[..., :h2], u[..., :h2], out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[..., self.hidden:], u[..., h2:], out=cand)
            cand += x[..., h2:]
            np.exp(cand, out=cand)
            cand += 1
            np.divide(np.float32(-2), cand, out=cand)
            cand += 1
            h -= cand
            h *= gates[..., :self.hidden]
            h += cand
            np.matmul(h, self.out, out=logits[:, t])
        both = logits[0] + turned(logits[1], size) + self.bias
        both -= both.max(-1, keepdims=True)
        np.exp(both, out=both)
        both /= both.sum(-1, keepdims=True)
        both *= (np.arange(steps)[:, None] < size)[..., None]
        return both.sum(0)

    def texts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mean probabilities of all bytes of each text: (N, L); a text without bytes has zeros."""
        count = -(-size // WINDOW)
        owner, place = np.repeat(np.arange(len(size)), count), ragged(count) * WINDOW
        at, length = start[owner] + place, np.minimum(WINDOW, size[owner] - place)
        total = np.zeros((len(size), self.langs))
        # Windows of like length are read together; equal ones keep their order, so results don't hang on the batch's other texts.
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(order), SIDE_BY_SIDE):
            some = order[k: k + SIDE_BY_SIDE]
            sums = self.labels(windows(data, at[some], length[some]), length[some])
            for lang in range(self.langs):
                total[:, lang] += np.bincount(owner[some], sums[:, lang], len(size))
        return total / np.maximum(size, 1)[:, None]


def sample(docs: DataFrame, max_rows: int = 4000, per_lang: int = 1000, per_text: int = 8, seed: int = 13) -> list[tuple[bytes, str]]:
    """Windows for training, of at most ``max_rows`` documents outside the held-out fold that have a text and a language.

    Ids are dealt from narrow columns, in the order of a hash and round robin over the languages, at most
    ``per_lang`` each; an id with two languages doesn't count.  Of each text at most ``per_text`` windows, evenly spaced.
    """
    named = (docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out())
             .groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("lang").alias("lang2")).filter("lang = lang2"))
    # A language is ranked in parts first, so that the last rank meets at most PARTS times ``per_lang`` ids of it.
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(PARTS))
    few = named.select("doc_id", "lang", part.alias("part")).withColumn("inner", rank("lang", "part")).filter(F.col("inner") <= per_lang)
    picked = (few.select("doc_id", "lang", rank("lang").alias("nth")).filter(F.col("nth") <= per_lang)
              .orderBy("nth", "lang").limit(max_rows).select("doc_id", "lang"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: list[tuple[bytes, str]] = []
            for text, lang in zip(part.column("text"), part.column("lang"), strict=True):
                raw = text.as_buffer()
                every = max(WINDOW, -(-raw.size // per_text))
                found += [(raw[at: at + WINDOW].to_pybytes(), lang.as_py()) for at in range(0, raw.size, every)]
            yield pa.RecordBatch.from_pydict({"part": [b for b, _ in found], "lang": [v for _, v in found]}, pa.schema([("part", pa.binary()), ("lang", pa.string())]))

    rows = texts_of(docs, picked).filter("text <> ''").mapInArrow(cut, "part binary, lang string").collect()
    return sorted((bytes(r["part"]), r["lang"]) for r in rows)


def train(docs: DataFrame, max_rows: int = 4000, **settings) -> LanguageModel:
    return fit(sample(docs, max_rows), **settings)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs``, the likeliest language of the whole text and its probability.

    A null text and one without any letter get ``und`` and 0, and so does every
    text where the model knows no language.  Ties go to the language that sorts
    first; equal texts get equal answers up to rounding; rows stay as they are.
    ``out`` and ``score`` must not be columns already.  An empty table gives an empty one.
    """
    taken = {c.lower() for c in docs.columns}
    if {out.lower(), score.lower()} & taken:
        raise ValueError(f"column {out} or {score} exists")
    packed = docs.sparkSession.sparkContext.broadcast(model)
    read = free_name([*docs.columns, out, score], "_read")
    # Only texts with a letter reach the network.
    readable = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).otherwise(F.lit(""))
    marked = docs.withColumn(read, readable)
    schema = docs.select("*", F.lit("").alias(out), F.lit(0.0).alias(score)).schema
    return marked.mapInArrow(_predicting(packed, read, out, score), schema)


def _predicting(packed, read: str, out: str, score: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = packed.value
        reader, names = Reader(model), np.array([*model.langs, UNKNOWN], object)
        for part in (some for batch in parts for some in _portions(batch, batch.schema.get_field_index(read))):
            texts = part.column(read).cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            size = np.diff(bounds)
            with np.errstate(over="ignore"):
                shares = reader.texts(data, bounds[:-1], size) if model.langs else np.zeros((len(size), 1))
            known = (size > 0) & bool(model.langs)
            best = np.where(known, shares.argmax(1), len(model.langs))
            value = np.where(known, np.clip(shares.max(1), 0, 1), 0.0)
            rest = [name for name in part.schema.names if name != read]
            yield pa.RecordBatch.from_arrays([*(part.column(name) for name in rest), pa.array(names[best], pa.string()), pa.array(value)], [*rest, out, score])
    return run
