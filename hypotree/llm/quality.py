"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

A document's pool is the mean of its word vectors and, for each of a few distances, the mean of the elementwise products of
every word vector with the one so many words before it: the mean tells what words there are, the products how they follow.

Fitting reads a bounded sample of labelled rows (`per_label` rows of each label in expectation, texts of at most
`max_bytes`); scoring reads every whole text. The model has a fixed size: at most `max_words` vectors of `dim` numbers.

Defined results: null text counts as empty; a text without tokens gets the network's score of an all-zero pool; repeated
rows each get their own (equal) score; an empty table gives an empty result; without labels of both kinds every score is 0.5;
columns other than the two that are named pass through untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field as dc_field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, field, held_out, map_texts, slices

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Distances at which a token's vector is multiplied with those before it, and how many of its numbers are.
LAGS, BOUND = (1, 2, 3), 48


def shape(token: str) -> str:
    """The class that stands for a token outside the vocabulary: its kind of letters and rough length."""
    kind = "d" if token[0].isdigit() else "p" if not token[0].isalpha() else "U" if len(token) > 1 and token.isupper() else "T" if token.istitle() else "l" if token.islower() else "m"
    return f"\0{kind}{min(4, len(token).bit_length())}"


def index_vector(token: str, dim: int, nonzero: int) -> np.ndarray:
    """The token's own sparse vector of +1 and -1, drawn by its hash."""
    draw = np.random.default_rng(int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))
    out = np.zeros(dim, np.float32)
    out[draw.choice(dim, nonzero, replace=False)] = draw.choice([-1.0, 1.0], nonzero)
    return out


class _Rows(dict):
    """Numbers tokens; keeps each one's row in the matrix of vectors."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__()
        self.known, self.rows = known, []

    def __missing__(self, token: str) -> int:
        row = self.known.get(token)
        self.rows.append(self.known.get(shape(token), 0) if row is None else row)
        self[token] = code = len(self)
        return code


@dataclass
class Model:
    """words: token or shape to row of vectors (row 0 is zero). layers: W1, b1, W2, b2. temperature divides the logit."""

    words: dict[str, int]
    vectors: np.ndarray
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: list[np.ndarray] = dc_field(default_factory=list)
    temperature: float = 1.0

    def width(self) -> int:
        """The length of a document's pool."""
        return self.vectors.shape[1] + len(LAGS) * min(BOUND, self.vectors.shape[1])

    def pool(self, texts: list[str], coded: _Rows | None = None) -> np.ndarray:
        """Per text: the mean word vector, and for each lag the mean product of a word's vector with that of the word before."""
        coded = _Rows(self.words) if coded is None else coded
        out = np.zeros((len(texts), self.width()), np.float32)
        get, codes, counts = coded.__getitem__, [], []
        for text in texts:
            found = TOKEN.findall(text)
            codes.extend(map(get, found))
            counts.append(len(found))
        n = np.array(counts, np.int64)
        if not codes:
            return out
        own = np.array(coded.rows, np.int32)[np.array(codes, np.int32)]
        dim, step, ends = self.vectors.shape[1], 1 << 14, np.cumsum(n).tolist()
        bound = min(BOUND, dim)
        for i, (end, size) in enumerate(zip(ends, counts)):
            for cut in range(0, size, step):  # bounded memory, also for one very long text
                head = min(cut, max(LAGS))
                v = self.vectors[own[end - size + cut - head : min(end, end - size + cut + step)]]
                out[i, :dim] += np.ones(len(v) - head, np.float32) @ v[head:]
                v = v[:, :bound]
                for k, lag in enumerate(LAGS):
                    later = max(lag, head)
                    out[i, dim + k * bound : dim + (k + 1) * bound] += np.einsum("td,td->d", v[later:], v[later - lag : len(v) - lag])
        out /= np.maximum(n, 1)[:, None]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((pooled - self.centre) / self.spread @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(pooled), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled).astype(np.float64) / self.temperature, -40, 40)))


def word_vectors(texts: list[str], dim: int, nonzero: int, max_words: int, min_count: int, window: int) -> Model:
    """Random indexing: a word's vector is the damped sum of its neighbours' index vectors, scaled to 1, plus its own index vector."""
    codes: dict[str, int] = {}
    coded = [np.array([codes.setdefault(w, len(codes)) for w in TOKEN.findall(t)], np.int32) for t in texts]
    times = np.bincount(np.concatenate([np.zeros(0, np.int32), *coded]), minlength=len(codes))
    kept = sorted((w for w, c in codes.items() if times[c] >= min_count), key=lambda w: (-times[codes[w]], w))[:max_words]
    rare = sorted({shape(w) for w in codes})
    words = {w: i + 1 for i, w in enumerate([*kept, *rare])}
    index = np.stack([np.zeros(dim, np.float32), *(index_vector(w, dim, nonzero) for w in words)])
    context = np.zeros_like(index)
    row_of = np.array([words.get(w) or words[shape(w)] for w in codes] or [0], np.int64)
    rows = [row_of[one] for one in coded]
    for lag in range(1, window + 1):
        pairs = np.concatenate([np.zeros(0, np.int64), *(r[:-lag] * len(index) + r[lag:] for r in rows if len(r) > lag)])
        pair, met = np.unique(pairs, return_counts=True)
        left, right, weight = pair // len(index), pair % len(index), np.log1p(met).astype(np.float32)[:, None]
        for at in range(0, len(pair), 1 << 16):
            cut = slice(at, at + (1 << 16))
            np.add.at(context, left[cut], weight[cut] * index[right[cut]])
            np.add.at(context, right[cut], weight[cut] * index[left[cut]])
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return Model(words, context / np.maximum(length, 1e-9) + index / np.sqrt(nonzero))


def train(model: Model, pooled: np.ndarray, labels: np.ndarray, hidden: int, epochs: int, seed: int) -> Model:
    """Adam on the log loss over four fifths of the rows; the temperature minimises the log loss of the other fifth."""
    if len(set(labels.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    x, y = pooled[order].astype(np.float64), labels[order].astype(np.float64)
    model.centre, model.spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - model.centre) / model.spread
    cut = max(1, len(y) // 5)
    x, y, later = x[cut:], y[cut:], order[:cut]
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        mixed = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            rows = mixed[at : at + 128]
            h = np.tanh(x[rows] @ w[0] + w[1])
            wrong = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - y[rows, None]) / len(rows)
            back = wrong @ w[2].T * (1 - h * h)
            grads = [x[rows].T @ back + 1e-4 * w[0], back.sum(0), h.T @ wrong + 1e-4 * w[2], wrong.sum(0)]
            step += 1
            for p, g, m, v in zip(w, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.layers = w
    logit, truth = model.logits(pooled[later]), labels[later]
    loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", per_label: int = 2000, max_bytes: int = 32_768,
        dim: int = 96, nonzero: int = 8, max_words: int = 20_000, min_count: int = 3, window: int = 2, hidden: int = 48, epochs: int = 40, seed: int = 7) -> Model:
    """Fits on a bounded sample: of each label value about per_label rows, those with the smallest hashes of their id.

    Of rows that repeat an id one text is taken. Only the sample's texts (at most 2 * per_label * max_bytes, a few MB in practice) come to the driver. Rows for which
    held_out() holds and labels other than 0 and 1 take no part.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    rows = rows.groupBy("_key").agg(F.max("_label").alias("_label"))
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = F.shiftrightunsigned(F.xxhash64("_key"), 11) / float(1 << 53)
    chosen = rows.where(share < F.when(F.col("_label") == 1, per_label / max(1, counts.get(1, 1))).otherwise(per_label / max(1, counts.get(0, 1))))
    texts = docs.where(F.octet_length(text) <= max_bytes).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text")).toArrow().sort_by([("_key", "ascending"), ("_text", "ascending")])
    told, truth = sample["_text"].to_pylist(), np.array(sample["_label"].to_pylist(), np.int64)
    del sample
    model = word_vectors(told, dim, nonzero, max_words, min_count, window)
    pooled = np.concatenate([np.zeros((0, model.width()), np.float32), *(model.pool(told[i : i + 200]) for i in range(0, len(told), 200))])
    return train(model, pooled, truth, hidden, epochs, seed)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    coded = _Rows(model.words)
    for batch in slices(batches, text, SLICE):
        coded = _Rows(model.words) if len(coded) > 150_000 else coded
        yield batch, model.scores(model.pool([x or "" for x in batch.column(text).to_pylist()], coded))


def score(docs: DataFrame, model: Model, *, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the probability of label 1 in column `to`, in place of a column of that name. The model goes out as one broadcast of bounded size."""
    sent, docs = docs.sparkSession.sparkContext.broadcast(model), docs.drop(to)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _scored(batches, sent.value, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, to])

    return map_texts(docs, run, schema)


def keep_good(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is at least `least`, with the columns of docs."""
    name = field(docs.schema, "_score")
    return score(docs, model, text=text, to=name).where(F.col(name) >= least).drop(name)
