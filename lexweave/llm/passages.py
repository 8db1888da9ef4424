"""Quality by attention over passages: a text is a bag of passages, of which only the bag is labelled.

A passage is PASSAGE_WORDS words in a row. It is described by how often each byte occurs, the
share of its words in 5-word windows that occur again in the text, its bytes for each word and its
words for each line; a hidden layer encodes that. Gated attention weighs the passages of a text,
and the weighted mean of their codes is scored. All weights are learned from the texts' labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, rolling_hashes, slices, word_hashes, word_spans

PASSAGE_WORDS, CODE, ATTENTION = 64, 16, 8
#: Labelled texts that are learned from at most, those with the smallest hash of their id.
MAX_TEXTS = 3000
EPOCHS, MINIBATCH, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 11
FEATURES = 256 + 3
#: Passages that are encoded at once.
BATCH = 2048


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the text of each. A text without words has one passage of zeros."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = word_spans(data, bounds)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    rank = np.arange(len(starts)) - first[:-1][owner]
    heads = np.flatnonzero(rank % PASSAGE_WORDS == 0)
    text = owner[heads]
    begin = starts[heads]
    stop = np.minimum(np.r_[begin[1:], len(data)], bounds[1:][text]) if len(heads) else begin
    n_words = np.diff(np.r_[heads, len(starts)])
    features = np.zeros((len(heads), FEATURES), np.float32)
    sizes = stop - begin
    for k in range(0, len(heads), BATCH):
        lo, hi = k, min(k + BATCH, len(heads))
        index = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        offset = np.arange(len(index)) - np.repeat(np.cumsum(sizes[lo:hi]) - sizes[lo:hi], sizes[lo:hi])
        chars = data[begin[lo:hi][index] + offset]
        held = np.bincount(index * 256 + chars, minlength=(hi - lo) * 256).reshape(-1, 256)
        features[lo:hi, :256] = np.sqrt(held / np.maximum(sizes[lo:hi], 1)[:, None])
        features[lo:hi, 257] = np.log1p(held[:, 10])
    features[:, 258] = np.log1p(sizes / np.maximum(n_words, 1))
    if len(starts) >= 5:
        windows = rolling_hashes(word_hashes(data, starts, ends), 5)
        whole = owner[: len(windows)] == owner[4:]
        keyed = windows ^ (owner[: len(windows)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, often = np.unique(keyed, return_inverse=True, return_counts=True)
        again = np.flatnonzero((often[inverse] > 1) & whole)
        edge = np.zeros(len(starts) + 5, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 5, -1)
        covered = np.cumsum(edge)[: len(starts)] > 0
        if len(heads):
            features[:, 256] = np.add.reduceat(covered, heads) / n_words
    empty = np.flatnonzero(counts == 0)
    features = np.concatenate([features, np.zeros((len(empty), FEATURES), np.float32)])
    text = np.concatenate([text, empty])
    order = np.argsort(text, kind="stable")
    return features[order], text[order]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.encode, self.encode_bias, self.tanh, self.gate, self.attend, self.out, self.bias]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes, the two branches of the attention, and its unnormalised weights. These stay bounded, as the branches do."""
        x = (x - self.mean) * self.scale
        code = np.tanh(x @ self.encode + self.encode_bias)
        a, b = np.tanh(code @ self.tanh), 1 / (1 + np.exp(-(code @ self.gate)))
        return x, code, a, b, np.exp((a * b) @ self.attend)

    def scores(self, x: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """A score for each of n texts, of whose passages x has the features."""
        total, codes = np.zeros(n), np.zeros((n, CODE))
        for k in range(0, len(x), BATCH):
            _, code, _, _, w = self.passages(x[k : k + BATCH])
            np.add.at(total, text[k : k + BATCH], w)
            np.add.at(codes, text[k : k + BATCH], code * w[:, None])
        return 1 / (1 + np.exp(-(codes / np.maximum(total, 1e-30)[:, None] @ self.out + self.bias[0])))


def gradients(m: Model, x: np.ndarray, text: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of some texts' labels, and its gradients; text numbers the texts 0, 1, ... in order."""
    x, code, a, b, w = m.passages(x)
    starts = np.searchsorted(text, np.arange(len(y)))
    alpha = w / np.add.reduceat(w, starts)[text]
    pooled = np.add.reduceat(code * alpha[:, None], starts)
    p = 1 / (1 + np.exp(-(pooled @ m.out + m.bias[0])))
    loss = float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())
    d = (p - y) / len(y)
    dpooled = d[:, None] * m.out
    dcode = alpha[:, None] * dpooled[text]
    along = (code * dpooled[text]).sum(1)
    dlog = alpha * (along - np.add.reduceat(alpha * along, starts)[text])
    ga = dlog[:, None] * m.attend * b * (1 - a * a)
    gb = dlog[:, None] * m.attend * a * b * (1 - b)
    dcode = dcode + ga @ m.tanh.T + gb @ m.gate.T
    dpre = dcode * (1 - code * code)
    return loss, [x.T @ dpre, dpre.sum(0), code.T @ ga, code.T @ gb, (a * b).T @ dlog, pooled.T @ d, np.array([d.sum()])]


def train(texts: list[bytes], labels: list[int]) -> Model:
    x, text = describe(texts)
    y = np.array(labels, float)
    rng = np.random.default_rng(SEED)
    f = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    spread = x.std(0)
    m = Model(x.mean(0), np.where(spread > 1e-4, 1 / np.maximum(spread, 1e-4), 0), f(FEATURES, CODE), np.zeros(CODE), f(CODE, ATTENTION), f(CODE, ATTENTION), f(ATTENTION), f(CODE), np.zeros(1))
    first = np.searchsorted(text, np.arange(len(y) + 1))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in m.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), MINIBATCH):
            at = order[k : k + MINIBATCH]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in at])
            step += 1
            _, grads = gradients(m, x[rows], np.repeat(np.arange(len(at)), first[at + 1] - first[at]), y[at])
            for p, g, (u, v) in zip(m.parameters(), grads, moments, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= RATE * (u / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * p)
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", limit: int = MAX_TEXTS) -> Model | None:
    """A model from at most limit labelled documents; None without any. A document labelled twice counts with its smallest label, an id with several texts with the first of them."""
    known = labels.select(labels[id_column].alias("_id"), labels[label_column].cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text")).join(F.broadcast(known), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label")).collect()
    rows.sort(key=lambda r: r["_id"])
    return train([(r["_text"] or "").encode() for r in rows], [r["_label"] for r in rows]) if rows else None


def score_quality(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for every row: how likely label 1 is, from 0 to 1.

    A null text counts as empty, and an empty text as one passage without content. Without a
    model every score is 0.5. Texts are read whole, passages of very long ones in turn. Repeated
    rows stay and score alike; no other column is read, whatever its name. No rows give no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                piece = batch.slice(start, end - start)
                texts = as_bytes(piece.column(1))
                scores = model.scores(*describe(texts), len(texts)) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(work, f"id {kind}, score double").withColumnRenamed("id", id_column)
