"""Language identification by a bidirectional gated recurrent network over bytes.

A text in UTF-8 is cut into windows of WINDOW bytes. Two gated recurrent units read each window,
one from either end; at every position their states give a probability for each language. A
text's probabilities are the mean over its letter positions. The network is trained in numpy by
backpropagation through time on all windows of a bounded number of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

WINDOW, HIDDEN, BATCH = 64, 8, 4096
#: Labelled texts that are learned from at most, those with the smallest hash of their id; each is learned from whole.
MAX_TEXTS = 600
EPOCHS, MINIBATCH, RATE, SEED = 3, 256, 0.01, 7
UNKNOWN = "und"
#: Bytes that belong to letters: ASCII letters and all of longer characters.
IS_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """tables: what each byte adds to the gates of either direction; gates: what the state adds; head: from both states to the languages."""

    languages: list[str]
    tables: list[np.ndarray]
    gates: list[np.ndarray]
    head: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Network:
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(languages, [f(256, 3 * HIDDEN, scale=0.3) for _ in range(2)], [f(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5) for _ in range(2)], f(2 * HIDDEN, len(languages), scale=0.3), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.gates, self.head, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def read(net: Network, direction: int, data: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
    """The states at each position of windows (positions, windows); trace collects what training needs. Masked positions leave the state at zero before the text begins."""
    steps, n = data.shape
    table, gate = net.tables[direction], net.gates[direction]
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        x, u = table[data[t]], h @ gate
        zr = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        if trace is not None:
            trace.append((t, h, z, r, new, u[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        h *= mask[t][:, None]
        out[t] = h
    return out


def position_probabilities(net: Network, data: np.ndarray, mask: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    states = [read(net, k, data, mask, traces[k] if traces else None) for k in (0, 1)]
    p = states[0] @ net.head[:HIDDEN] + states[1] @ net.head[HIDDEN:] + net.bias
    p -= p.max(-1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(-1, keepdims=True)
    return p, states


def gradients(net: Network, data: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of all letter positions, and its gradients by backpropagation through time."""
    traces: tuple[list, list] = ([], [])
    p, states = position_probabilities(net, data, mask, traces)
    weight = mask * IS_LETTER[data]
    weight = weight / max(weight.sum(), 1)
    chosen = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (*data.shape, 1)), -1)[..., 0]
    loss = float(-(weight * np.log(chosen + 1e-9)).sum())
    d = p.copy()
    np.put_along_axis(d, np.broadcast_to(labels[None, :, None], (*data.shape, 1)), (chosen - 1)[..., None], -1)
    d = (d * weight[..., None]).astype(np.float32)
    head = np.concatenate([np.einsum("tnh,tnl->hl", s, d) for s in states])
    tables, gates = [], []
    for k in (0, 1):
        above = d @ net.head[k * HIDDEN : (k + 1) * HIDDEN].T
        gate, dgate = net.gates[k], np.zeros_like(net.gates[k])
        dx_all = np.zeros((*data.shape, 3 * HIDDEN), np.float32)
        dh = np.zeros_like(above[0])
        for t, before, z, r, new, u in reversed(traces[k]):
            dh = (dh + above[t]) * mask[t][:, None]
            dz = dh * (before - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * u * r * (1 - r)
            dx_all[t] = np.concatenate([dz, dr, dn], 1)
            du = np.concatenate([dz, dr, dn * r], 1)
            dgate += before.T @ du
            dh = dh * z + du @ gate.T
        table = np.zeros_like(net.tables[k])
        np.add.at(table, data.ravel(), dx_all.reshape(-1, 3 * HIDDEN))
        tables.append(table)
        gates.append(dgate)
    return loss, [*tables, *gates, head, d.sum((0, 1))]


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts that lie end to end: where each starts, its bytes, its text."""
    sizes = np.diff(bounds)
    n = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    starts = bounds[:-1][text] + k * WINDOW
    return starts, np.minimum(bounds[1:][text] - starts, WINDOW), text


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (positions, windows), and a mask of the positions they have."""
    steps = np.arange(WINDOW)[:, None]
    return data[np.minimum(starts[None, :] + steps, max(len(data) - 1, 0))], (steps < sizes[None, :]).astype(np.float32)


def train(texts: list[bytes], labels: list[str]) -> Network:
    languages = sorted(set(labels))
    rng = np.random.default_rng(SEED)
    net = Network.new(languages, rng)
    index = {x: k for k, x in enumerate(languages)}
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, sizes, text = cut(data, bounds)
    y = np.array([index[x] for x in labels])
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(starts))
        for k in range(0, len(order), MINIBATCH):
            at = order[k : k + MINIBATCH]
            step += 1
            _, grads = gradients(net, *gather(data, starts[at], sizes[at]), y[text[at]])
            norm = max(1.0, float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads))))
            for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
                g = g / norm
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def text_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """A row of probabilities for each text: the mean over its letter positions; zeros without any."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, sizes, text = cut(data, bounds)
    sums = np.zeros((len(texts), len(net.languages)))
    weights = np.zeros(len(texts))
    for k in range(0, len(starts), BATCH):
        x, mask = gather(data, starts[k : k + BATCH], sizes[k : k + BATCH])
        p, _ = position_probabilities(net, x, mask)
        w = mask * IS_LETTER[x]
        at = text[k : k + BATCH]
        np.add.at(sums, at, np.einsum("tn,tnl->nl", w, p))
        np.add.at(weights, at, w.sum(0))
    return sums / np.maximum(weights, 1)[:, None]


def fit_language(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", limit: int = MAX_TEXTS) -> Network | None:
    """A network from at most limit texts with letters and a language; None without any.

    Which texts they are is settled by ids and hashes alone; only then are their texts fetched.
    Rows alike in id and text count once, with the first of their languages by name.
    """
    rows = labelled.select(labelled[id_column].alias("id"), labelled[text_column].alias("text"), labelled[lang_column].alias("lang")).where(r"lang is not null and text rlike '\\p{L}'").withColumn("h", F.xxhash64("text"))
    keys = rows.select("id", "h").orderBy(F.xxhash64("id"), "id", "h").limit(limit).distinct().withColumnsRenamed({"id": "_id", "h": "_h"})
    # limit rows at most, of two numbers each
    held = rows.join(F.broadcast(keys), rows["id"].eqNullSafe(F.col("_id")) & (rows["h"] == F.col("_h")), "left_semi")
    held = held.groupBy("id", "h").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).collect()
    held.sort(key=lambda r: (r["h"], r["text"], r["lang"]))
    return train([r["text"].encode() for r in held], [r["lang"] for r in held]) if held else None


def predict_language(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the most probable language, and its probability.

    und with score 0 if the text is null or has no letter, or if nothing was learned. Of equally
    probable languages the first by name. Texts are read whole, windows of very long ones in
    turn. Repeated rows stay; no other column is read, whatever its name. No rows give no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                piece = batch.slice(start, end - start)
                texts = piece.column(1).to_pylist()
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if net:
                    known = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
                    p = text_probabilities(net, [texts[k].encode() for k in known])
                    for k, row in zip(known, p, strict=True):
                        best = int(row.argmax())
                        names[k], scores[k] = net.languages[best], min(float(row[best]), 1.0)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)
