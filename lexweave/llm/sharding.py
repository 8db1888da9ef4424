"""Shards of near equal bytes by a histogram sort.

Rows are ordered by (64-bit hash of the text, id), so that equal texts are neighbours. Rounds of
exact counts below candidate boundaries, summed over all partitions, refine the candidates: an
interval that is too heavy, or in which a splitter falls short of its target, is cut again between
the smallest and largest key it holds, by the hash or, where all its texts are one, by the id.
When every splitter is within tolerance the rows are dealt out once. No splitter cuts a group of
equal texts that is light against a shard; a heavier group is cut, as shards would else be uneven.
Only counts of intervals, a number fixed by the shards and the wanted rows in an interval, come to
the driver.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

LOW = -(1 << 63)
#: Groups of equal texts up to this share of a shard's bytes stay in one shard.
WHOLE = 0.05


@dataclass
class Interval:
    """Keys from (hash, id) on, up to the next interval, and what they hold."""

    start: tuple[int, int]
    rows: int = 0
    weight: int = 0
    least: tuple[int, int] = (0, 0)
    most: tuple[int, int] = (0, 0)

    def cuts(self, pieces: int) -> list[tuple[int, int]]:
        """Boundaries that part the keys held here evenly by value; none if there is one key only."""
        (h0, i0), (h1, i1) = self.least, self.most
        if h0 < h1:
            n = min(pieces, h1 - h0 + 1)
            return sorted({(h0 + (h1 - h0) * k // n + (k == n), LOW) for k in range(1, n)} | {(h1, LOW), (h0 + 1, LOW)} - {self.start})
        n = min(pieces, i1 - i0 + 1)
        return sorted({(h0, i0 + (i1 - i0 + 1) * k // n) for k in range(1, n)} - {self.start})


def _places(hashes: np.ndarray, ids: np.ndarray, starts: list[tuple[int, int]]) -> np.ndarray:
    """The interval of each key. The hash alone settles nearly all; keys whose hash is a boundary's are looked up with their id."""
    heads = np.array([s[0] for s in starts], np.int64)
    place = np.searchsorted(heads, hashes, side="right") - 1
    first = np.searchsorted(heads, hashes, side="left")
    for k in np.flatnonzero(first <= place):
        place[k] = bisect.bisect_right(starts, (int(hashes[k]), int(ids[k]))) - 1
    return place


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]


def _counts(keyed: DataFrame, starts: list[tuple[int, int]]) -> list[Interval]:
    """Exact rows and bytes of every interval, over all partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, i, w = _columns(batch)
            if not len(h):
                continue
            order = np.lexsort((i, h))
            h, i, w = h[order], i[order], w[order]
            place = _places(h, i, starts)
            at = np.flatnonzero(np.r_[True, np.diff(place) != 0])
            last = np.r_[at[1:], len(h)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[at].astype(np.int64), last - at + 1, np.add.reduceat(w, at), h[at], i[at], h[last], i[last])], ["place", "n", "w", "h0", "i0", "h1", "i1"])

    parts = keyed.select("h", "i", "size").mapInArrow(count, "place long, n long, w long, h0 long, i0 long, h1 long, i1 long")
    found = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.min(F.struct("h0", "i0")).alias("a"), F.max(F.struct("h1", "i1")).alias("b")).collect()
    by = {r["place"]: r for r in found}
    return [Interval(s, r["n"], r["w"], tuple(r["a"]), tuple(r["b"])) if (r := by.get(k)) else Interval(s) for k, s in enumerate(starts)]


def find_splitters(keyed: DataFrame, shards: int, tolerance: float, interval_rows: int, max_rounds: int = 80) -> tuple[list[Interval], list[int]]:
    """Intervals, and the index of each shard's first interval. Splitters lie within tolerance (of a shard's bytes) of their target, or next to a key that can't be cut."""
    pieces = 8 * shards
    starts = [(LOW, LOW)] + [(LOW + (1 << 64) * k // pieces, LOW) for k in range(1, pieces)]
    for _ in range(max_rounds):
        held = _counts(keyed, starts)
        total = sum(x.weight for x in held)
        below = np.cumsum([0] + [x.weight for x in held])
        of_text: dict[int, int] = {}
        for x in held:
            if x.rows and x.least[0] == x.most[0]:
                of_text[x.least[0]] = of_text.get(x.least[0], 0) + x.weight
        whole = {h for h, w in of_text.items() if w <= WHOLE * total / shards}
        # a border behind the first key of a text parts that text
        free = np.array([j for j in range(len(held) + 1) if j in (0, len(held)) or held[j].start[1] == LOW or held[j].start[0] not in whole])
        cut: dict[int, int] = {}
        firsts = [0]
        for s in range(1, shards):
            goal = total * s / shards
            at = int(np.searchsorted(below[free], goal, side="left"))
            near = min((int(free[j]) for j in (at - 1, at) if 0 <= j < len(free)), key=lambda j: abs(below[j] - goal))
            firsts.append(max(near, firsts[-1]))
            k = int(np.searchsorted(below, goal, side="left"))
            light = 0 < k <= len(held) and held[k - 1].least[0] == held[k - 1].most[0] and held[k - 1].least[0] in whole
            if abs(below[near] - goal) > tolerance * total / shards and 0 < k <= len(held) and not light:
                cut[k - 1] = max(cut.get(k - 1, 2), 16)
        for k, x in enumerate(held):
            if x.rows > 2 * interval_rows:
                cut[k] = max(cut.get(k, 2), min(64, x.rows // interval_rows + 1))
        new = sorted({c for k, n in cut.items() if held[k].rows > 1 and held[k].least != held[k].most for c in held[k].cuts(n)} - set(starts))
        if not new:
            return held, firsts
        starts = sorted({x.start for x in held if x.rows} | {(LOW, LOW)} | set(new))
    raise RuntimeError("splitters did not settle")


def shard_by_bytes(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", overhead: int = 16, tolerance: float = 0.001, interval_rows: int = 250_000) -> DataFrame:
    """(id, size, text_crc32, shard, slot): rows in shards of near equal bytes, and each row's place in its shard.

    size is the text's UTF-8 bytes (a null text: none) plus overhead. Equal texts are neighbours
    in the order, so a group of copies lies in one shard, or in consecutive ones if it weighs more
    than WHOLE of a shard. Rows with the same text and id stay in one shard, in any order among
    themselves; a null id sorts with the smallest. No rows give no shards; with fewer rows than
    shards some stay empty. Only ids, hashes and sizes are shuffled, once, dealt by interval:
    interval_rows bounds a task's rows, also within a hot text. A very long text may fill a shard
    beyond its share. Further columns are not read, whatever their names.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    keyed = checkpointed(docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("h"), F.coalesce(docs[id_column].cast("long"), F.lit(LOW)).alias("i"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    held, firsts = find_splitters(keyed, shards, tolerance, interval_rows)
    starts = [x.start for x in held]
    shard = np.searchsorted(np.array(firsts), np.arange(len(held)), side="right") - 1
    before = np.cumsum([0] + [x.rows for x in held])[:-1]
    base = before - before[np.array(firsts).clip(0, max(len(held) - 1, 0))[shard]]
    kind = docs.schema[id_column].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, i, _ = _columns(batch)
            at = _places(h, i, starts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64)), pa.array(shard[at].astype(np.int32)), pa.array(base[at].astype(np.int64))], [*batch.schema.names, "interval", "shard", "base"])

    placed = keyed.select("h", "i", "size", "id", "text_crc32").mapInArrow(place, f"h long, i long, size long, id {kind}, text_crc32 long, interval long, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("interval").orderBy("h", "i"))
    return placed.select(F.col("id").alias(id_column), "size", "text_crc32", "shard", (F.col("base") + rank - 1).alias("slot"))
