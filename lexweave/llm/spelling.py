"""Spelling variants: words one inserted, deleted or replaced character apart, found in sorted dictionaries.

One edit leaves the first half of a word or its last half intact. So each word stands in a forward
dictionary, under its first half, and in a reversed one, under its last half; words that can be one
edit apart share a block there. A block with too many words is subdivided by the same argument: of
the stretch that may hold the edit one half is intact again. Where the stretch is one character
long, a block holds words that differ in at most two characters, so its size is bounded by the
alphabet. The dictionaries are sorted by range and read block after block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, free_name, released

#: Words of a block from which it is subdivided; results don't depend on it.
BLOCK = 48
#: What tells blocks apart: the shorter word's length, the stretch that holds the edit, and what stands before and after it.
KEY = ["m", "lo", "hi", "before", "after"]
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of_letters(docs: DataFrame, least: int = 6, text_column: str = "text", *others: str) -> DataFrame:
    """(others, word): every maximal run of LETTERS with least code points or more, A-Z lower-cased, once for each occurrence. A null text has none."""
    runs = F.regexp_extract_all(F.col(text_column), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    name = free_name("_run", *others)
    return docs.select(*others, F.explode(runs).alias(name)).select(*others, F.translate(name, _UPPER, _LOWER).alias("word"))


def _placed(words: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """words (word, n, m) with the key of the block for an edit between lo and hi of a word of length m."""
    rows = words.withColumns({"lo": lo.cast("int"), "hi": hi.cast("int")})
    return rows.withColumns({"before": F.expr("left(word, lo)"), "after": F.expr("right(word, m - hi)")})


def _halves(words: DataFrame, lo: Column, hi: Column) -> DataFrame:
    middle = F.floor((lo + hi) / 2)
    return _placed(words, middle, hi).unionByName(_placed(words, lo, middle)).select("word", "n", *KEY)


def blocks_of(words: DataFrame, most: int | None = None) -> DataFrame:
    """(word, n, m, lo, hi, before, after): words in their blocks, none of which has over most words unless its stretch is one character.

    A word stands as the shorter one (or an equal) with m its own length, and as the longer one
    with m one less. A pair is looked for where the stretch holds the end of what both words begin
    with, which is one block at each level.
    """
    most = most or BLOCK
    length = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m > 0")
    open_, done = checkpointed(_halves(roles, F.lit(0), F.col("m"))), None
    while True:
        sizes = open_.groupBy(*KEY).count().where(f"count > {int(most)} and hi - lo > 1").drop("count")
        large = checkpointed(sizes)
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        small = open_.join(large, KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        # each stretch is half as long as before, so this ends after the logarithm of the longest word's length
        open_ = checkpointed(_halves(open_.join(large, KEY, "left_semi").drop("before", "after"), F.col("lo"), F.col("hi")))


def one_edit_at(a: str, b: str) -> int:
    """Where the shorter word a and b, as long or one longer, part, if b is a with one character replaced or inserted; else -1."""
    p, end = 0, len(a)
    while p < end and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return p if p < end and a[p + 1 :] == b[p + 1 :] else -1
    return p if a[p:] == b[p + 1 :] else -1


def _near_in_block(m: int, lo: int, hi: int, block: list[tuple[str, int]], found: dict[str, list]) -> None:
    """Adds to found, for each word of a block, the number of near words and the one of largest n. Pairs that part outside the stretch belong to other blocks."""

    def meet(word: str, other: str, n: int) -> None:
        held = found.get(word)
        if held is None:
            found[word] = [1, n, other]
        else:
            held[0] += 1
            if (-n, other) < (-held[1], held[2]):
                held[1:] = n, other

    last = hi == m
    shorter = [x for x in block if len(x[0]) == m]
    for k, (a, n) in enumerate(shorter):
        for b, other in shorter[k + 1 :]:
            if lo <= one_edit_at(a, b) < hi:
                meet(a, b, other), meet(b, a, n)
    if shorter:
        for b, other in block:
            if len(b) > m:
                for a, n in shorter:
                    p = one_edit_at(a, b)
                    if lo <= p < hi or (last and p == m):
                        meet(a, b, other), meet(b, a, n)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted rows block after block; a block is all that is held, and it may begin in one batch and end in another."""

    def packed(found: dict[str, list]) -> pa.RecordBatch:
        rows = list(found.items())
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), *(pa.array([x[k] for _, x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["word", "n_near", "best_n", "best"])

    key, block, found = None, [], {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "word", "n")]
        for *now, word, n in zip(*columns, strict=True):
            if now != key:
                if len(block) > 1:
                    _near_in_block(*key[:3], block, found)
                key, block = now, []
            block.append((word, n))
        if len(found) > 50_000:
            yield packed(found)
            found = {}
    if len(block) > 1:
        _near_in_block(*key[:3], block, found)
    yield packed(found)


def near_words(words: DataFrame, most: int | None = None) -> DataFrame:
    """(word, n_near, best, best_n) for every word (word: string, n: long; each word once) that has a word one edit away: how many, and the one of largest n (ties: the smallest in code-point order)."""
    rows = blocks_of(words, most)
    # each dictionary is dealt out by range of its keys; rows with one key are never parted
    sorted_rows = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    found = sorted_rows.select(*KEY, "word", "n").mapInArrow(released(_scan), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of forms (word, form; each word once, and no cycles): forms followed to the last. Each round doubles the steps taken."""
    out = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        step = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = checkpointed(out.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        out = further.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n_near, form_n) for every row of words (word: string, n: long).

    form is the near word of largest n (ties: the smallest in code-point order) if that n is at
    least ratio times the word's, else null; root is the last word along the forms. As n grows
    along them (ratio is at least 2), there are no cycles and few steps. A word given twice counts
    with the sum of its n; null words are left out; further columns are not read, whatever their
    names. A word of any length works: its blocks are parted like any other's. An empty word is near
    to none. No rows give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 at least")
    words = checkpointed(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = checkpointed(words.join(near_words(words), "word", "left"))
    held = F.col("best_n") >= ratio * F.col("n")
    near = near.select("word", F.when(held, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("best_n")).alias("form_n"))
    roots = roots_of(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
