"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

Words are runs of letters and digits in lower case. A window of a document has as many shingles as
some benchmark item. Windows and items get SimHash fingerprints of their shingles' hashes. Two
fingerprints within the radius differ in few bits of one of BLOCKS blocks at least; all values that
near are listed for the items' blocks, and windows and items meet by length, block and value. Pairs
within the radius are compared exactly, by the weighted Jaccard similarity of the shingles with
their counts as weights. All of it is made of built-in expressions.

Fingerprints are only made of windows that can reach the similarity with some item of their length:
it bounds from below how many of the window's shingles occur in items of that length, and filters of
those shingles, which never miss one, count them.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import array_literal, checkpointed, let

#: Words in a shingle; a shorter item is one shingle by itself.
SHINGLE = 5
#: Shingles of the benchmark in one pass over the documents: a bound for the filters in the expressions. A larger benchmark takes several passes.
PASS_SHINGLES = 200_000
#: Items whose blocks' values are broadcast, some 50 kilobytes each; more are joined by a shuffle.
BROADCAST_ITEMS = 500
#: Bits for each shingle of a filter.
FILTER_BITS = 32
#: Words (of 64 bits) and blocks of a fingerprint, and the radius in which 999 in 1000 windows with a similarity of 0.8 lie.
LANES, BLOCKS, RADIUS = 2, 11, 32
SIMILARITY = 0.8
#: Places of a document at which windows start, worked on together: a bound for a row, however long the text.
REGION = 1024

NO_LONGS = "cast(array() as array<bigint>)"
NO_WINDOWS = "cast(array() as array<struct<n:int,start:int,window:array<bigint>>>)"


def content_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, size: int) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, hashes).otherwise(F.expr(NO_LONGS))


def simhash(hashes: Column) -> Column:
    """64 bits, each set where over half the hashes have it set."""
    one = F.lit(1).cast("long")
    bit = lambda b: F.when(2 * F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) > F.size(hashes), F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(bit(b)))


def fingerprint(hashes: Column) -> list[Column]:
    """LANES words of a fingerprint: each is the SimHash of the hashes, hashed once more by the word's number."""

    def again(k: int) -> Column:
        return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))) if k else hashes

    return [simhash(again(k)) for k in range(LANES)]


def block_edges() -> list[tuple[int, int, int]]:
    """(word, first bit, end) of each block; none lies across two words."""
    out = []
    for lane in range(LANES):
        n = BLOCKS * (lane + 1) // LANES - BLOCKS * lane // LANES
        out += [(lane, a, b) for a, b in itertools.pairwise([64 * k // n for k in range(n + 1)])]
    return out


def block_value(fp: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def blocks(fps: list[Column]) -> Column:
    """The value of each block."""
    return F.array(*[F.struct(F.lit(k).alias("block"), block_value(fps[lane], lo, hi).alias("value")) for k, (lane, lo, hi) in enumerate(block_edges())])


def blocks_near(fps: list[Column], radius: int) -> Column:
    """For each block all values that differ from its own in so few bits as one block must, if all together differ in radius."""

    def near(k: int, lane: int, lo: int, hi: int) -> Column:
        flips = [sum(1 << b for b in c) for n in range(min(radius // BLOCKS, hi - lo) + 1) for c in itertools.combinations(range(hi - lo), n)]
        own = block_value(fps[lane], lo, hi)
        return F.transform(array_literal(flips), lambda m: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*[near(k, *edge) for k, edge in enumerate(block_edges())]))


def first_near_block(differences: list[Column], radius: int) -> Column:
    """The first block in which two fingerprints are that near, so that a pair is met once only."""
    out = F.lit(None).cast("int")
    for k, (lane, lo, hi) in reversed(list(enumerate(block_edges()))):
        out = F.when(F.bit_count(block_value(differences[lane], lo, hi)) <= radius // BLOCKS, F.lit(k)).otherwise(out)
    return out


def weighted_similarity(a: Column, b: Column) -> Column:
    """The weighted Jaccard similarity of two arrays, with counts as weights."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    common = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)))
    return common / (F.size(a) + F.size(b) - common)


class Filter:
    """A Bloom filter of hashes, as a constant of the expressions; n bounds how many there are."""

    def __init__(self, hashes: DataFrame, n: int) -> None:
        self.bits = max(64, 1 << (FILTER_BITS * n - 1).bit_length())
        at = F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32)))
        words = hashes.select(at.alias("x")).select(F.col("x").bitwiseAND(F.lit(self.bits - 1)).alias("x"))
        words = words.groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("v"))
        values = [0] * (self.bits // 64)
        for r in words.collect():
            values[r["w"]] = r["v"]
        self.table = array_literal(values)

    def holds(self, h: Column) -> Column:
        def probe(x: Column) -> Column:
            at = x.bitwiseAND(F.lit(self.bits - 1))
            return F.getbit(F.get(self.table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        return probe(h) & probe(F.shiftrightunsigned(h, 32))


def _least_shared(n: int, similarity: float) -> tuple[int, int]:
    """How many shingles a window of n has in common, at least, with an item of n at the similarity; and so a shorter one at a text's end."""
    return max(1, math.ceil(2 * similarity * n / (1 + similarity) - 1e-9)), max(1, math.ceil(similarity * n - 1e-9))


def _starts(own: Column, part: Column, n: Column, least: Column, low: Column, high: Column) -> Column:
    """Where windows of n shingles start, from low to high, that hold least of own, the sorted places of shingles that count. Each is found by the first place it holds."""

    def by_first(j: Column) -> Column:
        first, last = F.get(own, j), F.get(own, j + least - 1)
        lo = F.greatest(F.coalesce(F.get(own, j - 1) + 1, F.lit(0)), last - n + 1, low)
        hi = F.least(first, high)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.expr("cast(array() as array<int>)"))

    js = F.when(F.size(own) >= least, F.sequence(F.lit(0), F.size(own) - least)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.flatten(F.transform(js, by_first))


def candidate_windows(rows: DataFrame, any_length: Filter, by_length: Filter, size: int, lengths: list[int], similarity: float) -> DataFrame:
    """(id, n, start, window) of rows (id, text): the windows of n shingles, an item's number, of which so many occur in items of that length that they may reach the similarity. Shingles have size words."""
    least = [_least_shared(n, similarity) for n in lengths]
    fewest, reach = min(b for _, b in least), REGION + max(lengths) - 1

    def regions(hashes: Column) -> Column:
        """Stretches of the text whose windows start in one region, where enough shingles occur in any item."""
        enough = lambda x: F.size(F.filter(x, any_length.holds)) >= fewest
        cut = lambda b: F.struct(b.alias("base"), (b + reach >= F.size(hashes)).alias("ends"), F.slice(hashes, b + 1, reach).alias("part"))
        made = F.transform(F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(REGION)), cut)
        return F.when((F.size(hashes) > 0) & enough(hashes), F.filter(made, lambda r: enough(r["part"])))

    # the words and their shingles are bound inside one expression, so that they are made once for each text
    held = rows.select("id", F.explode(let(content_words(F.col("text")), lambda w: let(shingle_hashes(w, size), regions))).alias("r")).select("id", "r.*")
    known = F.arrays_zip(array_literal(lengths, "int").alias("n"), array_literal([a for a, _ in least], "int").alias("whole"), array_literal([b for _, b in least], "int").alias("short"))

    def windows(part: Column) -> Column:
        here = F.size(part)
        places = F.filter(F.sequence(F.lit(0), here - 1), lambda i: any_length.holds(F.get(part, i)))

        def of_length(x: Column, places: Column) -> Column:
            n = x["n"]

            def both(own: Column) -> Column:
                whole = _starts(own, part, n, x["whole"], F.lit(0), F.least(F.lit(REGION - 1), here - n))
                # at the text's end a window may have fewer shingles
                short = F.when(F.col("ends"), _starts(own, part, n, x["short"], F.greatest(here - n + 1, F.lit(0)), F.lit(REGION - 1))).otherwise(F.expr("cast(array() as array<int>)"))
                return F.transform(F.concat(whole, short), lambda s: F.struct(n.alias("n"), (F.col("base") + s).alias("start"), F.slice(part, s + 1, n).alias("window")))

            own = F.filter(places, lambda p: by_length.holds(F.xxhash64(F.get(part, p), n)))
            return F.when(F.size(places) >= x["short"], let(own, both)).otherwise(F.expr(NO_WINDOWS))

        return let(places, lambda p: F.flatten(F.transform(known, lambda x: of_length(x, p))))

    return held.select("id", F.explode(windows(F.col("part"))).alias("x")).select("id", "x.*")


def _matches(rows: DataFrame, items: DataFrame, size: int, n_items: int, n: int, lengths: list[int], radius: int, similarity: float) -> DataFrame:
    """Matches of one group of items whose shingles have size words; n bounds how many shingles these are."""
    shingles = items.select("n", F.explode("hashes").alias("h"))
    any_length, by_length = Filter(shingles.select("h"), n), Filter(shingles.select(F.xxhash64("h", "n").alias("h")), n)
    names = [f"fp{k}" for k in range(LANES)]
    windows = candidate_windows(rows, any_length, by_length, size, lengths, similarity)
    windows = windows.select("*", *[f.alias(x) for x, f in zip(names, fingerprint(F.col("window")), strict=True)])
    dealt = windows.select("*", F.explode(blocks([F.col(x) for x in names])).alias("b")).select("id", "n", "start", "window", *names, "b.*")
    known = items.select("item", "n", "hashes", *[F.col(x).alias(f"item_{x}") for x in names])
    near = known.drop("hashes").select("*", F.explode(blocks_near([F.col(f"item_{x}") for x in names], radius)).alias("b")).select("item", "n", *[f"item_{x}" for x in names], "b.*")
    hashes = known.select("item", "n", "hashes")
    if n_items <= BROADCAST_ITEMS:
        near, hashes = F.broadcast(near), F.broadcast(hashes)
    differences = [F.col(x).bitwiseXOR(F.col(f"item_{x}")) for x in names]
    hamming = sum((F.bit_count(d) for d in differences[1:]), F.bit_count(differences[0])).cast("int")
    pairs = dealt.join(near, ["n", "block", "value"]).withColumn("hamming", hamming).where((F.col("block") == first_near_block(differences, radius)) & (F.col("hamming") <= radius))
    found = pairs.select("id", "item", "n", "start", "window", "hamming").join(hashes, ["item", "n"]).withColumn("similarity", weighted_similarity(F.col("window"), F.col("hashes")))
    return found.where(F.col("similarity") >= similarity).select("id", "item", "start", (F.col("n") + size - 1).alias("length"), "hamming", "similarity")


def find_benchmark_passages(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, item, start, length, hamming, similarity): for each document and benchmark item the window most like the item, if that is similarity or more.

    start and length count words. Null and blank texts have no words and match nothing, as do
    items without words; an item of fewer than SHINGLE words has to occur as it is. Items with
    equal texts are all named. Rows that share an id are taken together, null ids too. Of equally
    similar windows the first is named. A very long text is worked on in regions once its shingles
    are made. No rows on either side give no rows; further columns are not read, whatever their
    names. A match whose fingerprint lies beyond the radius is missed: one in 1000 at the
    similarity itself, fewer above it.
    """
    items = benchmark.select(benchmark[item_column].alias("item"), content_words(benchmark[item_text_column]).alias("words")).withColumn("length", F.size("words")).where("length > 0").distinct()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    counted = items.withColumn("size", F.least("length", F.lit(SHINGLE))).groupBy("size", "length").count().collect()  # a row for each length
    found = None
    for size in sorted({r["size"] for r in counted}):
        held = [r for r in counted if r["size"] == size]
        n, n_items, lengths = sum((r["length"] - size + 1) * r["count"] for r in held), sum(r["count"] for r in held), sorted(r["length"] - size + 1 for r in held)
        own = items.where((F.col("length") == size) if size < SHINGLE else (F.col("length") >= size)).select("item", (F.col("length") - size + 1).alias("n"), shingle_hashes(F.col("words"), size).alias("hashes"))
        # written once: filters that the optimizer infers would otherwise repeat the work inside the lambdas
        own = checkpointed(own)
        own = checkpointed(own.select("*", *[f.alias(f"fp{k}") for k, f in enumerate(fingerprint(F.col("hashes")))]))
        groups = -(-n // PASS_SHINGLES)
        for g in range(groups):
            part = own if groups == 1 else own.where(F.pmod(F.xxhash64("hashes"), F.lit(groups)) == g)
            more = _matches(rows, part, size, n_items, n if groups == 1 else 2 * PASS_SHINGLES, lengths, radius, similarity)
            found = more if found is None else found.unionByName(more)
    if found is None:
        kind = benchmark.schema[item_column].dataType
        found = rows.where("false").select("id", F.lit(None).cast(kind).alias("item"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).alias("hamming"), F.lit(0.0).alias("similarity"))
    best = found.groupBy("id", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "length", "hamming")).alias("x"))
    return best.select(F.col("id").alias(id_column), F.col("item").alias(item_column), "x.start", "x.length", "x.hamming", (-F.col("x.s")).alias("similarity"))
