"""Near-duplicates by SimHash.

A text's fingerprint has a bit set where over half the 64-bit hashes of its word shingles have it
set. Each fingerprint is embedded as the popcounts of its 32 two-bit segments: the Manhattan
distance of two embeddings is at most the fingerprints' Hamming distance. The range join under
that distance runs on a grid: the segments form blocks, and a distance of radius or less leaves at
least as many of them alone as there are blocks beyond the radius, so two such embeddings share the
cell of some choice of that many blocks. More fingerprints are cut into more blocks, whose cells
are finer; what is found is the same. Within a cell the Manhattan distance filters first, and the
exact distance is taken of what it lets through.

A cell gives a spanning forest of its links, never all its pairs. A cell with many fingerprints is
parted into squares of bounded size, each a task's group of its own, that together hold every pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import SLICE_BYTES, as_bytes, checkpointed, free_name, mix, powers, released, rolling_hashes, slices, word_hashes, word_spans

#: Blocks of two-bit segments, for so many differing bits at least and at most; and how many fingerprints a cell may hold by chance before there are more.
LEAST_BLOCKS, MOST_BLOCKS, CELL_CHANCE = 2, 12, 8.0
#: Fingerprints that one group compares with each other; larger cells are parted.
CELL = 2048
SEED = 42


def embed(x: np.ndarray) -> np.ndarray:
    """The popcounts of the two-bit segments, in unary: 0, 1 and 2 are 00, 01 and 11."""
    low, high = x & np.uint64(0x5555555555555555), (x >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return (low | high) | ((low & high) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of embeddings, the sum over segments of |a - b|: as many as there are unary digits that differ."""
    return np.bitwise_count(a ^ b)


def block_masks(blocks: int) -> list[int]:
    edges = [2 * (32 * k // blocks) for k in range(blocks + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose cells hold CELL_CHANCE of n unrelated fingerprints at most; a segment's popcount tells 1.5 bits of them."""
    least = max(LEAST_BLOCKS * radius, radius + 1)
    fits = (b for b in range(least, MOST_BLOCKS) if n <= CELL_CHANCE * 2 ** (1.5 * 32 * (b - radius) / b))
    return next(fits, max(least, MOST_BLOCKS))


def cell_masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks that radius differences can leave alone, its bits."""
    if not 0 <= radius < blocks <= 32:
        raise ValueError("the radius has to be less than the number of blocks, and that at most 32")
    return [sum(c) for c in itertools.combinations(block_masks(blocks), blocks - radius)]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a text in UTF-8: A-Z lower-cased, shingles of so many words joined by spaces, hashed by XXH64 with SEED; fewer words are one shingle, none give zero."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    starts = list(itertools.accumulate((len(t) + 1 for t in tokens), initial=0))
    hash64 = xxhash.xxh64_intdigest
    if n <= words:
        return hash64(joined, SEED)
    return majority(np.fromiter((hash64(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words:], strict=False)), "<u8", n - words + 1))


def fingerprints(docs: DataFrame, words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp: long, the 64 bits as a signed number) for every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                part = batch.slice(start, end - start)
                fps = np.array([fingerprint(t, words) for t in as_bytes(part.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(released(work), f"id {kind}, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (positions) that span the components of fps at a Hamming distance of radius or less."""
    left = np.arange(1, len(fps))
    todo, links = [0], []
    codes = embed(fps)
    while len(left) or todo:
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        at = todo.pop()
        if not len(left):
            break
        near = manhattan(codes[left], codes[at]) <= radius
        near[near] = np.bitwise_count(fps[left[near]] ^ fps[at]) <= radius
        if near.any():
            found = left[near].tolist()
            links += [(at, k) for k in found]
            todo += found
            left = left[~near]
    return links


def _cells(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(cell, fp): a row for each fingerprint and choice of blocks."""
    low, half = F.lit(0x5555555555555555), F.shiftrightunsigned("fp", 1)
    code = F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(low), 1).bitwiseOR(F.col("fp").bitwiseOR(half).bitwiseAND(low))
    signed = [m - (1 << 64) if m >> 63 else m for m in cell_masks(radius, blocks)]
    cells = F.array(*[F.xxhash64(F.lit(k), F.col("code").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    return distinct.withColumn("code", code).select(F.explode(cells).alias("cell"), "fp")


def _links(cells: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between fingerprints that share a cell."""
    counts = cells.groupBy("cell").count().where("count > 1")
    held = cells.join(counts, "cell").withColumn("n", F.ceil(F.col("count") / CELL).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    others = F.sequence(F.lit(0), F.col("n") - 1)
    # a cell of n parts is dealt out as squares (i, j), i <= j; each part goes to n of them
    square = F.when(F.col("n") == 1, F.array(F.col("cell"))).otherwise(F.transform(others, lambda o: F.xxhash64("cell", F.least(o, mine), F.greatest(o, mine))))
    groups = held.select(F.explode(square).alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def link(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[at, len(cell)])
            bits = fp.view(np.uint64)
            two = at[sizes == 2]
            near = manhattan(embed(bits[two]), embed(bits[two + 1])) <= radius
            two = two[near]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            a, b = [fp[two]], [fp[two + 1]]
            for k, n in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if pairs := forest(bits[k : k + n], radius):
                    x = np.array(pairs) + k
                    a.append(fp[x[:, 0]])
                    b.append(fp[x[:, 1]])
            # one task's cells often give the same link
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            cell, fp = (np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest))
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))
            rest = cell[cut:], fp[cut:]
            if cut:
                yield link(cell[:cut], fp[:cut])
        if len(rest[0]):
            yield link(*rest)

    return groups.mapInArrow(released(work), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 hexadecimal digits. Two texts are linked if their fingerprints differ in radius
    bits or fewer; component_id is the smallest id reachable by links, the row's
    own included. Null and blank texts have the fingerprint zero and are linked like any other; a
    null id counts as no id (a component of null ids only has a null component_id). Repeated rows
    stay, and further columns are not read, whatever their names. Equal fingerprints are one node,
    so copies cost nothing. A very long text is one row's work, some hundred bytes for each word.
    No rows give no rows.
    """
    rows = checkpointed(fingerprints(docs, words, id_column, text_column))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    blocks = blocks_for(distinct.count(), radius)
    roots = connected_components(_links(_cells(distinct.select("fp"), radius, blocks), radius))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(smallest, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Long fingerprints: LANES * 64 bits over shingles of FINE_WORDS words. A link is a distance of FINE_RADIUS or less.
LANES, FINE_WORDS, FINE_RADIUS = 8, 2, 68
#: Near copies: the Jaccard similarity of the sets of shingles of SET_WORDS words is SIMILAR[0] / SIMILAR[1] or more.
SET_WORDS, SIMILAR = 5, (4, 5)
#: Texts, and shingles of them, that one part of a group of candidates has at most.
PART, PART_SHINGLES = 2048, 1 << 20
#: Cells of a long fingerprint: FINE_CELLS choices of FINE_SEGMENTS of its two-bit segments, the same however many fingerprints
#: there are, so whether two of them share a cell depends on them alone.
FINE_CELLS, FINE_SEGMENTS = 48, 10


def fine_masks() -> np.ndarray:
    """(FINE_CELLS, LANES): the bits of each cell's segments."""
    rng = np.random.default_rng(5)
    masks = np.zeros((FINE_CELLS, LANES), np.uint64)
    for k in range(FINE_CELLS):
        for s in rng.choice(32 * LANES, FINE_SEGMENTS, replace=False).tolist():
            masks[k, s // 32] |= np.uint64(3 << (2 * (s % 32)))
    return masks


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted hashes of a text's shingles of SET_WORDS words, given its words' hashes; fewer words are one shingle, none give none."""
    if 0 < len(words) < SET_WORDS:
        return mix((words * powers(SET_WORDS, 0x9E3779B97F4A7C15)[: len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words)))
    return np.unique(rolling_hashes(words, SET_WORDS))


def _long_fingerprint(words: np.ndarray, seeds: np.ndarray) -> bytes:
    if not len(words):
        return bytes(8 * LANES)
    # each once: what a text repeats says nothing about its similarity, which is one of sets
    shingles = np.unique(rolling_hashes(words, FINE_WORDS) if len(words) >= FINE_WORDS else words)
    counts = np.zeros(64 * LANES, np.int64)
    for k in range(0, len(shingles), 8192):
        lanes = mix(shingles[k : k + 8192, None] ^ seeds[None, :])
        counts += np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * counts > len(shingles), bitorder="little").tobytes()


def long_fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, h, fp, name, node, n): for every row its text's 64-bit hash, its long fingerprint and that one's name, and a name and the size of its set of shingles."""
    kind = docs.schema[id_column].dataType.simpleString()
    seeds = mix(np.arange(1, LANES + 1).astype(np.uint64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(2), SLICE_BYTES // 2):
                piece = batch.slice(start, end - start)
                texts = [t.lower() for t in as_bytes(piece.column(2))]
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                data = np.frombuffer(b"".join(texts), np.uint8)
                starts, ends, first = word_spans(data, bounds)
                words = word_hashes(data, starts, ends)
                spans = list(itertools.pairwise(first.tolist()))
                fps = [_long_fingerprint(words[a:b], seeds) for a, b in spans]
                sets = [shingle_set(words[a:b]) for a, b in spans]
                nodes = [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets]
                columns = [pa.array(fps, pa.binary()), pa.array(_names(np.frombuffer(b"".join(fps), "<u8").reshape(-1, LANES))), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], ["id", "h", "fp", "name", "node", "n"])

    rows = docs.select(docs[id_column].alias("id"), F.xxhash64(F.coalesce(docs[text_column], F.lit(""))).alias("h"), docs[text_column].alias("text"))
    return rows.mapInArrow(released(work), f"id {kind}, h long, fp binary, name long, node long, n long")


def _lanes(column: pa.Array) -> np.ndarray:
    """(n, LANES) of a column of long fingerprints."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, LANES)


def _names(fps: np.ndarray) -> np.ndarray:
    """A 64-bit name of each long fingerprint."""
    return mix((fps * powers(LANES + 1, 0xD6E8FEB86659FD93)[1:]).sum(1, dtype=np.uint64)).view(np.int64)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) that span the components of a symmetric matrix of links."""
    left = np.ones(len(linked), bool)
    links = []
    for first in range(len(linked)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo:
            at = todo.pop()
            found = np.flatnonzero(linked[at] & left).tolist()
            left[found] = False
            links += [(at, k) for k in found]
            todo += found
    return links


def _all_near(fps: np.ndarray) -> np.ndarray:
    """Which of fps are within FINE_RADIUS of each other, each with each: the embeddings' distance filters, and what it lets through is compared exactly."""
    out = np.zeros((len(fps), len(fps)), bool)
    codes = embed(fps)
    for k in range(0, len(fps), 16):
        bound = np.zeros((min(16, len(fps) - k), len(fps) - k), np.uint16)
        for lane in range(LANES):
            bound += manhattan(codes[k : k + 16, None, lane], codes[None, k:, lane])
        i, j = np.nonzero(bound <= FINE_RADIUS)
        near = np.bitwise_count(fps[k + i] ^ fps[k + j]).sum(1, dtype=np.uint16) <= FINE_RADIUS
        out[k + i[near], k + j[near]] = True
    return out | out.T


def _near_in_cells(cell: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """(2, n): positions of links that span what lies within FINE_RADIUS in each cell; cell is sorted."""
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[at, len(cell)])
    links = [np.zeros((2, 0), np.int64)]
    codes = embed(fps)
    for n in np.unique(sizes[(sizes > 1) & (sizes <= 32)]).tolist():
        i, j = np.triu_indices(n, 1)
        firsts = at[sizes == n]
        step = max(1, (1 << 14) // len(i))
        for k in range(0, len(firsts), step):
            part = firsts[k : k + step, None]
            x, y = part + i, part + j
            near = manhattan(codes[x], codes[y]).sum(2, dtype=np.uint16) <= FINE_RADIUS
            near[near] = np.bitwise_count(fps[x[near]] ^ fps[y[near]]).sum(1, dtype=np.uint16) <= FINE_RADIUS
            many = near.sum(1) >= n
            links.append(np.stack([x[near & ~many[:, None]], y[near & ~many[:, None]]]))
            for c in np.flatnonzero(many).tolist():
                linked = np.zeros((n, n), bool)
                linked[i[near[c]], j[near[c]]] = True
                links.append(np.array(spanning(linked | linked.T)).T + part[c])
    for first, n in zip(at[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        if found := spanning(_all_near(fps[first : first + n])):
            links.append(np.array(found).T + first)
    return np.concatenate(links, axis=1)


def _fine_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b: names) that span the long fingerprints (fp) within FINE_RADIUS of each other in each cell. Cells of more than CELL are parted into squares, as in _links."""
    masks, odd = fine_masks(), powers(LANES + 1, 0x9E3779B97F4A7C15)[1:]

    def cells_of(part: pa.Array) -> np.ndarray:
        code = embed(_lanes(part))
        return np.concatenate([mix(((code & m) * odd).sum(1, dtype=np.uint64) + np.uint64(t)).view(np.int64) for t, m in enumerate(masks)])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                yield pa.RecordBatch.from_arrays([pa.array(cells_of(batch.column(0).slice(k, 1024)))], ["cell"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.column(0).slice(k, 1024)
                yield pa.RecordBatch.from_arrays([pa.array(cells_of(part)), pa.array(part.to_pylist() * FINE_CELLS, pa.binary())], ["cell", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64)

        def found(cell: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = _near_in_cells(cell, fps)
            both = np.stack([_names(fps[a]), _names(fps[b])])
            # one task's cells often give the same link
            both = np.unique(np.sort(both, axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            cell, fps = np.concatenate([rest[0], batch.column(0).to_numpy()]), np.concatenate([rest[1], _lanes(batch.column(1))])
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))
            rest = cell[cut:], fps[cut:]
            if cut:
                yield found(cell[:cut], fps[:cut])
        if len(rest[0]):
            yield found(*rest)

    hot = nodes.select("fp").mapInArrow(released(name), "cell long").groupBy("cell").count().where(F.col("count") > CELL)
    # a hot cell takes CELL rows of FINE_CELLS for each fingerprint, so the list of them is short
    dealt = nodes.select("fp").mapInArrow(released(deal), "cell long, fp binary").join(F.broadcast(hot), "cell", "left")
    n = F.ceil(F.coalesce("count", F.lit(1)) / CELL).cast("int")
    mine = F.pmod(F.xxhash64("fp"), n).cast("int")
    square = F.when(n == 1, F.array("cell")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.xxhash64("cell", F.least(o, mine), F.greatest(o, mine))))
    groups = dealt.select(F.explode(square).alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
    return groups.mapInArrow(released(link), "a long, b long").distinct()


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that span the components of sets, given as sorted arrays, at a Jaccard similarity of SIMILAR or more. Sets without members are left out."""
    sizes = np.array([len(x) for x in sets], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    held = np.bincount(at, minlength=len(values))
    start = np.r_[0, np.cumsum(held)]
    left, links = sizes > 0, []
    for k in np.flatnonzero(left).tolist():
        if not left[k]:
            continue
        left[k] = False
        todo = [k]
        while todo and left.any():
            x = todo.pop()
            mine = at[first[x] : first[x + 1]]
            n = held[mine]
            others = owners[np.repeat(start[mine] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            common = np.bincount(others, minlength=len(sets))
            found = np.flatnonzero(left & (common * sum(SIMILAR) >= SIMILAR[0] * (sizes + sizes[x]))).tolist()
            left[found] = False
            links += [(x, y) for y in found]
            todo += found
    return links


def _similar_in_groups(texts: DataFrame) -> DataFrame:
    """Links (a, b: nodes) between texts (groups: array of long, node, text) of a group that are near copies, by the exact similarity of their sets of shingles."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2), SLICE_BYTES // 2):
                piece = batch.slice(lo, hi - lo)
                held = [t.lower() for t in as_bytes(piece.column(2))]
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)
                data = np.frombuffer(b"".join(held), np.uint8)
                starts, ends, first = word_spans(data, bounds)
                words = word_hashes(data, starts, ends)
                sets = [shingle_set(words[a:b]).tobytes() for a, b in itertools.pairwise(first.tolist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(sets, pa.binary())], ["groups", "node", "shingles"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def found() -> pa.RecordBatch:
            links = np.array(similar_links(sets), np.int64).reshape(-1, 2)
            named = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(named[links[:, 0]]), pa.array(named[links[:, 1]])], ["a", "b"])

        for batch in batches:
            for g, node, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if len(nodes) > 1:
                        yield found()
                    group, nodes, sets = g, [], []
                if not nodes or node != nodes[-1]:  # repeated rows follow each other
                    nodes.append(node)
                    sets.append(np.frombuffer(x, np.uint64))
        if len(nodes) > 1:
            yield found()

    sets = texts.select("groups", "node", "text").mapInArrow(released(sets_of), "groups array<long>, node long, shingles binary")
    groups = sets.select(F.explode("groups").alias("g"), "node", "shingles").repartition("g").sortWithinPartitions("g", "node")
    return groups.mapInArrow(released(link), "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest id (of equal ids, the smallest text hash).

    Texts are near copies if their sets of five-word shingles (words with A-Z lower-cased; fewer
    words are one shingle) have a Jaccard similarity of 0.8 or more. Components of long fingerprints
    that differ in FINE_RADIUS bits or fewer are the candidates; in each, texts are compared exactly,
    and groups are the components of what is similar. Rows alike in id and text count once. Null
    and blank texts are copies of each other; a null id counts as the largest. All columns stay,
    whatever their names. A very long text is one row's work. No rows give no rows.
    """
    rows = checkpointed(long_fingerprints(docs, id_column, text_column))
    nodes = checkpointed(rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "fp", "name", "n")).alias("least")).select("node", "least", "least.fp", "least.name", "least.n"))
    loose = connected_components(_fine_links(nodes.select("fp").distinct()).select("a", "b"))
    near = nodes.join(loose, nodes["name"] == loose["node"], "left").select(nodes["node"], "least", "n", F.coalesce("root", "name").alias("g"))
    groups = near.groupBy("g").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).where("texts > 1")
    near = near.join(groups, "g").withColumn("parts", F.greatest(F.ceil(F.col("texts") / PART), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # a group of several parts is dealt out as squares (i, j), i <= j
    square = F.when(F.col("parts") == 1, F.array("g")).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("g", F.least(o, mine), F.greatest(o, mine))))
    near = near.select("node", F.col("least.id").alias("_id"), F.col("least.h").alias("_h"), square.alias("groups"))
    texts = docs.select(docs[id_column].alias("id"), F.xxhash64(F.coalesce(docs[text_column], F.lit(""))).alias("h"), docs[text_column].alias("text"))
    texts = texts.join(near, texts["id"].eqNullSafe(near["_id"]) & (texts["h"] == near["_h"])).select("groups", "node", "text")
    roots = connected_components(_similar_in_groups(texts))
    of = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    stay = of.groupBy("root").agg(F.min("least").alias("x")).select(F.col("x.id").alias("_id"), F.col("x.h").alias("_h"))
    # plain keys, so that the rows that the join has brought together need not move again to count once
    a, b, c = (free_name(n, *docs.columns) for n in ("_id", "_none", "_h"))
    hashed = docs.withColumns({a: F.coalesce(docs[id_column].cast("string"), F.lit("")), b: docs[id_column].isNull(), c: F.xxhash64(F.coalesce(docs[text_column], F.lit("")))})
    stay = stay.select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias(a), F.col("_id").isNull().alias(b), F.col("_h").alias(c))
    return hashed.join(stay, [a, b, c], "left_semi").dropDuplicates([a, b, c]).select(*docs.columns)
