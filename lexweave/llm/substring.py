"""Substring dedup by fixed-block anchors.

Every text is cut into blocks of BLOCK words from its start, and the blocks are indexed by hash: for
each the smallest and the largest id that has it. Every rolling window of BLOCK words of every text
probes the index. A run of SPAN = 2 * BLOCK words that two texts share holds a whole block of either
text, wherever it starts, so in both texts a rolling window hits a block of the other. Around its
hits a text is extended: every window of SPAN words that holds a hit is hashed, and the smallest id
that each starts in is found. Runs of such windows are the maximal exact repeats.

Probes and windows travel as packed arrays, one row for a slice of texts and a part of the hash
space. The number of parts grows with the words, so a part stays small. Within a part the index
comes first and is held; probes stream past it, so a hash that very many texts share is one entry
of the index, and its probes are never held. Blocks that more than a HOT_SHARE-th of all blocks
equal are few: they are sent to where the probes are made, and windows that hold one are spread
over several parts, to which the index's entries for them are copied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, as_bytes, checkpointed, mix, released, rolling_hashes, slices, word_hashes, word_spans

BLOCK = 25
SPAN = 2 * BLOCK
#: Words of all texts for each part of the hash space. Beyond MANY_PARTS of them parts grow, up to MOST_WORDS, so that a slice still has some words for each.
WORDS_PER_PART, MANY_PARTS, MOST_WORDS = 4 << 20, 1 << 14, 64 << 20
#: Parts for each megabyte of a slice: more parts have longer slices, up to so many times as long, so that their rows stay worth packing.
PARTS_PER_SLICE, MOST_SLICES = 2048, 16
#: A block is hot if more than a HOT_SHARE-th of all blocks, and more than HOT_LEAST, equal it.
HOT_SHARE, HOT_LEAST = 10_000, 1000
#: Bits of the filter of ids, for each id, and at most.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 26
#: What a hit says of its text: a smaller id has the block, a larger one has, the block is hot.
LATER, EARLIER, HOT = 1, 2, 4
#: Of rows that travel to a part: the index, what probes it, and hits that are known already.
INDEX, PROBES, KNOWN = 0, 1, 2


class Slice:
    """The words of some texts: hashes, and each text's first word."""

    def __init__(self, texts: list[bytes]) -> None:
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts, self.ends, self.first = word_spans(self.data, self.bounds)
        self.words = word_hashes(self.data, self.starts, self.ends)
        self.counts = np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window within one text: its hash, text and first word."""
        hashes = rolling_hashes(self.words, size)
        text = np.repeat(np.arange(len(self.counts)), self.counts)[: len(hashes)]
        at = np.arange(len(hashes))
        inside = at + size <= self.first[1:][text]
        return hashes[inside], text[inside], at[inside]


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)] if len(x) else np.zeros(1, int)


def _by_part(kind: int, part: np.ndarray, columns: dict[str, np.ndarray], text: np.ndarray | None = None, ids: np.ndarray | None = None, sums: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each part with its entries' columns as bytes; given the entries' texts, also the ids (and sums) of the texts in it and how many entries each has."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], {n: c[order] for n, c in columns.items()}
    text = text[order] if text is not None else None
    edges = _edges(part)
    rows: dict[str, list] = {n: [] for n in ("ids", "sums", "counts", *columns)}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if text is not None:
            cut = _edges(text[a:b])
            rows["ids"].append(ids[text[a + cut[:-1]]].astype("<i8").tobytes())
            rows["counts"].append(np.diff(cut).astype("<u4").tobytes())
            if sums is not None:
                rows["sums"].append(sums[text[a + cut[:-1]]].astype("<u4").tobytes())
        for name, c in columns.items():
            rows[name].append(c[a:b].tobytes())
    n = len(edges) - 1
    held = {x: pa.array(rows.get(x) or [None] * n, pa.binary()) for x in ("ids", "sums", "counts", "keys", "checks", "places", "least", "most")}
    yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]] if n else [], pa.int32()), pa.array([kind] * n, pa.int8()), *held.values()], ["part", "kind", *held])


SHAPE = "part int, kind byte, ids binary, sums binary, counts binary, keys binary, checks binary, places binary, least binary, most binary"


def _joined(rows: list[dict], name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def _by_text(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """(id, found): a row for each id, with its values as bytes."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    edges = _edges(ids).tolist()
    found = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids[edges[:-1]] if len(ids) else [], pa.int64()), pa.array(found, pa.binary())], ["id", "found"])


def _gathered(rows: DataFrame, parts: int) -> DataFrame:
    """(id, found: bytes): all values of each id, of rows as _by_part gives them, dealt by the ids' parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def values() -> pa.RecordBatch:
            return _by_text(np.repeat(_joined(held, "ids", "<i8"), _joined(held, "counts", "<u4")), _joined(held, "keys", "<u8"))

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield values()
                    part, held = row["part"], []
                held.append(row)
        if held:
            yield values()

    return rows.select("part", "ids", "counts", "keys").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(released(work), "id long, found binary")


def _answered(rows: DataFrame, parts: int, index_of, answer, most: int = 4 << 20) -> DataFrame:
    """(id, found: bytes) of rows as _by_part gives them. index_of(rows) makes a part's index of its rows of that kind; answer(index, part, kind, ids, rows) gives (ids, values) of some rows that come after."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, index, waiting, size = None, [], None, [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            for kind in (PROBES, KNOWN):
                if rows := [r for r in waiting if r["kind"] == kind]:
                    ids, values = answer(index, part, kind, np.repeat(_joined(rows, "ids", "<i8"), _joined(rows, "counts", "<u4")), rows)
                    order = np.argsort(ids, kind="stable")
                    own, text = np.unique(ids[order], return_inverse=True)
                    target = (mix(own.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                    yield from _by_part(KNOWN, target[text], {"keys": values[order].astype("<u8")}, text, own)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if row["part"] != part:
                    yield from answers()
                    part, held, index, waiting, size = row["part"], [], None, [], 0
                if row["kind"] == INDEX:
                    held.append(row)
                    continue
                if index is None:
                    index, held = index_of(held), []
                waiting.append(row)
                size += len(row["keys"])
                if size > most:
                    yield from answers()
                    waiting, size = [], 0
        yield from answers()

    sorted_rows = rows.repartition(parts, "part").sortWithinPartitions("part", "kind")
    return _gathered(sorted_rows.mapInArrow(released(work), SHAPE), parts)


def _keys(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of a hash and 31 bits that tell it from most others there."""
    return (hashes % np.uint64(parts)).astype(np.int32), (hashes >> np.uint64(33)).astype("<u4")


def _named(key: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """31 bits of a hash and its part, which is less than 2**30, with three bits left."""
    return key.astype(np.uint64) << np.uint64(33) | np.asarray(part).astype(np.uint64) << np.uint64(3)


def _lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are in known, which is sorted, and where."""
    if not len(known):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), int)
    place = np.searchsorted(known, wanted).clip(max=len(known) - 1)
    return known[place] == wanted, place


def _least_and_most(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys sorted, each once, with its smallest and largest id."""
    order = np.argsort(keys, kind="stable")
    at = _edges(keys[order])[:-1]
    if not len(at):
        return keys, least, most
    return keys[order][at], np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)


def _flags(ids: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    return (LATER * (least < ids) + EARLIER * (most > ids)).astype(np.uint64)


def index_blocks(rows: DataFrame) -> DataFrame:
    """(h, least, most, n): every block of texts of SPAN words or more, the smallest and largest id that has it, and how often it occurs. Counted in each slice before anything is shuffled."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                piece = batch.slice(start, end - start)
                s = Slice(as_bytes(piece.column(1)))
                hashes, text, at = s.windows(BLOCK)
                mine = ((at - s.first[:-1][text]) % BLOCK == 0) & (s.counts[text] >= SPAN)
                hashes, ids = hashes[mine], piece.column(0).to_numpy(zero_copy_only=False)[text[mine]]
                keys, least, most = _least_and_most(hashes, ids, ids)
                n = np.diff(_edges(np.sort(hashes)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array(n, pa.int64())], ["h", "least", "most", "n"])

    found = rows.mapInArrow(released(blocks), "h long, least long, most long, n long")
    return found.groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))


class HotBlocks:
    """The hot blocks of an index, HOT_SHARE at most, and the ids that have them; spread: over how many parts a window that holds one is dealt."""

    def __init__(self, index: DataFrame, total: int) -> None:
        self.limit = max(HOT_LEAST, total // HOT_SHARE)
        held = np.array([tuple(r) for r in index.where(F.col("n") > self.limit).collect()], np.int64).reshape(-1, 4)
        held = held[np.argsort(held[:, 0].view(np.uint64))]
        self.hashes, self.least, self.most = held[:, 0].copy().view(np.uint64), held[:, 1], held[:, 2]
        self.spread = max(1, -(-int(held[:, 3].max(initial=0)) * BLOCK // WORDS_PER_PART))


def _slice_bytes(parts: int) -> int:
    return SLICE_BYTES * min(max(1, parts // PARTS_PER_SLICE), MOST_SLICES)


def find_hits(rows: DataFrame, index: DataFrame, hot: HotBlocks, parts: int) -> DataFrame:
    """(id, found: bytes): for each text 64-bit numbers, as _named gives them, of its rolling windows that equal a block of another text, with LATER, EARLIER and HOT."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1), _slice_bytes(parts)):
                piece = batch.slice(start, end - start)
                s = Slice(as_bytes(piece.column(1)))
                hashes, text, _ = s.windows(BLOCK)
                enough = s.counts[text] >= SPAN
                hashes, text = hashes[enough], text[enough]
                ids = piece.column(0).to_numpy(zero_copy_only=False)
                known, place = _lookup(hot.hashes, hashes)
                part, key = _keys(hashes, parts)
                yield from _by_part(PROBES, part[~known], {"keys": key[~known]}, text[~known], ids)
                if known.any():
                    own, place = ids[text[known]], place[known]
                    values = _named(key[known], part[known]) | _flags(own, hot.least[place], hot.most[place]) | np.uint64(HOT)
                    # these are found already: they only have to reach their text, by any part
                    yield from _by_part(KNOWN, np.full(len(values), int(own[0]) % parts, np.int32), {"keys": values.astype("<u8")}, text[known], ids)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, least, most = (batch.column(k).to_numpy() for k in range(3))
            part, key = _keys(h.view(np.uint64), parts)
            yield from _by_part(INDEX, part, {"keys": key, "least": least, "most": most})

    def index_of(held: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _least_and_most(_joined(held, "keys", "<u4"), _joined(held, "least", "<i8"), _joined(held, "most", "<i8"))

    def answer(index: tuple, part: int, kind: int, ids: np.ndarray, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        if kind == KNOWN:
            values = _joined(rows, "keys", "<u8")
        else:
            keys = _joined(rows, "keys", "<u4")
            hit, place = _lookup(index[0], keys)
            ids, place = ids[hit], place[hit]
            values = _named(keys[hit], part) | _flags(ids, index[1][place], index[2][place])
        other = values & np.uint64(LATER | EARLIER) > 0
        return ids[other], values[other]

    known = index.where(F.col("n") <= hot.limit).select("h", "least", "most").mapInArrow(released(indexed), SHAPE)
    return _answered(known.unionByName(rows.mapInArrow(released(probe), SHAPE)), parts, index_of, answer)


def _id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of ids with two probes; its size has a bound, beyond which it lets more through but never less."""
    n = ids.count()
    bits = min(max(FILTER_BITS * n, 1 << 12), MOST_FILTER_BITS)
    probe = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits))
    words = ids.select(F.explode(F.array(probe(0), probe(1))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    out = np.zeros(bits // 64 + 1, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["v"]
    return out.view(np.uint64), bits


def _parted(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be in ids, among them all whose id is; and the other rows."""
    words, bits = _id_filter(ids)
    keyed = rows.select("id", "text", F.pmod(F.xxhash64("id", F.lit(0)), F.lit(bits)).alias("p"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(bits)).alias("q"))

    def side(wanted: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                for k in (2, 3):
                    bit = batch.column(k).to_numpy()
                    mask &= (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
                yield batch.select(["id", "text"]).filter(pa.array(mask == wanted))

        return keyed.mapInArrow(released(keep), "id long, text string")

    return side(True), side(False)


def _windows_near(s: Slice, held: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Hash, text and first word of the windows of SPAN words that hold a hit of their text (held: each text's hits); and for each of LATER, EARLIER and HOT which of them hold such a one."""
    hashes, text, at = s.windows(BLOCK)
    part, key = _keys(hashes, parts)
    names = _named(key, part)
    hits, owners = np.concatenate([*held, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(held)), [len(x) for x in held])
    flags, hits = hits & np.uint64(7), hits & ~np.uint64(7)
    known = np.unique(hits)
    seen, place = _lookup(known, names)
    # hits of one text only count in that text
    pairs = owners * len(known) + np.searchsorted(known, hits)
    order = np.argsort(pairs, kind="stable")
    pairs, flags = pairs[order], flags[order]
    own, which = _lookup(pairs, text * len(known) + place)
    own &= seen
    at, which = at[own], which[own]
    hashes, text, first = s.windows(SPAN)
    held_by = {}
    for flag in (LATER, EARLIER, HOT):
        near = np.zeros(len(s.words) + SPAN + 2, np.int32)
        mine = at[flags[which] & np.uint64(flag) > 0]
        # a window of SPAN words from j on holds the hit at t if t - BLOCK <= j <= t
        np.add.at(near, np.maximum(mine - BLOCK, 0), 1)
        np.add.at(near, mine + 1, -1)
        held_by[flag] = np.cumsum(near)[first] > 0
    return hashes, text, first, held_by


def find_repeats(rows: DataFrame, hits: DataFrame, spread: int, parts: int) -> DataFrame:
    """(id, found: bytes): for those windows of SPAN words that also start in a text with a smaller id, 32 bits of their first word's number, above them their text's checksum, as several texts may share an id. Windows count as equal if two hashes, 96 bits in all, are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1), _slice_bytes(parts) // 2):
                piece = batch.slice(start, end - start)
                texts = as_bytes(piece.column(1))
                s = Slice(texts)
                sums = np.array([zlib.crc32(t) for t in texts], np.uint32)
                ids = piece.column(0).to_numpy()
                held = [np.frombuffer(x, "<u8") for x in piece.column(2).to_pylist()]
                hashes, text, first, near = _windows_near(s, held, parts)
                checks = (rolling_hashes(mix(s.words), SPAN)[first] >> np.uint64(32)).astype("<u4")
                # what hot windows are compared with is copied to spread parts, and each of their texts goes to one of these
                turns = np.where(near[HOT], spread, 1)
                part = lambda k, turn: ((hashes[k] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32)  # noqa: E731, B023
                late = np.flatnonzero(near[LATER])
                yield from _by_part(PROBES, part(late, ids[text[late]] % turns[late]), {"keys": hashes[late], "checks": checks[late], "places": (first[late] - s.first[:-1][text[late]]).astype("<u4")}, text[late], ids, sums)
                early = np.flatnonzero(near[EARLIER])
                early = early[np.lexsort((ids[text[early]], checks[early], hashes[early]))]
                # each once, with the smallest id of this slice
                early = early[np.r_[True, (hashes[early[1:]] != hashes[early[:-1]]) | (checks[early[1:]] != checks[early[:-1]])]] if len(early) else early
                turn = np.arange(turns[early].sum()) - np.repeat(np.cumsum(turns[early]) - turns[early], turns[early])
                early = np.repeat(early, turns[early])
                yield from _by_part(INDEX, part(early, turn), {"keys": hashes[early], "checks": checks[early], "least": ids[text[early]].astype("<i8")})

    def index_of(held: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        keys, checks, least = _joined(held, "keys", "<u8"), _joined(held, "checks", "<u4"), _joined(held, "least", "<i8")
        order = np.lexsort((least, checks, keys))
        keys, checks, least = keys[order], checks[order], least[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])] if len(keys) else np.zeros(0, bool)
        keys = keys[new]
        return keys, checks[new], least[new], int(np.diff(_edges(keys)).max(initial=0))

    def answer(index: tuple, part: int, kind: int, ids: np.ndarray, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        keys, checks, places = _joined(rows, "keys", "<u8"), _joined(rows, "checks", "<u4"), _joined(rows, "places", "<u4")
        sums = np.repeat(_joined(rows, "sums", "<u4"), _joined(rows, "counts", "<u4"))
        later = np.zeros(len(keys), bool)
        hit, place = _lookup(index[0], keys)
        for step in range(index[3]):  # once, unless different windows have one hash
            at = (place + step).clip(max=len(index[0]) - 1)
            later |= hit & (index[0][at] == keys) & (index[1][at] == checks) & (index[2][at] < ids)
        return ids[later], sums[later].astype(np.uint64) << np.uint64(32) | places[later]

    held = _parted(rows, hits.select("id"))[0].join(hits, "id").select("id", "text", "found")
    return _answered(held.mapInArrow(released(pack), SHAPE), parts, index_of, answer)


RESULT = "id long, n_words long, n_removed long, kept string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and the kept words of (id, text, found) rows."""
    for batch in batches:
        for start, end in slices(batch.column(1)):
            piece = batch.slice(start, end - start)
            words, removed, kept = [], [], []
            for text, found in zip(as_bytes(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                tokens = text.split()
                if found:
                    edge = np.zeros(len(tokens) + 1, np.int64)
                    at = np.unique(np.frombuffer(found, "<u8"))
                    at = (at[at >> np.uint64(32) == zlib.crc32(text)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    at = at[at + SPAN <= len(tokens)]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + SPAN, -1)
                    left = [tokens[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                else:
                    left = tokens
                words.append(len(tokens))
                removed.append(len(tokens) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row of docs: kept is the text's words, joined by one space, without those in a window of SPAN words that also starts in a text with a smaller id.

    Words are runs of other bytes than space and U+0009 to U+000D, compared unchanged. Windows are
    judged on the input. A null text has no words; a row with a null id takes no part and keeps
    all its words; rows that share an id are one source, neither smaller than the other. Further
    columns are not read, whatever their names. Ids have to be whole numbers. A very long text is
    one slice by itself, some hundred bytes for each of its words. No rows give no rows.
    """
    rows = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    with_id = rows.where("id is not null")
    index = checkpointed(index_blocks(with_id))
    total = index.agg(F.sum("n")).first()[0] or 0
    words = total * BLOCK
    parts = parts or max(1, -(-words // min(max(WORDS_PER_PART, words // MANY_PARTS), MOST_WORDS)))
    hot = HotBlocks(index, total)
    hits = checkpointed(find_hits(with_id, index, hot, parts))
    repeats = checkpointed(find_repeats(with_id, hits, hot.spread, parts))
    maybe, clear = _parted(rows, repeats.select("id"))
    # only texts that may lose words are shuffled
    joined = maybe.join(repeats, "id", "left").select("id", "text", "found")
    joined = joined.unionByName(clear.withColumn("found", F.lit(None).cast("binary")))
    kind = docs.schema[id_column].dataType.simpleString()
    return joined.mapInArrow(released(_kept), RESULT).select(F.col("id").cast(kind).alias(id_column), "n_words", "n_removed", "kept")
