"""Contexts that tell correspondences apart, in terms of features."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phonology import FEATURES, features
from ..sources.kept import kept, spread

Spec = dict[str, int]
#: A word's edge, as a context and as a specification.
EDGE = "#"
EDGE_SPEC: Spec = {EDGE: 1}


def contexts(proto: DataFrame) -> DataFrame:
    """(skey, col, seg, left, right) of the ancestor's segments (skey, col, seg): its neighbours without gaps, null at a word's edge."""
    order = Window.partitionBy("skey").orderBy("col")
    return proto.where("seg <> ''").select("skey", "col", "seg", F.lag("seg").over(order).alias("left"), F.lead("seg").over(order).alias("right"))


def diversity(rows: DataFrame, *keys: str) -> DataFrame:
    """How many different (left, right) there are; an edge counts as a value."""
    return rows.groupBy(*keys).agg(F.countDistinct(F.coalesce("left", F.lit(EDGE)), F.coalesce("right", F.lit(EDGE))).alias("diversity"))


def fits(segment: dict[str, int], spec: Spec) -> bool:
    return EDGE not in spec and all(segment.get(f, 0) == v for f, v in spec.items())


@functools.cache
def masks(segment: str | None) -> tuple[int, int] | None:
    """A bit for each feature that the segment has, and for each that it lacks; None if it is unknown, or an edge."""
    held = features(segment) if segment is not None else None
    if not held:
        return None
    return tuple(sum(1 << FEATURES.index(f) for f, v in held if v == sign) for sign in (1, -1))


@functools.lru_cache(1 << 16)
def _minimal(positive: frozenset, negative: frozenset) -> tuple[tuple[str, int], ...] | None:
    if None in positive and None not in negative:
        return tuple(EDGE_SPEC.items())
    wanted = [m for s in positive if (m := masks(s))]
    if not wanted:
        return None
    plus, minus = (functools.reduce(int.__and__, (m[k] for m in wanted)) for k in (0, 1))
    common = [k for k in range(len(FEATURES)) if (plus | minus) >> k & 1]
    # of each negative segment, which of the shared features it has with the same value; a choice tells it apart unless it has all of them
    shared = {m[0] & plus | m[1] & minus for s in negative if (m := masks(s))}
    for size in (*range(1, min(2, len(common)) + 1), *([len(common)] if common else [])):
        for chosen in itertools.combinations(common, size):
            bits = sum(1 << k for k in chosen)
            if all(bits & ~x for x in shared):
                return tuple((FEATURES[k], 1 if plus >> k & 1 else -1) for k in chosen)
    return None


def minimal_features(positive: Iterable[str | None], negative: Iterable[str | None]) -> Spec | None:
    """The fewest features that all positive segments share and no negative one has: one, two, or all of them; None without any. Features are tried in the table's order; None stands for an edge."""
    found = _minimal(frozenset(positive), frozenset(negative))
    return None if found is None else dict(found)


def describe(left: Spec | None, right: Spec | None) -> str:
    """A context in words."""
    def side(spec: Spec, edge: str, place: str) -> str:
        return edge if EDGE in spec else f"{place} [{', '.join(('+' if v > 0 else '-') + f for f, v in sorted(spec.items()))}]"

    parts = ([side(left, "word-initially", "after")] if left else []) + ([side(right, "word-finally", "before")] if right else [])
    return " and ".join(parts) or "no distinguishing context"


Occurrences = list[tuple[str | None, str | None]]


def sides(contexts: Occurrences) -> tuple[frozenset, frozenset]:
    """What stands on the left, and on the right."""
    return frozenset(a for a, _ in contexts), frozenset(b for _, b in contexts)


def generalize(one: Occurrences, other: Occurrences) -> tuple[Spec | None, Spec | None]:
    (a, b), (x, y) = sides(one), sides(other)
    return minimal_features(a, x), minimal_features(b, y)


_BITS = {f: 1 << k for k, f in enumerate(FEATURES)}
_PAIRS = [1 << i | 1 << j for i, j in itertools.combinations(range(len(FEATURES)), 2)]


def segment_masks(rows: DataFrame, column: str) -> DataFrame:
    """(seg, plus, minus) of the kinds of segments that the column holds: a bit for each feature that one has, and that it lacks; none for unknown ones."""

    @F.pandas_udf("struct<plus: long, minus: long>")
    def bits(segs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([masks(s) or (None, None) for s in segs], columns=["plus", "minus"], dtype="Int64")

    kinds = rows.select(F.col(column).alias("seg")).where("seg is not null").distinct()
    return kinds.select("seg", bits("seg").alias("m")).select("seg", "m.*").where("plus is not null")


def _once(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _without(bits: Column, other: Column) -> Column:
    return bits.bitwiseAND(F.bitwise_not(other))


def least_features(own: Column, edge: Column, kinds: Column) -> Column:
    """minimal_features as a column: struct<edge: boolean, bits: long>, or null. own: a side of a set (see sides_of); edge, kinds: whether an edge is among the negative ones, and the masks of those that are known."""
    zero = F.lit(0).cast("long")
    common = own["plus"].bitwiseOR(own["minus"])

    def chosen(shared: Column) -> Column:
        # a choice tells a negative segment apart unless that one shares all of it
        apart = lambda bits: F.forall(shared, lambda x: _without(bits, x) != zero)
        among = lambda choices: F.get(F.filter(_longs(choices), lambda b: (_without(b, common) == zero) & apart(b)), F.lit(0))
        return F.coalesce(among(list(_BITS.values())), among(_PAIRS), F.when((common != zero) & apart(common), common))

    shared = F.transform(kinds, lambda x: x["plus"].bitwiseAND(own["plus"]).bitwiseOR(x["minus"].bitwiseAND(own["minus"])))
    spec = lambda edge, bits: F.struct(edge.alias("edge"), bits.alias("bits"))
    found = _once(_once(shared, chosen), lambda bits: F.when(bits.isNotNull(), spec(F.lit(False), bits)))
    return F.when(own["edge"] & ~edge, spec(F.lit(True), zero)).when(own["known"], found)


def described(left: Column, right: Column, own_left: Column, own_right: Column) -> Column:
    """describe as a column: specifications by least_features, and the sides that they are of."""
    names = F.array(*[F.struct(F.lit(f).alias("name"), F.lit(_BITS[f]).cast("long").alias("bit")) for f in sorted(FEATURES)])

    def side(spec: Column, own: Column, edge: str, place: str) -> Column:
        has = lambda bits, f: bits.bitwiseAND(f["bit"]) != F.lit(0).cast("long")
        held = F.transform(F.filter(names, lambda f: has(spec["bits"], f)), lambda f: F.concat(F.when(has(own["plus"], f), "+").otherwise("-"), f["name"]))
        return F.when(spec.isNotNull(), F.when(spec["edge"], edge).otherwise(F.concat(F.lit(f"{place} ["), F.array_join(held, ", "), F.lit("]"))))

    one = _once(left, lambda x: side(x, own_left, "word-initially", "after"))
    other = _once(right, lambda x: side(x, own_right, "word-finally", "before"))
    said = _once(F.array_compact(F.array(one, other)), lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, " and ")))
    return F.coalesce(said, F.lit("no distinguishing context"))


def sides_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (set_id, proto_seg, left, right): (proto_seg, set_id, contexts, l, r), where contexts is how many there are and a side is struct<edge, known: boolean, plus, minus: long, kinds: array<struct<plus, minus>>, segs>: the features that all its segments share, by bit_and, the masks of its segments and their names; and (proto_seg, side, seg, n, plus, minus): in how many sets a segment is. A side has as many entries as there are kinds of segments."""
    distinct = rows.select("set_id", "proto_seg", "left", "right").distinct()
    pair = lambda side, seg: F.struct(F.lit(side).alias("side"), F.col(seg).alias("seg"))
    each = distinct.select("proto_seg", "set_id", F.explode(F.array(pair(0, "left"), pair(1, "right"))).alias("x")).select("proto_seg", "set_id", "x.*").distinct()
    each = kept(each.join(segment_masks(each, "seg"), "seg", "left"))
    mask = F.when(F.col("plus").isNotNull(), F.struct("plus", "minus"))
    # bit_and and collect_set pass over nulls
    side = each.groupBy("proto_seg", "set_id", "side").agg(F.max(F.col("seg").isNull()).alias("edge"), (F.count("plus") > 0).alias("known"), F.bit_and("plus").alias("plus"), F.bit_and("minus").alias("minus"), F.collect_set(mask).alias("kinds"), F.collect_set(F.coalesce("seg", F.lit(EDGE))).alias("segs"))
    own = F.struct("edge", "known", "plus", "minus", "kinds", "segs")
    both = side.groupBy("proto_seg", "set_id").agg(*[F.first(F.when(F.col("side") == k, own), ignorenulls=True).alias(n) for k, n in ((0, "l"), (1, "r"))])
    sizes = distinct.groupBy("proto_seg", "set_id").agg(F.count("*").alias("contexts"))
    often = each.groupBy("proto_seg", "side", "seg").agg(F.count("*").alias("n"), F.max("plus").alias("plus"), F.max("minus").alias("minus"))
    return sizes.join(both, ["proto_seg", "set_id"]), often


def _told(a: str, b: str) -> Column:
    """What sets a apart from b, in words; both are names of structs with l and r."""
    of = lambda x, k: F.col(x)[k]
    specs = [least_features(of(a, k), of(b, k)["edge"], of(b, k)["kinds"]) for k in ("l", "r")]
    return described(*specs, of(a, "l"), of(a, "r"))


#: Sets of a block: what one group compares with another block.
BLOCK = 256
#: Choices of features in the order in which they are tried.
_CHOICES = np.array([*_BITS.values(), *_PAIRS], np.int64)
#: What a choice of none is, and one of an edge.
NONE, AT_EDGE = -1, -2


def _least(own: tuple, edges: np.ndarray, kinds: np.ndarray, has: np.ndarray) -> np.ndarray:
    """least_features of one side (edge, known, plus, minus) against many: bits, NONE or AT_EDGE for each. edges: whether they have an edge; kinds: masks (plus, minus) that any of them has; has: which of these each has."""
    edge, known, plus, minus = own
    out = np.full(len(edges), NONE, np.int64)
    common = plus | minus
    if known and common:
        shared = kinds[:, 0] & plus | kinds[:, 1] & minus
        choices = np.append(_CHOICES[_CHOICES & ~common == 0], common)
        # a choice fails where a kind that is there shares all of it
        alike = (choices[:, None] & ~shared == 0).astype(np.float32)
        fits = has @ alike.T == 0
        found = fits.any(1)
        out[found] = choices[fits.argmax(1)[found]]
    if edge:
        out[~edges] = AT_EDGE
    return out


def _spec(bits: int, plus: int) -> Spec | None:
    return None if bits == NONE else EDGE_SPEC if bits == AT_EDGE else {f: 1 if plus & b else -1 for f, b in _BITS.items() if bits & b}


def _numbered(values: list) -> tuple[np.ndarray, list]:
    """The number of each value, and the different ones."""
    at: dict = {}
    return np.array([at.setdefault(v, len(at)) for v in values], np.int64), list(at)


def _specs(one: list[dict], other: list[dict], label) -> tuple[np.ndarray, list[Spec | None]]:
    """Of each of one and each of other the number of the specification that sets the former apart, and these. Equal sides are looked at once."""
    a, own = _numbered([(x["edge"], x["known"], x["plus"], x["minus"]) for x in one])
    b, across = _numbered([(x["edge"], frozenset((k["plus"], k["minus"]) for k in x["kinds"])) for x in other])
    kinds = sorted({k for _, held in across for k in held})
    place = {k: i for i, k in enumerate(kinds)}
    has = np.zeros((len(across), len(kinds)), np.float32)
    for i, (_, held) in enumerate(across):
        has[i, [place[k] for k in held]] = 1
    known = np.array(kinds, np.int64).reshape(-1, 2)
    edges = np.array([edge for edge, _ in across])
    names: dict = {}
    table = np.empty((len(own), len(across)), np.int64)
    for i, x in enumerate(own):
        bits, at = np.unique(_least((x[0], x[1], x[2] or 0, x[3] or 0), edges, known, has), return_inverse=True)
        table[i] = np.array([names.setdefault(label(_spec(int(v), x[2] or 0)), len(names)) for v in bits])[at]
    return table[a][:, b], list(names)


def _told_in_blocks(one: list[dict], other: list[dict]) -> tuple[np.ndarray, list[str]]:
    """Of each of one and each of other (with l and r) the number of the text that says what sets the former apart, and the texts."""
    held = lambda spec: spec and tuple(spec.items())
    (left, lefts), (right, rights) = (_specs([x[k] for x in one], [x[k] for x in other], held) for k in ("l", "r"))
    both, at = np.unique(left * len(rights) + right, return_inverse=True)
    spec = lambda x: x and dict(x)
    return at.reshape(left.shape), [describe(spec(lefts[k // len(rights)]), spec(rights[k % len(rights)])) for k in both.tolist()]


def _pairs_of_blocks(one: pa.Table, other: pa.Table) -> pa.Table:
    """Each two sets of two blocks of a sound, or of one block; the smaller name first."""
    kind = pa.schema([(n, pa.string()) for n in ("proto_seg", "a", "b", "a_context", "b_context")])
    if not len(one) or not len(other):
        return kind.empty_table()
    x, y = one.to_pylist(), other.to_pylist()
    names = sorted({r["set_id"] for r in x} | {r["set_id"] for r in y})
    rank = {n: k for k, n in enumerate(names)}
    i, j = (np.array([rank[r["set_id"]] for r in side]) for side in (x, y))
    forth, forths = _told_in_blocks(x, y)
    back, backs = _told_in_blocks(y, x)
    # within a block each two sets meet twice
    wanted = i[:, None] < j[None, :] if x[0]["bi"] == x[0]["bj"] else np.ones(forth.shape, bool)
    p, q = np.nonzero(wanted)
    ahead = i[p] < j[q]
    texts, forth, back = pa.array(forths + backs, pa.string()), forth[p, q], back[q, p] + len(forths)
    first, last = np.minimum(i[p], j[q]), np.maximum(i[p], j[q])
    named = pa.array(names, pa.string())
    columns = [pa.array([x[0]["proto_seg"]], pa.string()).take(pa.array(np.zeros(len(p), np.int64))), named.take(pa.array(first)), named.take(pa.array(last)), texts.take(pa.array(np.where(ahead, forth, back))), texts.take(pa.array(np.where(ahead, back, forth)))]
    return pa.table(columns, schema=kind)


def pairwise(rows: DataFrame) -> DataFrame:
    """(proto_seg, a, b, a_context, b_context) for each two sets of one ancestor segment; rows: (set_id, proto_seg, left, right), each context once.

    The pairs are the result, so the work is the square of a sound's sets. These are dealt into
    blocks of bounded size, each two blocks are a group of their own, over all tasks, and in a group
    what sets two sides apart is sought once for all sets with equal sides.
    """
    sets, _ = sides_of(rows)
    side = lambda k: F.struct(*[F.col(k)[c].alias(c) for c in ("edge", "known", "plus", "minus", "kinds")]).alias(k)
    sets = kept(sets.where("proto_seg is not null and set_id is not null").select("proto_seg", "set_id", side("l"), side("r")))
    blocks = sets.groupBy("proto_seg").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = sets.join(blocks, "proto_seg").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    columns = ["proto_seg", "set_id", "l", "r"]
    one = own.select(*columns, F.col("own").alias("bi"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("bj"))
    other = own.select(*[F.col(c).alias(c) for c in columns], F.explode(F.sequence(F.lit(0), "own")).alias("bi"), F.col("own").alias("bj"))
    # blocks are few bytes and much work
    one, other = (spread(x, "proto_seg", "bi", "bj") for x in (one, other))
    keys = ["proto_seg", "bi", "bj"]
    return one.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(_pairs_of_blocks, "proto_seg string, a string, b string, a_context string, b_context string")


def default_and_conditioned(rows: DataFrame) -> DataFrame:
    """(proto_seg, set_id, is_default, score, context): the least restricted set of each ancestor segment, and what sets the others apart from it.

    A set's score is the number of features that tell it from all others, less a tenth for each
    different context it has; the lowest is the default, the first of equals. What stands beside
    other sets is all that stands beside more sets than this one: the segments of a sound are
    counted once, and each set is compared with these counts, not with each other set.
    """
    sets, often = sides_of(rows)
    sets = kept(sets)
    entry = F.struct("seg", "n", "plus", "minus")
    # an entry for each kind of segment
    around = often.groupBy("proto_seg").agg(*[F.collect_list(F.when(F.col("side") == k, entry)).alias(f"all_{n}") for k, n in ((0, "l"), (1, "r"))])
    many = sets.groupBy("proto_seg").agg(F.count("*").alias("sets"))
    both = spread(sets.join(around, "proto_seg").join(many, "proto_seg"), "proto_seg", "set_id")

    def size(n: str) -> Column:
        own = F.col(n)
        others = F.filter(F.col(f"all_{n}"), lambda x: x["n"] > F.array_contains(own["segs"], F.coalesce(x["seg"], F.lit(EDGE))).cast("int"))
        kinds = F.transform(F.filter(others, lambda x: x["plus"].isNotNull()), lambda x: F.struct(x["plus"].alias("plus"), x["minus"].alias("minus")))
        spec = least_features(own, F.exists(others, lambda x: x["seg"].isNull()), kinds)
        return F.when(F.col("sets") > 1, F.coalesce(F.bit_count(spec["bits"]), F.lit(0))).otherwise(0)

    scored = kept(both.select("proto_seg", "set_id", F.struct("l", "r").alias("own"), (size("l") + size("r") - F.lit(0.1) * F.col("contexts")).alias("raw")))
    best = scored.groupBy("proto_seg").agg(F.min(F.struct("raw", "set_id", "own")).alias("x")).select("proto_seg", F.col("x.set_id").alias("first"), F.col("x.own").alias("best"))
    is_default = F.col("set_id") == F.col("first")
    context = F.when(is_default, "default").otherwise(_told("own", "best"))
    return spread(scored.join(best, "proto_seg"), "proto_seg", "set_id").select("proto_seg", "set_id", is_default.alias("is_default"), F.round("raw", 6).alias("score"), context.alias("context"))


def analyse_phoneme(found: DataFrame, phoneme: str) -> dict:
    """What default_and_conditioned found of one segment: num_sets, default and conditioned sets, and a message if there are fewer than two."""
    rows = found.where(F.col("proto_seg") == phoneme).orderBy("set_id").collect()
    message = {0: "no correspondence sets", 1: "one correspondence set, which is the default"}.get(len(rows))
    return {"phoneme": phoneme, "num_sets": len(rows), "default": next((r["set_id"] for r in rows if r["is_default"]), None), "conditioned": {r["set_id"]: r["context"] for r in rows if not r["is_default"]}} | ({"message": message} if message else {})
