"""Recurring correspondences of sounds.

A pattern is what the languages of one alignment column have: a segment, '' for a gap, or no data.
As arrays in a fixed order of languages, the ancestor first, no data is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import kept, spread

#: Sorts behind every segment.
NO_DATA = "￿"


def patterns(aligned: DataFrame, languages: list[str]) -> DataFrame:
    """(skey, col, pattern: array) of alignment columns (skey, col, lang, seg)."""
    held = aligned.groupBy("skey", "col").agg(F.map_from_entries(F.collect_list(F.struct("lang", "seg"))).alias("m"))
    return held.select("skey", "col", F.array(*[F.try_element_at("m", F.lit(x)) for x in languages]).alias("pattern"))


def by_language(pattern: Column, languages: list[str]) -> Column:
    """The segments of a pattern as a map of the languages that have one."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, languages)), pattern), lambda _, x: F.coalesce(x, F.lit("")) != "")


def sort_key(pattern: Column) -> Column:
    return F.transform(pattern, lambda x: F.coalesce(x, F.lit(NO_DATA)))


def filled(pattern: Column) -> Column:
    """How many languages have a segment."""
    return F.size(F.filter(pattern, lambda x: x.isNotNull() & (x != "")))


def compatible(a: Column, b: Column) -> Column:
    """Equal wherever both have data."""
    return ~F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(False))), lambda c: c)


def merged(source: Column, target: Column) -> Column:
    return F.zip_with(target, source, lambda t, s: F.coalesce(t, s))


def is_instance(a: Column, b: Column) -> Column:
    """Compatible, and alike in two segments or more."""
    alike = F.zip_with(a, b, lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    return compatible(a, b) & (F.size(F.filter(alike, lambda c: c)) >= 2)


def exact_groups(rows: DataFrame) -> DataFrame:
    """(pattern, n, first): equal patterns, and where the first of them stands."""
    return rows.groupBy("pattern").agg(F.count("*").alias("n"), F.min(F.struct("skey", "col")).alias("first"))


#: Between the segments of a pattern in a key: no segment has it.
BETWEEN = "\x1f"


def mask(pattern: Column) -> Column:
    """Which languages have data, a character for each."""
    return F.array_join(F.transform(pattern, lambda x: F.when(x.isNull(), "0").otherwise("1")), "")


def _seen_by(pattern: Column, other: Column) -> Column:
    """The segments of a pattern where another mask has data too, as a text: compatible patterns of two masks are those for which these are equal."""
    return F.array_join(F.transform(pattern, lambda x, i: F.when(x.isNull() | (F.substring(other, i + 1, F.lit(1)) == "0"), F.lit(NO_DATA)).otherwise(x)), BETWEEN)


def _under_masks(groups: DataFrame, own: str, other: str, within: str) -> DataFrame:
    """groups (pattern) once for each other mask that occurs within the same value of within, with both masks and what of the pattern the other one sees."""
    named = groups.withColumn(own, mask(F.col("pattern")))
    masks = named.select(within, F.col(own).alias(other)).distinct()
    both = named.join(masks, within).where(F.col(own) != F.col(other))
    return both.withColumn("_seen", _seen_by(F.col("pattern"), F.col(other)))


def compatible_pairs(groups: DataFrame, left: list[str], right: list[str], within: str = "proto_seg") -> DataFrame:
    """(within, left as a_..., right as b_...) of all ordered pairs of compatible patterns (pattern; each once) with one value of within.

    A partial-match index: each pattern is put under every mask of languages with data that occurs,
    cut to what both masks have, and patterns meet under equal cuts. So what meets is what is
    compatible, none more: the work is the patterns times the masks, plus the pairs that are there.
    Two patterns with one mask are compatible only if they are equal, so they need not meet.
    """
    a = _under_masks(groups, "_a", "_b", within).select(within, "_a", "_b", "_seen", *[F.col(c).alias(f"a_{c}") for c in left])
    b = _under_masks(groups, "_b", "_a", within).select(within, "_a", "_b", "_seen", *[F.col(c).alias(f"b_{c}") for c in right])
    return a.join(b, [within, "_a", "_b", "_seen"]).drop("_a", "_b", "_seen")


def compatible_counts(groups: DataFrame, name: str, within: str = "proto_seg") -> DataFrame:
    """(within, name, n, first, last): of each pattern that has any how many compatible ones there are, and the first and last of their names; without making the pairs, as each cut is counted before it is met."""
    a = _under_masks(groups, "_a", "_b", within).select(within, "_a", "_b", "_seen", name)
    b = _under_masks(groups, "_b", "_a", within).groupBy(within, "_a", "_b", "_seen").agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last"))
    met = a.join(b, [within, "_a", "_b", "_seen"])
    return met.groupBy(within, name).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


#: Turns that are looked at together, at least and at most.
FEWEST, MOST = 32, 8192


class Merging:
    """Exact groups of one sound, in order of their first appearance, and what they have been merged into so far: segments are numbers, 0 for a gap and -1 for no data."""

    def __init__(self) -> None:
        self.code: dict[str | None, int] = {"": 0, None: -1}
        self.added: list[tuple[list[int], int]] = []

    def add(self, pattern: Iterable[str | None], count: int) -> None:
        """One more group; all come before the first turn."""
        self.added.append(([self.code.setdefault(x, len(self.code) - 1) for x in pattern], count))

    def ready(self) -> None:
        if len(self.added):
            self.names = {k: x for x, k in self.code.items()}
            self.codes = np.array([p for p, _ in self.added], np.int32)
            self.counts = np.array([n for _, n in self.added], np.int64)
            self.blanks = (self.codes <= 0).sum(1)
            self.roots = np.arange(len(self.added))
            self.added = []

    def root(self, k: int) -> int:
        self.ready()
        return int(self.roots[k])

    @property
    def patterns(self) -> list[tuple[str | None, ...]]:
        self.ready()
        return [tuple(self.names[x] for x in p) for p in self.codes.tolist()]

    def turn(self, i: int, j: int) -> None:
        self.turns(np.array([i]), np.array([j]))

    def turns(self, i: np.ndarray, j: np.ndarray) -> None:
        """One turn after the other: merges what i is in into what j is in, if they still fit and the latter is still better.

        Few turns merge anything: many are looked at together as things stand, and those behind the first that merges are looked at again.
        """
        self.ready()
        at, step = 0, FEWEST
        while at < len(i):
            a, b = self.roots[i[at : at + step]], self.roots[j[at : at + step]]
            better = (self.blanks[b] < self.blanks[a]) | ((self.blanks[b] == self.blanks[a]) & (self.counts[b] > self.counts[a]))
            some = np.flatnonzero(better & (a != b))
            p, q = self.codes[a[some]], self.codes[b[some]]
            fit = some[~((p != q) & (p >= 0) & (q >= 0)).any(1)]
            if len(fit):
                self.merge(a[fit[0]], b[fit[0]])
                at, step = at + fit[0] + 1, max(FEWEST, step // 2)
            else:
                at, step = at + step, min(MOST, step * 2)

    def merge(self, a: int, b: int) -> None:
        self.codes[b] = np.where(self.codes[b] >= 0, self.codes[b], self.codes[a])
        self.counts[b] += self.counts[a]
        self.blanks[b] = (self.codes[b] <= 0).sum()
        self.roots[self.roots == a] = b


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sound: first its groups (j is null), by place, then the turns in their order. Only the groups are held; turns pass by."""

    def packed(sound: str, held: Merging) -> pa.RecordBatch:
        patterns = held.patterns
        roots = held.roots.tolist()
        columns = [[sound] * len(roots), range(len(roots)), roots, [patterns[r] for r in roots]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["proto_seg", "place", "root", "merged"])

    sound, held = None, None
    for batch in batches:
        kinds = batch.column("proto_seg").dictionary_encode()
        code = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        listed = batch.column("j").is_null().to_numpy(zero_copy_only=False)
        # stretches of one sound, and of its groups or its turns
        starts = np.flatnonzero(np.r_[len(code) > 0, (code[1:] != code[:-1]) | (listed[1:] != listed[:-1])])
        for start, end in zip(starts, [*starts[1:], len(code)], strict=True):
            now, part = kinds[int(start)].as_py(), batch.slice(start, end - start)
            if held is None or now != sound:
                if held is not None:
                    yield packed(sound, held)
                sound, held = now, Merging()
            if listed[start]:
                for text, n in zip(part.column("pattern").to_pylist(), part.column("n").to_pylist(), strict=True):
                    held.add([None if x == NO_DATA else x for x in text.split(BETWEEN)], n)
            else:
                held.turns(part.column("i").to_numpy(), part.column("j").to_numpy())
    if held is not None:
        yield packed(sound, held)


def merged_groups(exact: DataFrame) -> DataFrame:
    """exact (proto_seg, pattern, n, first), with root (its pattern) and merged of the set that each group ends in.

    The emptiest group first looks for a compatible one with fewer blanks, or as many and a larger
    count: the fullest, of these the most frequent, of these the first. These turns, in the order of
    the groups as they were at the start, come from the partial-match index, sorted by Spark; each
    sound's are read one by one, with its groups in memory, and whether a pair still fits is looked
    at when its turn comes. Merging depends on what has been merged before, so a sound is one task.
    """
    place = F.row_number().over(Window.partitionBy("proto_seg").orderBy("first")) - 1
    groups = kept(exact.withColumns({"i": place.cast("long"), "blanks": (F.size("pattern") - filled(F.col("pattern"))).cast("long")}))
    turns = compatible_pairs(groups.select("proto_seg", "pattern", "i", "blanks", "n"), ["i", "blanks"], ["i", "blanks", "n"])
    counts = groups.select("proto_seg", F.col("i").alias("a_i"), F.col("n").alias("a_n"))
    better = (F.col("b_blanks") < F.col("a_blanks")) | ((F.col("b_blanks") == F.col("a_blanks")) & (F.col("b_n") > F.col("a_n")))
    turns = turns.join(counts, ["proto_seg", "a_i"]).where(better)
    none = lambda kind: F.lit(None).cast(kind)
    # as a text: Spark hands on a column of arrays many times more slowly, even one of nulls
    text = F.array_join(sort_key(F.col("pattern")), BETWEEN).alias("pattern")
    rows = groups.select("proto_seg", none("long").alias("order"), none("long").alias("b_blanks"), none("long").alias("b_n"), "i", none("long").alias("j"), text, "n")
    rows = rows.unionByName(turns.select("proto_seg", (-F.col("a_blanks")).alias("order"), "b_blanks", (-F.col("b_n")).alias("b_n"), F.col("a_i").alias("i"), F.col("b_i").alias("j"), none("string").alias("pattern"), none("long").alias("n")))
    # nulls, and so the groups, come first
    rows = spread(rows, "proto_seg").sortWithinPartitions("proto_seg", "order", "b_blanks", "b_n", "i", "j")
    links = rows.select("proto_seg", "i", "j", "pattern", "n").mapInArrow(_merge, "proto_seg string, place long, root long, merged array<string>")
    links = links.select("proto_seg", F.col("place").alias("i"), "root", "merged")
    roots = groups.select("proto_seg", F.col("i").alias("root"), F.col("pattern").alias("root_pattern"))
    return groups.join(links, ["proto_seg", "i"]).join(roots, ["proto_seg", "root"]).select("proto_seg", "pattern", "n", "first", F.col("root_pattern").alias("root"), "merged")


def correspondence_sets(rows: DataFrame) -> DataFrame:
    """(set_id, proto_seg, pattern, n, n_filled, columns: array<struct<gloss, skey, col>>) of patterns (skey, col, pattern; gloss if there is one).

    Compatible patterns agree on the ancestor's segment, which all have, so each of its segments is
    merged by itself: a group holds its distinct patterns, not their occurrences. Sets with fewer
    than two segments go, unless there is one exact group in all. The columns of a set go by lower
    case gloss, a missing one first. rows are used twice: keep them if they are dear.
    """
    exact = kept(exact_groups(rows).withColumn("proto_seg", F.get("pattern", F.lit(0))))
    groups = exact.agg(F.count("*").alias("groups"))

    links = merged_groups(exact)
    gloss = F.lower(F.coalesce("gloss", F.lit(""))) if "gloss" in rows.columns else F.lit("")
    keyed = rows.withColumn("key", sort_key(F.col("pattern"))).join(links.select(sort_key(F.col("pattern")).alias("key"), "root", "merged"), "key")
    columns = F.array_sort(F.collect_list(F.struct(gloss.alias("gloss"), "skey", "col"))).alias("columns")
    sets = keyed.groupBy(sort_key(F.col("root")).alias("root_key"), F.col("merged").alias("pattern")).agg(F.count("*").alias("n"), columns)
    sets = sets.withColumn("n_filled", filled(F.col("pattern")))
    # the number of groups is one row
    sets = sets.join(F.broadcast(groups)).where("n_filled >= 2 or groups <= 1")
    name = F.array_join(F.transform("root_key", lambda x: F.when(x == NO_DATA, "?").otherwise(x)), "|")
    return sets.select(name.alias("set_id"), F.get("pattern", F.lit(0)).alias("proto_seg"), "pattern", "n", "n_filled", "columns")


def ordered(sets: DataFrame) -> DataFrame:
    """The largest sets first, equal ones by their pattern, no data last."""
    return sets.orderBy(F.desc("n"), sort_key(F.col("pattern")))


def languages_with_data(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(set_id, languages): all languages of the cognate sets (skey, lang) that a set draws on."""
    cells = sets.select("set_id", F.explode("columns").alias("c")).select("set_id", F.col("c.skey").alias("skey")).distinct()
    return cells.join(members.select("skey", "lang").distinct(), "skey").groupBy("set_id").agg(F.array_sort(F.collect_set("lang")).alias("languages"))


def phonemes_worth_analysing(sets: DataFrame) -> DataFrame:
    """(proto_seg, n): ancestor segments with two sets or more, the most first, of equals the one whose set comes first (as ordered has them); gaps don't count."""
    first = F.min(F.struct(-F.col("n"), sort_key(F.col("pattern"))))
    return sets.where("proto_seg <> ''").groupBy("proto_seg").agg(F.count("*").alias("sets"), first.alias("first")).where("sets >= 2").orderBy(F.desc("sets"), "first").select("proto_seg", F.col("sets").alias("n"))


def cognates_by_segment(aligned: DataFrame, lang: str, seg: str) -> DataFrame:
    """(skey, col): for each cognate set the first column in which the language has the segment."""
    return aligned.where((F.col("lang") == lang) & (F.col("seg") == seg)).groupBy("skey").agg(F.min("col").alias("col"))


def pattern_view(rows: DataFrame, languages: list[str], terms: dict[str, str], sort: str | None = None, descending: bool = False) -> DataFrame:
    """Patterns whose shown value of each named language (a dash for a gap or no data), or whose count n, matches, case mattering; terms that aren't valid patterns are passed over.

    sort: the count, by number, or a language, as a reader's alphabet has its segments, those
    without first; ties by pattern.
    """
    from .search import matches_regex
    import re

    value = lambda lang: F.coalesce(F.get("pattern", F.lit(languages.index(lang))), F.lit(""))
    for name, term in terms.items():
        try:
            re.compile(term)
        except re.error:
            continue
        text = F.col("n").cast("string") if name == "count" else F.coalesce(F.nullif(value(name), F.lit("")), F.lit("-"))
        rows = rows.where(matches_regex(text, term, ignore_case=False))
    if sort is None:
        return rows
    key = F.col("n") if sort == "count" else F.collate(value(sort), "UNICODE")
    return rows.orderBy(key.desc() if descending else key.asc(), sort_key(F.col("pattern")))


def last_of_language(rows: DataFrame) -> DataFrame:
    """(prefid, langid, refid): of several forms of one language in a set the one with the largest id."""
    return rows.groupBy("prefid", "langid").agg(F.max("refid").alias("refid"))
