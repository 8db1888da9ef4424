"""Alignment of the sounds of cognate sets."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonology import GAP, distance, features
from ..functions.text import SEGMENT, segments
from ..sources.kept import kept, spread

_SEGMENT = regex.compile(SEGMENT)
Cost = Callable[[str, str], float]
#: Pairs that are aligned at once.
PIECE = 4096


def segments_of(form: str | None) -> list[str]:
    return _SEGMENT.findall(form or "")


def unit_cost(a: str, b: str) -> float:
    return float(a != b)


def cost_table(a: list[str], b: list[str], cost: Cost, gap: float) -> list[list[float]]:
    """The cheapest alignment of every two beginnings."""
    table = [[gap * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        above, last = table[-1], gap * i
        row = [last]
        # compared one by one, which is much quicker than min in this innermost loop
        for j, c in enumerate([cost(x, y) for y in b]):
            best = above[j] + c
            if (other := above[j + 1] + gap) < best:
                best = other
            if (other := last + gap) < best:
                best = other
            last = best
            row.append(best)
        table.append(row)
    return table


def align_pair(a: list[str], b: list[str], cost: Cost = distance, gap: float = GAP) -> list[tuple[str, str]]:
    """Pairs of segments, '' for a gap. Of equally cheap alignments the one that, from the end, pairs segments before it leaves a gap in b, and that before one in a."""
    table, i, j, out = cost_table(a, b, cost, gap), len(a), len(b), []
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + cost(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and (not j or table[i][j] == table[i - 1][j] + gap):
            i -= 1
            out.append((a[i], ""))
        else:
            j -= 1
            out.append(("", b[j]))
    return out[::-1]


def same(*columns: str) -> Column:
    """a and b agree in these columns; nulls are equal."""
    return functools.reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])


def centers(rows: DataFrame, cost: Cost = distance) -> DataFrame:
    """(skey, lang, form): of each set (skey, lang, form) the form nearest to all others, position by position; each position of difference in length costs GAP. Of equals the first by language, then form; a form that is there twice counts twice.

    What a segment costs against all others at its position follows from how often each segment
    stands there, and these numbers are sums over rows: a set is never in one place, and the work
    grows with the forms and the kinds of segments, not with pairs of forms.
    """

    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(map(functools.cache(cost), a, b)), dtype=float)

    forms = rows.groupBy("skey", "lang", "form").agg(F.count("*").alias("w")).withColumn("segs", segments(F.coalesce("form", F.lit(""))))
    forms = kept(forms)
    cells = forms.select("skey", "lang", "form", "w", F.posexplode("segs").alias("p", "seg"))
    often = kept(cells.groupBy("skey", "p", "seg").agg(F.sum("w").alias("n")))
    pairs = often.alias("a").join(often.alias("b"), same("skey", "p")).select("a.skey", "a.p", "a.seg", F.col("b.seg").alias("other"), "b.n")
    each = pairs.withColumn("cost", apart("seg", "other") * F.col("n")).groupBy("skey", "p", "seg").agg(F.sum("cost").alias("cost"))
    own = cells.alias("a").join(each.alias("b"), same("skey", "p", "seg")).groupBy("a.skey", "a.lang", "a.form").agg(F.sum("b.cost").alias("cost"))
    sizes = forms.groupBy("skey", F.size("segs").alias("size")).agg(F.sum("w").alias("n"))
    gaps = sizes.alias("a").join(sizes.alias("b"), same("skey")).groupBy("a.skey", "a.size").agg(F.sum(GAP * F.abs(F.col("a.size") - F.col("b.size")) * F.col("b.n")).alias("gaps"))
    sized = forms.select("skey", "lang", "form", F.size("segs").alias("size"))
    total = sized.alias("a").join(gaps.alias("b"), same("skey", "size")).select("a.*", "gaps")
    total = total.alias("a").join(own.alias("b"), same("skey", "lang", "form"), "left").select("a.*", F.round(F.col("gaps") + F.coalesce("b.cost", F.lit(0.0)), 6).alias("total"))
    return total.groupBy("skey").agg(F.min(F.struct("total", "lang", "form")).alias("x")).select("skey", "x.lang", "x.form")


def placed(center: list[str], sequence: list[str], cost: Cost, gap: float) -> tuple[list[str], list[list[str]]]:
    """A sequence aligned to a center: what it has for each of the center's segments ('' for none), and what it has before each of them and behind the last."""
    own: list[str] = []
    added: list[list[str]] = [[] for _ in range(len(center) + 1)]
    for x, y in align_pair(center, sequence, cost, gap):
        if x:
            own.append(y)
        else:
            added[len(own)].append(y)
    return own, added


def align_sets(rows: DataFrame, proto: str = "proto", cost: Cost = distance, gap: float = GAP) -> DataFrame:
    """(skey, col, lang, seg) of all sets (skey, lang, form): each language's segments in columns, '' for a gap.

    The center of a set is its ancestor form (that of the language proto; the last of several), or
    the most central form (see centers). In the first step each form is aligned to its center, in its
    own row. In the second the room before each of the center's segments, that of the longest
    insertion there, is a maximum over the set's rows. In the third each row is spread over the
    columns that result, insertions at the left of their room. So a set of any size is dealt over
    many tasks. All forms of a language make room, and the last of them is shown. A null form counts
    as empty; null keys are one set, null languages one language; repeated rows count once.
    """
    rows = kept(rows.select("skey", "lang", F.coalesce("form", F.lit("")).alias("form")))
    ancestor = F.col("lang").eqNullSafe(F.lit(proto))
    protos = rows.where(ancestor).groupBy("skey").agg(F.max("form").alias("form"))
    members = rows.where(~ancestor)
    without = members.alias("a").join(protos.alias("b"), same("skey"), "left_anti")
    middles = protos.unionByName(centers(without, cost).select("skey", "form"))
    named = members.distinct().unionByName(protos.withColumn("lang", F.lit(proto)))
    both = named.alias("a").join(middles.alias("b"), same("skey")).select("a.*", segments(F.col("b.form")).alias("center"), segments(F.col("a.form")).alias("segs"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # sets often share center and form
            held: dict[tuple, tuple] = {}
            out = []
            for key in zip(*(map(tuple, batch.column(c).to_pylist()) for c in ("center", "segs")), strict=True):
                if key not in held:
                    held[key] = placed(list(key[0]), list(key[1]), cost, gap)
                out.append(held[key])
            lists = pa.list_(pa.string())
            made = [pa.array([x[0] for x in out], lists), pa.array([x[1] for x in out], pa.list_(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["skey", "lang", "form", "own", "added"])

    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("skey", "lang", "form"))
    dealt = spread(both, "skey", "lang", "form").select("skey", "lang", "form", "center", "segs")
    done = kept(dealt.mapInArrow(place, f"{kinds}, own array<string>, added array<array<string>>"))
    longest = done.select("skey", F.posexplode(F.transform("added", F.size)).alias("p", "n")).where("n > 0").groupBy("skey", "p").agg(F.max("n").alias("n"))
    # one entry for each place of the center at most
    room = longest.groupBy("skey").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("room"))
    shown = done.groupBy("skey", "lang").agg(F.max(F.struct("form", "own", "added")).alias("x")).select("skey", "lang", "x.*")
    wide = shown.alias("a").join(room.alias("b"), same("skey"), "left").select("a.*", "room")
    # a place's room, and then the center's own segment there, but behind the last
    space = lambda x, p: F.concat(x, F.array_repeat(F.lit(""), F.coalesce(F.try_element_at("room", p), F.lit(0)) - F.size(x)))
    cells = F.flatten(F.transform("added", lambda x, p: F.concat(space(x, p), F.slice("own", p + 1, 1))))
    return wide.select("skey", "lang", F.posexplode(cells).alias("col", "seg")).select("skey", "col", "lang", "seg")


def batch_costs(a: list[list[str]], b: list[list[str]], cost: Cost, gap: float) -> np.ndarray:
    """The costs of aligning many pairs, all at once: each step fills one cell of all their tables."""
    names = {x: k for k, x in enumerate(sorted({x for s in (*a, *b) for x in s}))}
    of = np.array([[cost(x, y) for y in names] for x in names] or [[0.0]])
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    codes = [np.zeros((size.max(initial=0), len(a)), np.int64) for size in (n, m)]
    for held, side in zip(codes, (a, b), strict=True):
        for k, s in enumerate(side):
            held[: len(s), k] = [names[x] for x in s]
    out = np.where(n == 0, gap * m, 0.0)
    row = [np.full(len(a), gap * j) for j in range(m.max(initial=0) + 1)]
    for i in range(n.max(initial=0)):
        above, row = row, [np.full(len(a), gap * (i + 1))]
        for j in range(len(above) - 1):
            row.append(np.minimum(np.minimum(above[j] + of[codes[0][i], codes[1][j]], above[j + 1] + gap), row[j] + gap))
        done = np.flatnonzero(n == i + 1)
        out[done] = np.stack(row)[m[done], done]
    return out


def costs_in_pieces(a: list[list[str]], b: list[list[str]], cost: Cost, gap: float) -> np.ndarray:
    """batch_costs of any number of pairs: those of like length together, in pieces of bounded size."""
    order = np.lexsort(([len(x) for x in b], [len(x) for x in a]))
    out = np.zeros(len(a))
    for k in range(0, len(order), PIECE):
        at = order[k : k + PIECE]
        out[at] = batch_costs([a[i] for i in at], [b[i] for i in at], cost, gap)
    return out


def pair_costs(rows: DataFrame, cost: Cost = distance, gap: float = GAP) -> DataFrame:
    """rows with the column cost: that of aligning a and b, arrays of segments."""

    @F.pandas_udf("double")
    def total(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(costs_in_pieces(list(map(list, a)), list(map(list, b)), cost, gap))

    return rows.withColumn("cost", total("a", "b"))


def feature_errors(pairs: list[tuple[str, str]]) -> list[float | None]:
    """Of each form and ancestor form what aligning them costs, for each of the ancestor's segments; None if either has none that are known."""
    segs = {x: segments_of(x) for pair in pairs for x in pair}
    known = {x: any(map(features, s)) for x, s in segs.items()}
    held = [(x, y) for x, y in pairs if known[x] and known[y]]
    costs = costs_in_pieces([segs[x] for x, _ in held], [segs[y] for _, y in held], distance, GAP)
    found = {(x, y): float(c) / len(segs[y]) for (x, y), c in zip(held, costs, strict=True)}
    return [found.get(pair) for pair in pairs]


def feature_error(form: str | None, proto: str | None) -> float | None:
    return feature_errors([(form or "", proto or "")])[0]


def best_morpheme_by_features(forms: DataFrame, proto: str = "proto_form") -> DataFrame:
    """morph_index: the part of form with the smallest feature_error; the first of equals, and 0 for a single part or if either form is missing. Parts without known segments are passed over. The different pairs of a batch are aligned all at once."""

    @F.pandas_udf("int")
    def best(form: pd.Series, ancestor: pd.Series) -> pd.Series:
        parts = [re.split(" |-", x) if x and y else [] for x, y in zip(form, ancestor, strict=True)]
        pairs = list(dict.fromkeys((part, y) for own, y in zip(parts, ancestor, strict=True) if len(own) > 1 for part in own))
        error = dict(zip(pairs, feature_errors(pairs), strict=True))
        out = []
        for own, y in zip(parts, ancestor, strict=True):
            found = [(e, i) for i, part in enumerate(own) if len(own) > 1 and (e := error[part, y]) is not None]
            out.append(min(found)[1] if found else 0)
        return pd.Series(out, dtype="int32")

    return forms.withColumn("morph_index", best("form", proto))


def best_morpheme(forms: DataFrame, proto: str = "proto_form") -> DataFrame:
    """morph_index: the part of form that is most like the ancestor form, by edit distance over the longer one's length; the first of equals, and 0 for a single part. Empty parts are passed over."""
    parts = F.split("form", " |-")
    scored = F.filter(F.transform(parts, lambda m, i: F.struct((F.levenshtein(m, F.col(proto)) / F.greatest(F.length(m), F.length(proto), F.lit(1))).alias("d"), i.alias("i"), m.alias("m"))), lambda x: x["m"] != "")
    return forms.withColumn("morph_index", F.when(F.size(parts) <= 1, 0).otherwise(F.coalesce(F.array_min(F.transform(scored, lambda x: F.struct(x["d"], x["i"])))["i"], F.lit(0))))
