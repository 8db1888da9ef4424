"""Segments and their features, distances and sonority. The table is this package's own; so absolute distances are too."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["syl", "son", "cons", "cont", "delrel", "lat", "nas", "strid", "voi", "sg", "ant", "cor", "lab", "hi", "lo", "back", "round", "long"]
#: Weights of the features in a distance, and the cost of a gap.
WEIGHTS = {"syl": 1.0, "son": 1.0, "cons": 1.0} | dict.fromkeys(FEATURES[3:], 0.5)
GAP, UNKNOWN_COST = 3.0, 100.0

#: Segment classes: features that hold and (after a slash) that don't apply; all others are -1.
_CLASSES = {
    "syl son cont voi": {"i": "hi", "y": "hi round lab", "e": "", "ø": "round lab", "ɛ": "", "œ": "round lab", "a": "lo", "æ": "lo", "ɐ": "lo", "ə": "", "ɨ": "hi back", "ɯ": "hi back", "u": "hi back round lab", "o": "back round lab", "ɔ": "back round lab", "ʌ": "back", "ɑ": "lo back", "ɪ": "hi", "ʊ": "hi back round lab", "ʉ": "hi round lab", "ʏ": "hi round lab", "ɘ": "", "ɵ": "round lab", "ɤ": "back", "ɜ": "", "ɞ": "round lab", "ɶ": "lo round lab", "ɒ": "lo back round lab"},
    "cons": {"p": "ant lab", "t": "ant cor", "ʈ": "cor", "c": "hi", "k": "hi back", "q": "back", "ʔ": "lo"},
    "cons voi": {"b": "ant lab", "d": "ant cor", "ɖ": "cor", "ɟ": "hi", "ɡ": "hi back", "ɢ": "back"},
    "cons cont": {"f": "ant lab strid", "θ": "ant cor", "s": "ant cor strid", "ʂ": "cor strid", "ʃ": "cor strid hi", "ɕ": "cor strid hi ant", "x": "hi back", "h": "sg", "ɬ": "ant cor lat", "ç": "hi"},
    "cons cont voi": {"v": "ant lab strid", "ð": "ant cor", "z": "ant cor strid", "ʐ": "cor strid", "ʒ": "cor strid hi", "ʑ": "cor strid hi ant", "ɣ": "hi back", "ɮ": "ant cor lat"},
    "cons son nas voi": {"m": "ant lab", "n": "ant cor", "ɳ": "cor", "ɲ": "hi", "ŋ": "hi back"},
    "cons son cont voi": {"l": "ant cor lat", "ɭ": "cor lat", "r": "ant cor", "ɹ": "ant cor"},
    "son cont voi": {"j": "hi", "w": "hi back round lab", "ɥ": "hi round lab"},
}
#: Marks: what they add to a segment.
_MARKS = {"ʰ": ("sg", 1), "ː": ("long", 1), "̃": ("nas", 1)}
TIE = "͡"


def _base() -> dict[str, dict[str, int]]:
    table = {}
    for shared, members in _CLASSES.items():
        for segment, own in members.items():
            held = {*shared.split(), *own.split()}
            table[segment] = {f: 1 if f in held else -1 for f in FEATURES}
            if "syl" in held:
                table[segment] |= {"ant": 0, "cor": 0, "delrel": 0, "strid": 0, "lat": 0}
    return table


BASE = _base()
ALIASES = {"g": "ɡ", "ß": "s"}


@functools.cache
def features(segment: str) -> tuple[tuple[str, int], ...] | None:
    """(feature, value) of a segment with its marks; None if its letter is unknown. An affricate has its second part's features, released late."""
    letters = unicodedata.normalize("NFD", segment)
    tie = letters.find(TIE)
    head = letters[tie + 1 :] if tie > 0 else letters
    found = BASE.get(ALIASES.get(head[:1], head[:1]))
    if found is None:
        return None
    out = dict(found)
    if tie > 0:
        out |= {"delrel": 1, "cont": -1}
    for mark in head[1:]:
        if mark in _MARKS:
            out[_MARKS[mark][0]] = _MARKS[mark][1]
    return tuple(out.items())


def is_vowel(letter: str) -> bool:
    """Whether the table has the letter as the peak of a syllable."""
    held = features(letter)
    return held is not None and dict(held)["syl"] == 1


def is_consonant(letter: str) -> bool:
    """Any other letter: one that the table doesn't have counts too."""
    return unicodedata.category(letter).startswith("L") and not is_vowel(letter)


@functools.cache
def inventory() -> str:
    """All single letters that the table has features for: its own, other spellings of them, and lower-case letters with marks that are built on one."""
    marked = (c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and features(c) is not None)
    return "".join(dict.fromkeys([*BASE, *ALIASES, *marked]))


def canonical(segment: str) -> str:
    """v counts as w, and ɹ as r."""
    return {"v": "w", "ɹ": "r"}.get(segment, segment)


@functools.cache
def distance(a: str, b: str) -> float:
    a, b = canonical(a), canonical(b)
    if a == b:
        return 0.0
    x, y = features(a), features(b)
    if x is None or y is None:
        return UNKNOWN_COST
    y = dict(y)
    return sum(WEIGHTS[f] * abs(v - y[f]) for f, v in x) / 2


def segment_vectors(pairs: DataFrame, *columns: str) -> DataFrame:
    """(seg, v): the weighted features of the kinds of segments that the columns hold; none for unknown ones. There is a row for each kind of segment: the letters of the table with their marks."""

    @F.pandas_udf("array<double>")
    def weighted(segs: pd.Series) -> pd.Series:
        return pd.Series([None if (held := features(canonical(s))) is None else [WEIGHTS[f] * v for f, v in held] for s in segs])

    kinds = functools.reduce(DataFrame.union, [pairs.select(F.col(c).alias("seg")) for c in columns]).where("seg is not null").distinct()
    return kinds.withColumn("v", weighted("seg")).where("v is not null")


def with_distance(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with the column cost: the distance of two segments, from the features of each kind of segment, which are looked up once and joined. A null segment is unknown."""
    vectors = segment_vectors(pairs, a, b)
    side = lambda n: vectors.select(F.col("seg").alias(f"_{n}"), F.col("v").alias(f"_v{n}"))
    known = pairs.join(side("a"), F.col(a) == F.col("_a"), "left").join(side("b"), F.col(b) == F.col("_b"), "left")
    same = lambda c: F.when(F.col(c) == "v", "w").when(F.col(c) == "ɹ", "r").otherwise(F.col(c))
    apart = F.aggregate(F.zip_with("_va", "_vb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x) / 2
    cost = F.when(same(a) == same(b), 0.0).otherwise(F.coalesce(apart, F.lit(UNKNOWN_COST)))
    return known.select(*[pairs[c] for c in pairs.columns], cost.alias("cost"))


def sonority(segment: str) -> int:
    """1 (voiceless stop) to 9 (low vowel); unknown segments count as 1."""
    x = dict(features(segment) or ())
    if not x:
        return 1
    if x["syl"] == 1:
        return 9 if x["hi"] != 1 else 8
    if x["cons"] != 1:
        return 7
    if x["son"] == 1:
        return 5 if x["nas"] == 1 else 6
    return (3 if x["cont"] == 1 else 1) + (x["voi"] == 1)


#: Conflations of sonority for syllables.
COARSE = {9: 9, 8: 9, 7: 7, 6: 6, 5: 5, 4: 4, 3: 4, 2: 4, 1: 4}
FINE = {9: 9, 8: 9, 7: 7, 6: 6, 5: 5, 4: 4, 3: 3, 2: 2, 1: 1}
PEAK = 8


def syllables(parts: list[str], classes: dict[int, int] = COARSE, onsetless: bool = True) -> list[str]:
    """Segments in syllables. onsetless=False starts none with the first of two vowels."""
    level = [classes[sonority(p)] for p in parts]
    peaks = [k for k, s in enumerate(level) if s >= PEAK]
    starts = []
    for k in range(len(parts)):
        if k == 0 or not peaks:
            starts.append(True)
            continue
        left, here, right = level[k - 1], level[k], level[k + 1] if k + 1 < len(level) else None
        inner = peaks[0] <= k <= peaks[-1]
        # level[k - 2] is the last segment's at k = 1; kept as it is for equal results
        flat = left == here == level[k - 2]
        stays = not inner or left < here or (left > here and (right is None or here >= right)) or flat
        hiatus = right is not None and here >= PEAK and right >= PEAK
        starts.append(not stays and (onsetless or not hiatus))
    out: list[str] = []
    for p, new in zip(parts, starts, strict=True):
        if new:
            out.append(p)
        else:
            out[-1] += p
    return out


def parse_syllable(parts: list[str]) -> tuple[str, str, str]:
    """Onset, nucleus and coda: before, at and after the first most sonorous segment."""
    if not parts:
        return "", "", ""
    level = [sonority(p) for p in parts]
    k = level.index(max(level))
    return "".join(parts[:k]), parts[k], "".join(parts[k + 1 :])
