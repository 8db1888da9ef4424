"""Transcriptions as columns: normal form, morphemes, segments and syllables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonology import inventory, is_vowel

TIE, LONG, ASPIRATED = "͡", "ː", "ʰ"
#: Combining tone marks, tone digits, retroflex letters and affricates.
TONE_MARKS = "̀́̂̌̄̋̏᷄᷅᷈"
TONE_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
UNDERDOT, RETROFLEX = "̣", {"t": "ʈ", "d": "ɖ", "s": "ʂ", "z": "ʐ", "n": "ɳ", "l": "ɭ"}
AFFRICATES = ["ts", "dz", "tʃ", "dʒ", "tɕ", "dʑ", "tθ", "dð", "pf", "bv", "kx", "ɡɣ", "tɬ", "dɮ"]
#: Letters that h aspirates, and second parts of affricates that it does behind a tie.
ASPIRABLE, AFFRICATE_ENDS = "pbtdkgɡcɟqɢʔʈɖ", "szʃʒɕʑθðfvxɣɬɮ"
#: Vowel letters, by the table of features; letters with marks count as the letter they are built on.
VOWELS = "".join(c for c in inventory() if is_vowel(c))
CONSONANT = rf"[\p{{L}}&&[^{VOWELS}]]"
#: Letters of the inventory, and their capitals, which forms that aren't transcribed have: segments without features.
LETTERS = inventory() + "".join(dict.fromkeys(c.upper() for c in inventory() if len(c.upper()) == 1 and c.upper() != c))


def as_ranges(letters: str) -> str:
    """letters as ranges for a class of a pattern: matching is much quicker than with each by itself."""
    out: list[list[int]] = []
    for c in sorted(set(map(ord, letters))):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


#: One of LETTERS; those of ASCII are looked for first.
LETTER = f"(?:[a-zA-Z]|[{as_ranges(LETTERS)}])"
#: The longest run that is one segment: a letter, or two with a tie, with its marks. Other characters are passed over.
SEGMENT = rf"(?:{LETTER}{TIE})?{LETTER}[{ASPIRATED}{LONG}\p{{M}}]*"


def strip_marks(text: str) -> str:
    """Underdotted letters become retroflex; tone marks go."""
    out: list[str] = []
    for c in unicodedata.normalize("NFD", text):
        if c == UNDERDOT and out and out[-1] in RETROFLEX:
            out[-1] = RETROFLEX[out[-1]]
        elif c not in TONE_MARKS:
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def strip_tones(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if c not in TONE_MARKS))


def each(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """f as a column function in batches; made where it is used, as workers import this module without a session."""

    def apply(c: Column) -> Column:
        def batch(text: pd.Series) -> pd.Series:
            return text.map(f, na_action="ignore")

        return F.pandas_udf(batch, "string")(c)

    return apply


#: These need canonical decomposition, for which there is no built-in function.
marks_stripped, tones_stripped = each(strip_marks), each(strip_tones)


def without_digits(c: Column) -> Column:
    return F.translate(c, TONE_DIGITS, "")


def long_vowels(c: Column) -> Column:
    """Two equal vowels in a row become a long one, pair by pair from the left."""
    return F.regexp_replace(c, rf"([{VOWELS}])\1", f"$1{LONG}")


def letters_mapped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("ñ"), F.lit("ɲ")), F.lit("ñ"), F.lit("ɲ"))


def digraphs(c: Column) -> Column:
    return F.replace(c, F.lit("ng"), F.lit("ŋ"))


def tied(c: Column) -> Column:
    """Affricates get a tie, unless the text has one anywhere."""
    out = c
    for a in AFFRICATES:
        out = F.replace(out, F.lit(a), F.lit(a[0] + TIE + a[1]))
    return F.when(F.contains(c, F.lit(TIE)), c).otherwise(out)


def aspirated(c: Column) -> Column:
    return F.regexp_replace(c, f"(?<=[{ASPIRABLE}])h|(?<={TIE}[{AFFRICATE_ENDS}])h", ASPIRATED)


def y_to_j(c: Column) -> Column:
    """y becomes j, but not as a whole word, before a consonant, or at a word's end after one."""
    return F.regexp_replace(c, rf"y(?!{CONSONANT})(?:(?=[^ -])|(?<=[{VOWELS}]y|[^\p{{L}} -]y)(?![^ -]))", "j")


def single_g(c: Column) -> Column:
    return F.replace(c, F.lit("g"), F.lit("ɡ"))


def normalized(c: Column) -> Column:
    """The whole chain; null and empty stay."""
    out = marks_stripped(c)
    for step in (without_digits, long_vowels, letters_mapped, digraphs, tied, aspirated, y_to_j, single_g):
        out = step(out)
    return F.when(F.length(c) > 0, out).otherwise(c)


def morpheme(form: Column, index: Column) -> Column:
    """The part with that number between hyphens and spaces; the whole form if there is none."""
    parts = F.filter(F.split(form, r"[-\s]+"), lambda x: x != "")
    return F.when((index >= 0) & (index < F.size(parts)), F.get(parts, index)).otherwise(form)


def raw_morphs(form: Column) -> Column:
    """Parts between single hyphens and spaces, empty ones too."""
    return F.split(form, " |-")


def strong(form: Column, index: Column) -> Column:
    """form with its part of that number marked strong."""
    pieces = F.regexp_extract_all(F.coalesce(form, F.lit("")), F.lit("([^ -]+)( |-|)"), F.lit(0))
    mark = lambda x, i: F.when(i == index, F.concat(F.lit("<strong>"), F.regexp_extract(x, "^([^ -]+)", 1), F.lit("</strong>"), F.regexp_extract(x, "([ -]?)$", 1))).otherwise(x)
    return F.array_join(F.transform(pieces, mark), "")


def segments(form: Column) -> Column:
    """The segments of a form, by the inventory; what it doesn't have is dropped."""
    return F.regexp_extract_all(form, F.lit(SEGMENT), F.lit(0))


def segment_text(form: Column) -> Column:
    return F.array_join(segments(form), " ")


def gloss_words(gloss: Column) -> Column:
    return F.regexp_extract_all(gloss, F.lit("[A-Za-z]+"), F.lit(0))


def form_or_fallback(ipa: Column, form: Column) -> Column:
    return F.coalesce(F.nullif(ipa, F.lit("")), form)


def gloss_or_unknown(gloss: Column) -> Column:
    return F.coalesce(F.nullif(gloss, F.lit("")), F.lit("unknown"))


def shown(value: Column, has_data: Column) -> Column:
    """How a segment is shown: a gap as ∅, no data as a dash."""
    return F.when(F.coalesce(value, F.lit("")).isin("", "-"), F.when(has_data, "∅").otherwise("—")).otherwise(value)
