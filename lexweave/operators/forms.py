"""Intake of word forms: normal form, syllables, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonology
from ..functions.text import each, normalized
from .align import segments_of

PREVIEW = 10


def _syllabified(text: str) -> str:
    """Syllables of each word joined by hyphens; words that no segment is found in stay."""
    words = [w for w in text.split(" ") if w]
    return " ".join("-".join(phonology.syllables(segments_of(w))) or w for w in words)


def process_form(form: Column) -> Column:
    """struct<processed, original>: a form in normal form and in syllables. Hyphens it came with go; a blank one gives an empty text."""
    plain = F.replace(normalized(F.trim(form)), F.lit("-"), F.lit(""))
    return F.struct(F.when(F.length(F.trim(form)) > 0, each(_syllabified)(plain)).otherwise(F.lit("")).alias("processed"), form.alias("original"))


def preview(entries: DataFrame) -> tuple[DataFrame, int]:
    """The first entries (gloss, form), processed, and how many there are in all."""
    return entries.limit(PREVIEW).select("gloss", process_form(F.col("form")).alias("x")).select("gloss", "x.*"), entries.count()


def set_of(rows: DataFrame, key: str) -> DataFrame:
    """One cognate set (skey, lang, form), ready to be aligned. An unknown key, or a set of its ancestor alone, is an error."""
    found = rows.where(F.col("skey") == key)
    if found.where("lang <> 'proto'").limit(1).count() == 0:
        raise LookupError(key)
    return found


def selected(rows: DataFrame, languages: list[str] | None, proto: str = "proto") -> DataFrame:
    """Rows of the selected languages, the ancestor's always among them; None selects all."""
    return rows if languages is None else rows.where(F.col("lang").isin([proto, *languages]))
