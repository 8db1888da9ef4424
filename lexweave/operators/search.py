"""Filtered, sorted and paged views of a lexicon."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strong
from ..sources.tables import Lexicon

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def is_pattern(term: str) -> bool:
    return term.startswith("^") or term.endswith("$") or "|" in term or all(c in term for c in "()") or all(c in term for c in "[]")


def matches_regex(column: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether the pattern is found; never for null, and nowhere if it isn't valid."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.coalesce(column.rlike(("(?idU)" if ignore_case else "(?dU)") + pattern), F.lit(False))


def matches_like(column: Column, term: str) -> Column:
    """LIKE %term%, with A-Z as a-z; % and _ in term are wildcards, a backslash is itself."""
    fold = lambda c: F.translate(c, UPPER, LOWER)
    return fold(column).like("%" + term.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


def matches(column: Column, term: str) -> Column:
    """The condition of one search field. An empty term lets all but nulls pass."""
    if not term:
        return column.isNotNull()
    return matches_regex(column, term) if is_pattern(term) else matches_like(column, term)


@dataclass
class Search:
    """Terms of the three search fields, the order, and the page: length 0 is an empty page, a negative one has no end."""

    language: str = ""
    form: str = ""
    gloss: str = ""
    order: str = "refid"
    descending: bool = False
    start: int = 0
    length: int = 0
    columns: tuple[str, ...] = field(default=("refid", "name", "ipaform", "gloss", "langid"))


def named(lexicon: Lexicon) -> DataFrame:
    """Forms with their language's name. There are few languages: Spark broadcasts them by their size."""
    return lexicon.reflexes.join(lexicon.languages, "langid")


def filtered(rows: DataFrame, search: Search) -> DataFrame:
    return rows.where(matches(F.col("name"), search.language) & matches(F.col("ipaform"), search.form) & matches(F.col("gloss"), search.gloss))


def page(rows: DataFrame, search: Search) -> DataFrame:
    """One page, in total order: the id breaks ties. Unknown columns sort by id."""
    order = search.order if search.order in rows.columns else "refid"
    ordered = rows.orderBy(F.col(order).desc() if search.descending else F.col(order).asc(), "refid").offset(max(search.start, 0))
    return ordered.limit(search.length) if search.length >= 0 else ordered


def with_set_flag(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """in_set: 1 for forms that belong to a cognate set."""
    member = lexicon.edges.select("refid").distinct().withColumn("_member", F.lit(1))
    return rows.join(member, "refid", "left").withColumn("in_set", F.when(F.col("_member").isNotNull(), 1).otherwise(0)).drop("_member")


def search_reflexes(lexicon: Lexicon, search: Search) -> DataFrame:
    return page(with_set_flag(filtered(named(lexicon), search), lexicon), search)


def counts(lexicon: Lexicon, search: Search) -> DataFrame:
    """total and filtered, in one pass over the forms."""
    rows = lexicon.reflexes.join(lexicon.languages, "langid", "left")
    hit = F.col("name").isNotNull() & matches(F.col("name"), search.language) & matches(F.col("ipaform"), search.form) & matches(F.col("gloss"), search.gloss)
    return rows.agg(F.count("*").alias("total"), F.count(F.when(hit, 1)).alias("filtered"))


def protoforms(lexicon: Lexicon) -> DataFrame:
    """Forms of languages that something descends from."""
    return lexicon.reflexes.join(lexicon.ancestry.select(F.col("plangid").alias("langid")).distinct(), "langid", "left_semi")


def ids_of(text: str) -> list[int]:
    """The whole numbers of a comma list; anything else is dropped."""
    return [int(x) for x in text.split(",") if x.isdigit()]


def protoforms_of(lexicon: Lexicon, refids: list[int] | DataFrame) -> DataFrame:
    """Ancestor forms of the given forms. No id gives no rows."""
    of = lexicon.edges.where(F.col("refid").isin(refids)) if isinstance(refids, list) else lexicon.edges.join(refids, "refid", "left_semi")
    return protoforms(lexicon).join(of.select(F.col("prefid").alias("refid")).distinct(), "refid", "left_semi")


def is_proto(lexicon: Lexicon, refid: int) -> bool:
    return bool(protoforms(lexicon).where(F.col("refid") == refid).limit(1).count())


def supporting(lexicon: Lexicon, prefid: int | None = None) -> DataFrame:
    """The forms of a cognate set, the morpheme that counts marked strong."""
    edges = lexicon.edges if prefid is None else lexicon.edges.where(F.col("prefid") == prefid)
    rows = edges.join(named(lexicon), "refid")
    return rows.select("refid", "prefid", "langid", "name", strong(F.col("ipaform"), F.col("morph_index")).alias("ipaform"), "gloss", "morph_index")


def cognate_rows(lexicon: Lexicon) -> DataFrame:
    """All cognate sets at once: a row for each edge with its form and language."""
    return lexicon.edges.join(named(lexicon), "refid")


def language_identifiers(languages: DataFrame) -> DataFrame:
    """identifier: the code if there is a real one, else the name, else lang_<id>."""
    code = F.nullif(F.nullif(F.col("glottocode"), F.lit("unk")), F.lit(""))
    return languages.withColumn("identifier", F.coalesce(code, F.col("name"), F.concat(F.lit("lang_"), F.col("langid").cast("string"))))


def sharing_ancestor(ancestry: DataFrame) -> DataFrame:
    """Pairs of languages (a, b) with an ancestor in common; as many rows as such pairs, one for each."""
    left, right = (ancestry.select(F.col("langid").alias(n), "plangid") for n in ("a", "b"))
    return left.join(right, "plangid").where("a <> b").select("a", "b").distinct()
