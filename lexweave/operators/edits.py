"""Changes of a lexicon, as functions from tables to tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept
from .align import best_morpheme_by_features

UPLOAD, CREATED = -1, -2
#: How a transcription is made of a form.
Normal = Callable[[Column], Column]


def add_reflex(reflexes: DataFrame, new: DataFrame, normal: Normal) -> DataFrame:
    """New forms, their transcription made from form; columns that they lack are null."""
    return reflexes.unionByName(new.withColumn("ipaform", normal(F.col("form"))), allowMissingColumns=True)


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges (refid, prefid, ...) that aren't there yet."""
    fresh = new.dropDuplicates(["refid", "prefid"]).join(edges, ["refid", "prefid"], "left_anti")
    return edges.unionByName(fresh.select(*edges.columns))


def add_supporting(edges: DataFrame, reflexes: DataFrame, new: DataFrame) -> DataFrame:
    """New edges (refid, prefid, plangid) that aren't there yet, each with the morpheme that is most like its ancestor by features; a form that is missing counts as empty."""
    fresh = new.dropDuplicates(["refid", "prefid"]).join(edges, ["refid", "prefid"], "left_anti")
    forms = reflexes.select("refid", F.coalesce("ipaform", F.lit("")).alias("form"))
    protos = reflexes.select(F.col("refid").alias("prefid"), F.coalesce("ipaform", F.lit("")).alias("proto_form"))
    return edges.unionByName(best_morpheme_by_features(fresh.join(forms, "refid", "left").join(protos, "prefid", "left")).select(*edges.columns))


def add_all_pairs(edges: DataFrame, reflexes: DataFrame, refids: list[int], prefids: list[int], plangid: int) -> DataFrame:
    """An edge for each of the chosen forms and ancestor forms; both lists are what a user selected."""
    pairs = [(r, p, plangid) for r in refids for p in prefids]
    return add_supporting(edges, reflexes, edges.sparkSession.createDataFrame(pairs, edges.select("refid", "prefid", "plangid").schema)) if pairs else edges


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["refid", "prefid"], "left_anti")


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_reflex(lexicon: dict[str, DataFrame], refid: int, form: str, gloss: str, normal: Normal) -> dict[str, DataFrame]:
    """The tables with a form's new spelling and gloss: reflexes, and transcription and gloss in all other tables (rankings) that show them. Vectors of the form are made anew by update_vectors."""
    own, ipa = F.col("refid") == refid, normal(F.lit(form))
    shown = {"form": F.lit(form), "gloss": F.lit(gloss), "ipaform": ipa}
    return {name: update_where(t, own, **{c: v for c, v in shown.items() if c in t.columns}) for name, t in lexicon.items()}


def update_morph_index(edges: DataFrame, refid: int, prefid: int, morph_index: int) -> DataFrame:
    return update_where(edges, (F.col("refid") == refid) & (F.col("prefid") == prefid), morph_index=F.lit(morph_index))


def delete_reflexes(reflexes: DataFrame, edges: DataFrame, gone: DataFrame, edge_column: str = "refid") -> tuple[DataFrame, DataFrame]:
    """Both tables without the forms in gone (refid), and without the edges that name them in edge_column."""
    return reflexes.join(gone, "refid", "left_anti"), edges.join(gone.select(F.col("refid").alias(edge_column)), edge_column, "left_anti")


def delete_not_in(table: DataFrame, column: str, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go) by NOT IN."""
    values = kept.select(F.col(kept.columns[0]).alias("_kept"))
    known = values.agg(F.count("*").alias("_n"), F.count("_kept").alias("_held"))  # one row
    flagged = table.join(values.where("_kept is not null").distinct().withColumn("_in", F.lit(True)), F.col(column) == F.col("_kept"), "left").join(F.broadcast(known))
    goes = (F.col("_n") == 0) | (F.col("_in").isNull() & F.col(column).isNotNull() & (F.col("_n") == F.col("_held")))
    return flagged.where(~goes).select(*table.columns), flagged.where(goes).select(*table.columns)


def foreign_edges(reflexes: DataFrame, languages: DataFrame, ancestry: DataFrame, edges: DataFrame, plangid: int) -> DataFrame:
    """What a clean-up reports: edges to an ancestor of plangid whose form is of a language that is NOT IN its descendants, with form, gloss and the language's name."""
    below = ancestry.where(F.col("plangid") == plangid).select("langid")
    _, foreign = delete_not_in(reflexes.select("refid", "langid", "form", "gloss"), "langid", below)
    return edges.where(F.col("plangid") == plangid).join(foreign, "refid").join(languages.select("langid", "name"), "langid")


def clean_up(reflexes: DataFrame, languages: DataFrame, ancestry: DataFrame, edges: DataFrame, plangid: int, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, report): edges without those that are reported, unless it is a dry run. Of a form whose language has no name the edge goes too, though the report does not name it."""
    report = foreign_edges(reflexes, languages, ancestry, edges, plangid)
    if dry_run:
        return edges, report
    below = ancestry.where(F.col("plangid") == plangid).select("langid")
    _, foreign = delete_not_in(reflexes.select("refid", "langid"), "langid", below)
    gone = edges.where(F.col("plangid") == plangid).join(foreign, "refid", "left_semi").select("refid").distinct().withColumn("plangid", F.lit(plangid).cast(edges.schema["plangid"].dataType))
    return edges.join(gone, ["refid", "plangid"], "left_anti").select(*edges.columns), report


def add_etymon(reflexes: DataFrame, ranking: DataFrame, form: str, gloss: str, plangid: int, refid: int, normal: Normal) -> tuple[DataFrame, DataFrame]:
    """Both tables with a new ancestor form, first in the ranking (refid, langid, ipaform, gloss, sim). Blank fields and a language of 0 or less are refused."""
    if not form.strip() or not gloss.strip() or plangid <= 0:
        raise ValueError("form, gloss and ancestor language are needed")
    new = reflexes.sparkSession.createDataFrame([(refid, plangid, CREATED, form, gloss)], "refid long, langid long, sourceid long, form string, gloss string")
    row = new.withColumn("ipaform", normal(F.col("form")))
    return reflexes.unionByName(row, allowMissingColumns=True), upsert(ranking, row.select("refid", "langid", "ipaform", "gloss", F.lit(0.0).alias("sim")), "refid")


def add_set(reflexes: DataFrame, ranking: DataFrame, edges: DataFrame, form: str, gloss: str, plangid: int, refid: int, member: int, morph_index: int, normal: Normal) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with a new ancestor form and its first member."""
    reflexes, ranking = add_etymon(reflexes, ranking, form, gloss, plangid, refid, normal)
    edge = edges.sparkSession.createDataFrame([(member, refid, plangid, morph_index)], "refid long, prefid long, plangid long, morph_index int")
    return reflexes, ranking, edges.unionByName(edge.select(*edges.columns))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new in the place of rows with the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


SAMPLES = 10


def backfill(reflexes: DataFrame, normal: Normal) -> tuple[DataFrame, dict]:
    """ipaform made anew from form for all rows, null and empty forms giving an empty one; and what a report names: rows in all, without a transcription before and after, and some whose transcription is not their form. Nothing changes if all have one."""
    empty = lambda c: F.count(F.when(F.coalesce(c, F.lit("")) == "", 1))
    total, missing = reflexes.agg(F.count("*"), empty(F.col("ipaform"))).first()
    out = reflexes.withColumn("ipaform", F.coalesce(normal(F.col("form")), F.lit(""))) if missing else reflexes
    samples = out.where("form <> ipaform").orderBy("refid").limit(SAMPLES).select("form", "ipaform").collect() if missing else []
    return out, {"total": total, "missing": missing, "remaining": out.agg(empty(F.col("ipaform"))).first()[0] if missing else 0, "samples": [tuple(r) for r in samples]}


def numbered(rows: DataFrame, *order: str, first: int = 0) -> DataFrame:
    """rows with the column number, from first on in the order of the columns, which equal rows share in any way. Rows are sorted by range and numbered within each range; how many stand before a range is a number for each task."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # a partition's rows have the numbers from its own times 2 ** 33 on
    placed = kept(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    before = dict(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=first), strict=False))
    starts = rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))


def upload(reflexes: DataFrame, languages: DataFrame, ancestry: DataFrame, entries: DataFrame, name: str, plangids: list[str], first_refid: int, normal) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with the entries (gloss, form) of one language, which is found by its name or added; ids that aren't whole numbers are skipped."""
    spark = reflexes.sparkSession
    found = languages.where(F.col("name") == name).agg(F.min("langid")).first()[0]
    langid = found if found is not None else (languages.agg(F.max("langid")).first()[0] or 0) + 1
    if found is None:
        languages = languages.unionByName(spark.createDataFrame([(langid, name)], "langid long, name string"), allowMissingColumns=True)
    edges = [(langid, int(p)) for p in plangids if p.lstrip("-").isdigit()]
    if edges:
        new = spark.createDataFrame(edges, "langid long, plangid long").distinct()
        ancestry = ancestry.unionByName(new.join(ancestry, ["langid", "plangid"], "left_anti"), allowMissingColumns=True)
    # by a total order, so that a repeated run gives the same numbers
    rows = numbered(entries, "gloss", "form", first=first_refid).select(F.col("number").alias("refid"), F.lit(langid).cast("long").alias("langid"), F.lit(UPLOAD).cast("long").alias("sourceid"), "form", "gloss", normal(F.col("form")).alias("ipaform"))
    return reflexes.unionByName(rows, allowMissingColumns=True), languages, ancestry
