"""Lexicon files: lines of gloss and form, in either encoding; and result tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def delimiter_of(lines: list[str]) -> str:
    """A tab if the first five lines have as many tabs as commas or more, else a comma."""
    head = lines[:5]
    tabs, commas = (sum(x.count(c) for x in head) for c in "\t,")
    return "\t" if tabs >= commas else ","


def delimiter_counts(line: Column) -> tuple[Column, Column]:
    """Tabs and commas of a line."""
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return count("\t"), count(",")


BLANK = " \t\n\x0b\x0c\r"


def first_lines(text: Column, n: int = 5) -> Column:
    """The first n lines that aren't blank."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    return F.array_join(F.slice(lines, 1, n), "\n")


def parse_lines(lines: DataFrame, delimiter: str, column: str = "value", *keys: str) -> DataFrame:
    """(keys, gloss, form) of lines with two fields or more, both not blank; further fields are ignored and quotes mean nothing."""
    blank = F.lit(BLANK)
    fields = F.split(F.col(column), delimiter)
    out = lines.select(*keys, F.btrim(F.get(fields, F.lit(0)), blank).alias("gloss"), F.btrim(F.get(fields, F.lit(1)), blank).alias("form"))
    return out.where("gloss <> '' and form <> ''")


#: Lines of a file that its delimiter is told by.
HEAD = 5


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (path, block, id, line: binary) the first HEAD of each block of a file that aren't blank."""
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        at = []
        for k, (path, block, line) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
            n = seen.get((path, block), 0)
            if n < HEAD and line.strip(BLANK.encode()):
                seen[path, block] = n + 1
                at.append(k)
        if at:
            yield batch.take(pa.array(at))


def read_lexicon(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(path, gloss, form) of the lines of all files under path, UTF-8 or, where a file isn't that, Latin-1. A file's delimiter is that of its first HEAD lines that aren't blank, unless given.

    Files are read by lines, a large one by several tasks: a line end is never part of another
    character, so a file is UTF-8 if all its lines are. That, and the delimiter, come from a first
    reading; a row for each file is joined to the second.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    valid = lines.groupBy("path").agg(F.min(F.is_valid_utf8("value")).alias("valid"))
    if delimiter is None:
        numbered = lines.select("path", "block", F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line"))
        heads = numbered.mapInArrow(_heads, "path string, block long, id long, line binary")
        first = heads.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("block", "id", "line"))), 1, HEAD)["line"].alias("lines"))
        tabs, commas = delimiter_counts(F.array_join(F.transform("lines", lambda x: F.decode(x, "ISO-8859-1")), "\n"))
        files = valid.join(first.select("path", F.when(tabs >= commas, "\t").otherwise(",").alias("mark")), "path", "left")
    else:
        files = valid.withColumn("mark", F.lit(delimiter))
    text = F.when(F.col("valid"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    fields = lines.join(files, "path").select("path", F.split(text, F.when(F.col("mark") == ",", ",").otherwise(F.coalesce("mark", F.lit("\t")))).alias("f"))
    blank = F.lit(BLANK)
    return fields.select("path", F.btrim(F.get("f", F.lit(0)), blank).alias("gloss"), F.btrim(F.get("f", F.lit(1)), blank).alias("form")).where("gloss <> '' and form <> ''")


def write_ranking(ranking: DataFrame, path: str) -> None:
    """A ranking, in the place of the one before."""
    ranking.write.mode("overwrite").parquet(path)


def page_of(page: DataFrame, total: int, filtered: int, draw: int = 0) -> dict:
    """A page with its counts, as a client of paged tables expects it. Pages are small by their limit."""
    return {"draw": draw, "recordsTotal": total, "recordsFiltered": filtered, "data": [r.asDict() for r in page.collect()]}
