"""Takes word forms in from files of texts as they arrive, and keeps the lexicon of all of them.

python -m jobs.word_intake --texts FOLDER --out FOLDER --checkpoint FOLDER [--config FILE]

Texts are Parquet files (doc_id, text, lang). A file stream with a checkpoint hands over the files
that no earlier run has taken. The words of each step are counted and written to out/counts, in
the partitions of the step and its languages; a step that is repeated after a failure writes the
same partitions again. Then the languages that have steps which their part of out/lexicon does not
know yet get these added; all others stay as they are. Counts are never deleted, so that a part of
the lexicon can always be made again.

    out/counts/step=N/lang=L    form, n, n_capital, first_doc
    out/lexicon/lang=L          form, ipaform, n, n_capital, first_doc, last_step
"""

from __future__ import annotations

import argparse
import logging

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import normalized

log = logging.getLogger("jobs.word_intake")
DEFAULTS = {"files_per_step": 16, "least_letters": 1, "unknown_language": "und"}
COUNTS = "form string, n long, n_capital long, first_doc long, step long, lang string"
LEXICON = "form string, ipaform string, n long, n_capital long, first_doc long, last_step long, lang string"


def word_counts(texts: DataFrame, least_letters: int = 1, unknown_language: str = "und") -> DataFrame:
    """(lang, form, n, n_capital, first_doc) of texts (doc_id, text, lang): how often each lower-cased run of letters occurs in a language, how often with a capital first, and the smallest document that has it. Null texts have no words; a null or empty language has the name for unknown ones; a word only of texts without an id has no first_doc."""
    runs = F.regexp_extract_all("text", F.lit(rf"\p{{L}}{{{int(least_letters)},}}"), F.lit(0))
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit(unknown_language)).alias("lang")
    words = texts.select(F.col("doc_id").cast("long").alias("doc_id"), lang, F.explode(runs).alias("word"))
    capital = F.count(F.when(F.col("word").rlike(r"^\p{Lu}"), 1))
    return words.groupBy("lang", F.lower("word").alias("form")).agg(F.count("*").alias("n"), capital.alias("n_capital"), F.min("doc_id").alias("first_doc"))


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or one without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def as_pattern(path: str) -> str:
    """path as a pattern that fits itself alone: a file stream takes a single file only by a pattern."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def write(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions of path that rows has; others stay. A large partition is several files, small ones are one task's."""
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take_in(spark: SparkSession, texts: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Counts the words of all files that are new, step by step, and waits for the end."""
    taken = {"steps": 0, "texts": 0}

    def step(batch: DataFrame, number: int) -> None:
        n = batch.count()  # from the files' own counts of rows
        counts = word_counts(batch, config["least_letters"], config["unknown_language"]).withColumn("step", F.lit(number).cast("long"))
        # a step that is done again replaces its own partitions and no others
        write(counts, f"{out}/counts", "step", "lang")
        taken["steps"] += 1
        taken["texts"] += n
        log.info("step %d: read %d texts of %s", number, n, texts)

    stream = spark.readStream.schema(spark.read.parquet(texts).schema).option("maxFilesPerTrigger", config["files_per_step"]).parquet(as_pattern(texts.rstrip("/")))
    query = stream.select("doc_id", "text", "lang").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return taken


def renew_lexicon(spark: SparkSession, out: str) -> list[str]:
    """Writes the lexicon of the languages that have steps which it doesn't know yet; their names.

    A language's part is made of what it is and of the counts of later steps; words that are new get
    their transcription. Which steps are known is read from the part itself: what a failed run has
    left undone the next one does, and a part that has been lost is made anew from all steps.
    """
    counts, known = read_or_none(spark, f"{out}/counts", COUNTS), read_or_none(spark, f"{out}/lexicon", LEXICON)
    marks = known.groupBy("lang").agg(F.max("last_step").alias("known"))
    steps = counts.groupBy("lang").agg(F.max("step").alias("last_step"))
    behind = steps.join(marks, "lang", "left").where("known is null or known < last_step").collect()  # a row for each language
    if not behind:
        return []
    languages = sorted(r["lang"] for r in behind)
    later = spark.createDataFrame([(r["lang"], -1 if r["known"] is None else r["known"], r["last_step"]) for r in behind], "lang string, known long, until long")
    mine = F.col("lang").isin(languages)  # reaches the scans as a choice of partitions
    new = counts.where(mine).join(F.broadcast(later), "lang").where("step > known").select("lang", "form", F.lit(None).cast("string").alias("ipaform"), "n", "n_capital", "first_doc")
    both = known.where(mine).select(*new.columns).unionByName(new)
    words = both.groupBy("lang", "form").agg(F.max("ipaform").alias("ipaform"), F.sum("n").alias("n"), F.sum("n_capital").alias("n_capital"), F.min("first_doc").alias("first_doc"))
    words = words.join(F.broadcast(later.select("lang", F.col("until").alias("last_step"))), "lang")
    made = words.where("ipaform is null").withColumn("ipaform", normalized(F.col("form")))
    write(words.where("ipaform is not null").unionByName(made), f"{out}/lexicon", "lang")
    return languages


def lexicon(spark: SparkSession, out: str) -> DataFrame:
    """The lexicon as it stands: (lang, form, ipaform, n, n_capital, first_doc)."""
    return read_or_none(spark, f"{out}/lexicon", LEXICON).select("lang", "form", "ipaform", "n", "n_capital", "first_doc")


def run(spark: SparkSession, texts: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Takes in what is new; what was read and written, as a dictionary. Without new files nothing changes."""
    config = DEFAULTS | (config or {})
    if unknown := set(config) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    done = take_in(spark, texts, out, checkpoint, config)
    languages = renew_lexicon(spark, out)
    rows = {r["lang"]: r["count"] for r in lexicon(spark, out).groupBy("lang").count().collect()}
    log.info("read %d texts in %d steps from %s", done["texts"], done["steps"], texts)
    for lang in languages:
        log.info("wrote %d forms to %s/lexicon/lang=%s", rows[lang], out, lang)
    return done | {"languages": languages, "forms": sum(rows.values())}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--texts", required=True, help="a folder of Parquet files, or one file")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True, help="a folder of this job's own")
    p.add_argument("--config", help="a YAML file such as jobs/word_intake.yaml")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = yaml.safe_load(open(a.config, encoding="utf-8")) if a.config else None
    spark = SparkSession.builder.appName("word_intake").getOrCreate()
    try:
        run(spark, a.texts, a.out, a.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
