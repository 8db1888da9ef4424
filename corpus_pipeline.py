"""The corpus pipeline: five stages from raw documents to token ids, each written as Parquet and read again.

What holds for every stage: a null text counts as empty and a null id as any other; a text is
worked on whole, whatever its length; repeated rows are judged alike (stage 2 keeps one of them);
columns beyond those of documents pass through the first four stages, whatever their names; no rows
give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.bpe import bpe_encode_decode
from lexweave.llm.decontaminate import find_benchmark_passages
from lexweave.llm.quality_rules import fit_ratios, fit_threshold, is_kept, with_quality, with_trusted
from lexweave.llm.secrets import fit_limits, redact
from lexweave.llm.shared import checkpointed, delete, ensure_checkpoint_dir, free_name, read
from lexweave.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go: among them those without words. Ties with the threshold stay."""
    trusted, quality = free_name("_trusted", *docs.columns), free_name("_quality", *docs.columns)
    flagged = with_trusted(docs, read(spark, sf_dir, "labels"), trusted)
    judged = checkpointed(with_quality(flagged, fit_ratios(flagged, trusted), into=quality))
    return judged.where(is_kept(F.col(quality), fit_threshold(judged, trusted, quality))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; of equal ids that with the smallest hash of its text. Texts without words are copies of each other; a null id counts as the largest."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Each is judged by its own text, so rows that share an id, or have none, need not go together; equal texts do. Texts without words stay."""
    key = free_name("_text", *docs.columns)
    hashed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = find_benchmark_passages(hashed, read(spark, sf_dir, "benchmark"), key).select(key).distinct()
    return hashed.join(found, key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows, if there is such a column. Overlapping finds are marked in the order of the kinds; a null text stays, as does its n_chars."""
    out = docs.withColumn("text", redact(F.col("text"), fit_limits(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document left: no tokens for a text without words."""
    import public_tokenizers

    out = bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("secret_scan", secret_scan), ("bpe", bpe)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, made from the table documents; what each stage returns is written to the shared checkpoint folder, and deleted when the next one's is."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
