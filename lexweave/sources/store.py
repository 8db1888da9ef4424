"""Vectors kept between sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import gloss_or_unknown, segment_text
from ..operators.similarity import char_ngrams, tfidf, tfidf_rows, unit, whitened_sparse, word_ngrams
from .kept import dealt

#: Vectors that one task joins.
ROWS = 65_536
COLUMNS = {"refid": "bigint", "langid": "bigint", "p": "array<double>", "s": "array<double>"}


def hashed_vectors(weights: DataFrame, dims: int) -> DataFrame:
    """(id, v): weights (id, gram, weight) summed into dims places by hash, with length 1."""
    place = F.pmod(F.xxhash64("gram"), F.lit(dims)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("gram", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    held = weights.select("id", place.alias("place"), (F.col("weight") * sign).alias("w"))
    # a sum for each place: an id's weights never stand in one collection
    sums = held.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("place") == k, F.col("w"))), F.lit(0.0)).alias(f"_{k}") for k in range(dims)])
    return sums.select("id", unit(F.array(*[f"_{k}" for k in range(dims)])).alias("v"))


def embed(reflexes: DataFrame, dims: int = 300, features: int = 1024) -> DataFrame:
    """(refid, langid, p, s) of forms (refid, langid, ipaform, gloss): sound from character n-grams of the form's segments, meaning from words of the gloss and pairs of them, features n-grams at most, each brought to dims whitened components at most, without a dense table. Null forms count as empty, null and empty glosses as unknown."""
    rows = reflexes.select(F.col("refid").alias("id"), "langid", segment_text(F.coalesce("ipaform", F.lit(""))).alias("form"), gloss_or_unknown(F.col("gloss")).alias("gloss"))

    def side(grams: DataFrame, name: str) -> DataFrame:
        return whitened_sparse(tfidf_rows(grams, rows, features), dims, features).withColumnRenamed("v", name)

    # equal vectors are packed to few bytes, which tell adaptive execution little of the rows that a task sorts
    n = rows.count()
    tables = [rows.select("id", "langid"), side(char_ngrams(rows, F.col("form")), "p"), side(word_ngrams(rows, F.col("gloss")), "s")]
    forms, p, s = (dealt(t, n, ROWS, "id") for t in tables)
    return forms.join(p, "id").join(s, "id").select(F.col("id").alias("refid"), "langid", "p", "s")


def build_vectors(reflexes: DataFrame, dims: int = 64, sides: str = "ps") -> DataFrame:
    """(refid, langid, p, s) of forms (refid, langid, ipaform, gloss), without dense tables, for lexicons of any size: sound from character n-grams of the form, meaning from words of the gloss; sides: only one of them, if not both are needed. Null and empty glosses count as unknown, null forms as empty."""
    rows = reflexes.select(F.col("refid").alias("id"), "langid", F.coalesce("ipaform", F.lit("")).alias("form"), gloss_or_unknown(F.col("gloss")).alias("gloss"))
    grams = {"p": lambda: char_ngrams(rows, F.col("form")), "s": lambda: word_ngrams(rows, F.col("gloss"))}
    joined = rows
    for name in sides:
        joined = joined.join(hashed_vectors(tfidf(grams[name]()), dims).withColumnRenamed("v", name), "id", "left")
    zero = F.array_repeat(F.lit(0.0), dims)
    return joined.select(F.col("id").alias("refid"), "langid", *[F.coalesce(name, zero).alias(name) for name in sides])


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select(*COLUMNS).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors that save_vectors wrote; others are refused."""
    found = spark.read.parquet(path)
    if dict(found.dtypes) != COLUMNS:
        raise RuntimeError(f"{path} holds no vectors of this kind: {dict(found.dtypes)}")
    return found
