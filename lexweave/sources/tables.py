"""Lexicon tables made from the star schema and from whole texts, and their SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import form_or_fallback, gloss_or_unknown, morpheme
from .kept import kept

#: Where ids of ancestor forms and of ancestor languages begin.
PROTO_FORM, PROTO_LANGUAGE = 10_000_000, 1000


@dataclass
class Lexicon:
    """reflexes (refid, langid, form, gloss, ipaform), languages (langid, name), ancestry (langid, plangid), edges (refid, prefid, plangid, morph_index)."""

    reflexes: DataFrame
    languages: DataFrame
    ancestry: DataFrame
    edges: DataFrame


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def star_lexicon(spark: SparkSession, folder: str) -> Lexicon:
    """Parts are word forms of nations, customers ancestor forms of regions, line items the edges between them."""
    nation, region, part, customer = (read(spark, folder, t) for t in ("nation", "region", "part", "customer"))
    long = lambda c: F.expr(c).cast("long")
    languages = nation.select(long("n_nationkey").alias("langid"), F.col("n_name").alias("name")).unionByName(region.select(long(f"{PROTO_LANGUAGE} + r_regionkey").alias("langid"), F.col("r_name").alias("name")))
    ancestry = nation.select(long("n_nationkey").alias("langid"), long(f"{PROTO_LANGUAGE} + n_regionkey").alias("plangid"))
    words = part.select(long("p_partkey").alias("refid"), long("p_size % 25").alias("langid"), F.col("p_name").alias("form"), F.col("p_type").alias("gloss"))
    of_region = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    protos = of_region.select(long(f"{PROTO_FORM} + c_custkey").alias("refid"), long(f"{PROTO_LANGUAGE} + n_regionkey").alias("langid"), F.col("c_mktsegment").alias("form"), F.col("c_name").alias("gloss"))
    owners = of_region.select("c_custkey", long(f"{PROTO_LANGUAGE} + n_regionkey").alias("plangid"))
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(owners, F.col("o_custkey") == owners["c_custkey"])
    edges = joined.groupBy(F.col("l_partkey").cast("long").alias("refid"), long(f"{PROTO_FORM} + o_custkey").alias("prefid"), "plangid").agg((F.min("l_linenumber") % 2).cast("int").alias("morph_index"))
    return Lexicon(words.unionByName(protos).withColumn("ipaform", F.col("form")), languages, ancestry, edges)


STAR_SQL = """WITH languages AS (SELECT CAST(n_nationkey AS BIGINT) AS langid, n_name AS name FROM nation
  UNION ALL SELECT CAST(1000 + r_regionkey AS BIGINT), r_name FROM region),
ancestry AS (SELECT CAST(n_nationkey AS BIGINT) AS langid, CAST(1000 + n_regionkey AS BIGINT) AS plangid FROM nation),
reflexes AS (SELECT CAST(p_partkey AS BIGINT) AS refid, CAST(p_size % 25 AS BIGINT) AS langid, p_name AS form, p_type AS gloss, p_name AS ipaform FROM part
  UNION ALL SELECT CAST(10000000 + c_custkey AS BIGINT), CAST(1000 + n_regionkey AS BIGINT), c_mktsegment, c_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
edges AS (SELECT CAST(l_partkey AS BIGINT) AS refid, CAST(10000000 + o_custkey AS BIGINT) AS prefid, CAST(1000 + n_regionkey AS BIGINT) AS plangid, CAST(min(l_linenumber) % 2 AS INTEGER) AS morph_index
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
"""


def words_of(texts: DataFrame, *columns: str) -> DataFrame:
    """Distinct (columns, form): the lower-cased runs of letters of whole texts."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"\p{L}+"), F.lit(0))
    return texts.select(*columns, F.explode(found).alias("w")).select(*columns, F.lower("w").alias("form")).distinct()


def word_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(lang, form): the words of all documents."""
    return words_of(read(spark, folder, "documents"), "lang")


WORDS_SQL = r"""WITH words AS (SELECT DISTINCT lang, lower(w) AS form FROM (SELECT lang, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents))
"""


def set_key(form):
    """Forms of one cognate set share their first three letters and their length."""
    return F.concat(F.substring(form, 1, 3), F.lit("/"), F.length(form).cast("string"))


def cognate_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(skey, lang, form): all words of all languages, and for each key one ancestor form as proto: the first benchmark word with that key, or else the first word."""
    # all texts are read for them, and they are used twice at least
    words = kept(word_lexicon(spark, folder)).select(set_key("form").alias("skey"), "lang", "form")
    listed = words_of(read(spark, folder, "benchmark")).select(set_key("form").alias("skey"), F.lit("").alias("lang"), "form")
    rank = F.struct(F.col("lang") != "", "form")
    both = words.unionByName(listed).groupBy("skey").agg(F.min(rank).alias("first"), F.max(F.col("lang") != "").alias("has"))
    protos = both.where("has").select("skey", F.lit("proto").alias("lang"), F.col("first.form").alias("form"))
    return words.unionByName(protos)


def last_forms(sets: DataFrame) -> DataFrame:
    """Of several forms of a language in a set the last."""
    return sets.groupBy("skey", "lang").agg(F.max("form").alias("form"))


SETS_SQL = WORDS_SQL.rstrip() + r""", bench AS (SELECT DISTINCT lower(w) AS form FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM benchmark)),
daughters AS (SELECT substr(form, 1, 3) || '/' || length(form) AS skey, lang, form FROM words),
listed AS (SELECT substr(form, 1, 3) || '/' || length(form) AS skey, min(form) AS form FROM bench GROUP BY 1),
protos AS (SELECT d.skey, coalesce(min(l.form), min(d.form)) AS form FROM daughters d LEFT JOIN listed l USING (skey) GROUP BY 1),
sets AS (SELECT skey, 'proto' AS lang, form FROM protos UNION ALL SELECT skey, lang, form FROM daughters),
lasts AS (SELECT skey, lang, max(form) AS form FROM daughters GROUP BY 1, 2)
"""


def lexicon_sets(lexicon: Lexicon, plangid: int, languages: list[str] | None = None) -> DataFrame:
    """(skey, lang, form, gloss) of all cognate sets of one ancestor language: its forms as proto, and of each form below them the morpheme that counts.

    The form is the transcription, or the spelling where that is missing. languages: names of the
    languages that take part, all if None; sets without a form of these are left out.
    """
    fallback = form_or_fallback(F.col("ipaform"), F.col("form"))
    roots = lexicon.reflexes.where(F.col("langid") == plangid).select(F.col("refid").alias("prefid"), F.coalesce("ipaform", F.lit("")).alias("form"), gloss_or_unknown(F.col("gloss")).alias("gloss"))
    below = lexicon.ancestry.where(F.col("plangid") == plangid).select("langid").distinct()
    named = lexicon.languages if languages is None else lexicon.languages.where(F.col("name").isin(languages))
    forms = lexicon.reflexes.join(below, "langid", "left_semi").join(named, "langid").select("refid", F.col("name").alias("lang"), fallback.alias("form"))
    daughters = lexicon.edges.select("refid", "prefid", "morph_index").join(roots.select("prefid", "gloss"), "prefid").join(forms, "refid")
    daughters = daughters.select(F.col("prefid").cast("string").alias("skey"), "lang", morpheme(F.col("form"), F.col("morph_index")).alias("form"), "gloss")
    protos = roots.select(F.col("prefid").cast("string").alias("skey"), F.lit("proto").alias("lang"), "form", "gloss").join(daughters.select("skey").distinct(), "skey", "left_semi")
    return daughters.unionByName(protos)
