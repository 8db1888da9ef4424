"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode_decode
from .decontaminate import find_benchmark_passages
from .language import fit_language, predict_language
from .passages import fit_quality, score_quality
from .quality_rules import fit_ratios, fit_threshold, is_kept, with_quality, with_trusted
from .secrets import fit_limits, spans_text, with_secrets
from .shared import checkpointed, read
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .spelling import runs_of_letters, spelling_variants
from .substring import remove_repeats
from .templates import main_texts
from .urls import LISTED_PARTS, hosts_with_parts, judge_urls

#: Rules of the url query.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def held_out(column: str = "doc_id"):
    """Whether a document is kept out of learning: one in five, by its id's hash."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_bidirectional_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict_language(docs, fit_language(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge_urls(pages, URL_RULES, hosts_with_parts(pages))


def op4_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_trusted(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), "trusted")
    judged = checkpointed(with_quality(docs, fit_ratios(docs, "trusted")).select("doc_id", "trusted", "_quality"))
    return judged.select("doc_id", "_quality.*", is_kept(F.col("_quality"), fit_threshold(judged, "trusted")).alias("kept"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.withColumn("similarity", F.round("similarity", 6))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_secrets(docs, fit_limits(docs)).select("doc_id", "_secrets")
    count = lambda k: F.size(F.filter("_secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("_secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("_secrets")).alias("spans"))


def op9_attention_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels").where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_texts(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def misspelt_runs(docs: DataFrame) -> DataFrame:
    """(word): the runs of at least six letters in documents, of which one in 199, by the hash of its document and itself, has lost a character."""
    runs = runs_of_letters(docs, 6, "text", "doc_id")
    runs = runs.select("word", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary")).alias("h"))
    at = F.pmod("h", F.length("word")).cast("int")
    return runs.select(F.when(F.col("h") % 199 == 0, F.concat(F.left("word", at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = misspelt_runs(read(spark, sf_dir, "documents")).groupBy("word").agg(F.count("*").alias("n"))
    return spelling_variants(counts.where((F.length("word") >= 6) & (F.col("n") >= 5)))


QUERIES = {"op2_bidirectional_gru": op2_bidirectional_gru, "op9_attention_passages": op9_attention_passages, "op5_decontaminate": op5_decontaminate, "op7_block_anchors": op7_block_anchors, "op1_simhash": op1_simhash, "op3_url_cascade": op3_url_cascade, "op4_ngram_ratio_rules": op4_ngram_ratio_rules, "op8_randomness_battery": op8_randomness_battery, "op6_histogram_shards": op6_histogram_shards, "op10_bpe": op10_bpe, "op11_template_classes": op11_template_classes, "op12_spelling_variants": op12_spelling_variants}
_PART = "|".join(LISTED_PARTS)
_BLOCKED = f"regexp_matches(host, '(^|\\.)([^.]*-)?({_PART})-[^.]*(\\.|$)|(^|\\.)[^.]*-({_PART})(-[^.]*)?(\\.|$)')"
_RULES = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{h}{p}'" for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])))

ORACLES: dict[str, str] = {
    "op3_url_cascade": f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r AS (SELECT *, CASE {_RULES} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL OR {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op7_block_anchors": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM p WHERE i + 49 <= len(w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(0, 50) r(k)),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS t FROM p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
}
