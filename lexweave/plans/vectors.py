"""Queries over the vectors, each with its SQL where it has one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import similarity as sim
from ..operators import vector_index
from ..sources.kept import kept, shared_folder
from ..sources.tables import WORDS_SQL, read, word_lexicon

QUERIES, ORACLES = {}, {}
ALPHA, K = 0.4, 10
#: Rows for which the index of the embeddings has a part.
PART = 128


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def corpus(spark, sf_dir) -> DataFrame:
    """Vectors as words: the first half of a vector is its sound, the second its meaning; its label is the language."""
    v = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("refid"), F.col("label").cast("long").alias("langid"), F.slice(v, 1, 32).alias("p"), F.slice(v, 33, 32).alias("s"))


def queries_of(rows: DataFrame) -> DataFrame:
    """The stated query set: every id divisible by 50."""
    return rows.where("refid % 50 = 0")


VECTORS = """WITH v AS (SELECT vec_id AS refid, CAST(label AS BIGINT) AS langid, CAST(embedding AS DOUBLE[])[1:32] AS p, CAST(embedding AS DOUBLE[])[33:64] AS s FROM embeddings),
ancestry AS (SELECT DISTINCT langid, 7 + langid % 3 AS plangid FROM v WHERE langid < 6 UNION SELECT DISTINCT langid, 9 FROM v WHERE langid = 1),
d AS (SELECT q.refid AS q, q.langid AS qlang, c.refid, c.langid, 1 - (0.4 * list_cosine_similarity(q.p, c.p) + 0.6 * list_cosine_similarity(q.s, c.s)) AS dist FROM v q, v c WHERE q.refid % 50 = 0)
"""


def ranked_sql(dist: str, where: str) -> str:
    """The ten nearest of the rows that count, by the distance that counts."""
    return VECTORS + f"SELECT q, refid, langid, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), refid) AS rank FROM (SELECT q, refid, langid, {dist} AS dist FROM d WHERE {where})) WHERE rank <= {K}"


def ancestry_of(rows: DataFrame) -> DataFrame:
    """Languages 7, 8 and 9 are ancestors; 1 has two, 6 none."""
    langs = rows.select("langid").distinct()
    return langs.where("langid < 6").select("langid", (7 + F.col("langid") % 3).alias("plangid")).union(langs.where("langid = 1").select("langid", F.lit(9).cast("long"))).distinct()


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("q", "refid", "langid", F.round("dist", 6).alias("dist"), "rank")


@query(ranked_sql("dist", "qlang <> langid"))
def cosine_topk(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return _shown(sim.nearest(queries_of(rows), rows, K, ALPHA))


@query(ranked_sql("dist", "qlang <> langid"))
def cosine_topk_indexed(spark, sf_dir):
    """The same by the kept index, which is built first."""
    rows = corpus(spark, sf_dir)
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vector_index.build(rows, path, PART)
    return _shown(vector_index.VectorIndex(spark, path).search(queries_of(rows), K, ALPHA))


@query(ranked_sql("dist + CASE WHEN EXISTS (SELECT 1 FROM ancestry x JOIN ancestry y USING (plangid) WHERE x.langid = qlang AND y.langid = d.langid) THEN 0 ELSE 1 END", "qlang <> langid"))
def rank_cognates_penalty(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return _shown(sim.rank_related(queries_of(rows), rows, ancestry_of(rows), K, ALPHA))


@query(ranked_sql("dist", "langid IN (SELECT plangid FROM ancestry)"))
def rank_reconstructions(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return _shown(sim.rank_protoforms(queries_of(rows), rows, ancestry_of(rows), K, ALPHA))


@query(ranked_sql("dist + CASE WHEN langid IN (SELECT langid FROM ancestry WHERE plangid = 7 + q % 4) THEN 0 ELSE 1 END", "langid NOT IN (SELECT plangid FROM ancestry)"))
def rank_reflexes(spark, sf_dir):
    """Of each query as an ancestor form of language 7, 8, 9, or none that is known."""
    rows = corpus(spark, sf_dir)
    asked = queries_of(rows).withColumn("plangid", 7 + F.col("refid") % 4)
    return _shown(sim.rank_reflexes(asked, rows, ancestry_of(rows), K, ALPHA))


EVALUATION = """WITH v AS (SELECT vec_id AS refid, vec_id % 50 AS skey, CAST(label AS BIGINT) AS langid, CAST(embedding AS DOUBLE[])[1:32] AS p, CAST(embedding AS DOUBLE[])[33:64] AS s FROM embeddings),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY refid) AS k, count(*) OVER (PARTITION BY skey) AS n, count(*) OVER (PARTITION BY skey, langid) AS own FROM v) WHERE k <= 2 AND n >= 2 AND n > own),
d AS (SELECT q.refid AS q, c.refid, c.skey = q.skey AS hit, q.n - q.own AS targets, list_cosine_similarity(q.p, c.p) AS cp, list_cosine_similarity(q.s, c.s) AS cs FROM q JOIN v c ON q.langid <> c.langid),
r AS (SELECT a / 10 AS alpha, q, hit, targets, row_number() OVER (PARTITION BY a, q ORDER BY round(1 - (a / 10 * cp + (1 - a / 10) * cs), 9), refid) AS rank FROM d, range(0, 11) t(a)),
h AS (SELECT alpha, q, max(targets) AS targets, count(CASE WHEN hit AND rank <= 5 THEN 1 END) AS h5, count(CASE WHEN hit AND rank <= 10 THEN 1 END) AS h10, count(CASE WHEN hit AND rank <= 20 THEN 1 END) AS h20, count(CASE WHEN hit AND rank <= 50 THEN 1 END) AS h50, min(CASE WHEN hit AND rank <= 50 THEN rank END) AS first FROM r GROUP BY 1, 2),
scores AS (SELECT alpha, count(*) AS n_queries, round(avg(h5 / targets), 6) AS recall5, round(avg(h10 / targets), 6) AS recall10, round(avg(h20 / targets), 6) AS recall20, round(avg(h50 / targets), 6) AS recall50, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM h GROUP BY 1)
"""


@query(EVALUATION + "SELECT * FROM scores")
def alpha_recall(spark, sf_dir):
    return sim.evaluate_alphas(corpus(spark, sf_dir).withColumn("skey", F.col("refid") % 50))


@query(EVALUATION + "SELECT coalesce(arg_max(alpha, mrr * 1000000 - alpha / 1000), 0.5) AS alpha, coalesce(max(mrr), 0) AS mrr FROM scores")
def alpha_best(spark, sf_dir):
    return sim.best_alpha(alpha_recall(spark, sf_dir))


TFIDF = """n AS (SELECT count(DISTINCT id) AS n FROM grams), c AS (SELECT id, gram, count(*) AS tf FROM grams GROUP BY 1, 2),
w AS (SELECT id, gram, tf * (ln((1 + n.n) / (1 + count(*) OVER (PARTITION BY gram))) + 1) AS w FROM c, n)
SELECT id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w"""


@query(WORDS_SQL + """, forms AS (SELECT DISTINCT form AS id FROM words),
grams AS (SELECT id, substr(id, i, k) AS gram FROM forms, range(1, 4) s(k), range(1, 400) r(i) WHERE i + k - 1 <= length(id)), """ + TFIDF)
def tfidf_char_ngrams(spark, sf_dir):
    rows = word_lexicon(spark, sf_dir).select(F.col("form").alias("id")).distinct()
    return sim.tfidf(sim.char_ngrams(rows, F.col("id"))).withColumn("weight", F.round("weight", 6))


@query("""WITH x AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark),
grams AS (SELECT id, unnest(w) AS gram FROM x UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM x, range(1, 100000) r(i) WHERE i < len(w)), """ + TFIDF)
def tfidf_word_bigrams(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return sim.tfidf(sim.word_ngrams(rows, F.col("text"))).withColumn("weight", F.round("weight", 6))


@query()
def related_words(spark, sf_dir):
    """The five words of other languages nearest to every benchmark word's form, by their n-grams."""
    from ..sources.store import build_vectors
    from ..sources.tables import words_of

    key = F.xxhash64("lang", "form")
    words = kept(word_lexicon(spark, sf_dir))
    asked = words_of(read(spark, sf_dir, "benchmark"), "item_id").select("form").distinct()
    code = F.expr("crc32(cast(lang as binary))")
    # meaning doesn't count here
    rows = kept(build_vectors(words.select(key.alias("refid"), code.alias("langid"), F.col("form").alias("ipaform"), F.col("form").alias("gloss")), 32, "p"))
    wanted = words.join(asked, "form", "left_semi").select(key.alias("refid"))
    best = sim.nearest(rows.join(wanted, "refid", "left_semi"), rows, 5, 1.0)
    named = words.select(key.alias("id"), "lang", "form")
    best = best.drop("langid")
    out = best.join(named.select(F.col("id").alias("q"), F.col("form").alias("query")), "q").join(named.withColumnRenamed("id", "refid"), "refid")
    return out.select("query", "lang", "form", F.round("dist", 6).alias("dist"), "rank")


@query()
def pca_whiten(spark, sf_dir):
    out = sim.whitened_pca(corpus(spark, sf_dir), 8)
    return out.select("refid", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query()
def lexicon_vectors(spark, sf_dir):
    """Sound and meaning of all forms of the lexicon, by n-grams and whitened components."""
    from ..sources.store import embed
    from ..sources.tables import star_lexicon

    out = embed(star_lexicon(spark, sf_dir).reflexes, 16)
    return out.select("refid", "langid", *[F.transform(c, lambda x: F.round(x, 4)).alias(c) for c in ("p", "s")])


@query(VECTORS + "SELECT q.refid AS q, c.refid, round(list_cosine_similarity(q.s, c.s) / (levenshtein(CAST(q.refid AS VARCHAR), CAST(c.refid AS VARCHAR)) + 1), 6) AS similarity FROM v q, v c WHERE q.refid % 50 = 0")
def pair_similarity(spark, sf_dir):
    """Every query beside every row."""
    rows = corpus(spark, sf_dir).withColumn("form", F.col("refid").cast("string"))
    return sim.similarities_with_all(queries_of(rows), rows)


@query("WITH v AS (SELECT vec_id AS refid, label FROM embeddings) SELECT refid, CAST(CASE WHEN refid % 7 = 0 THEN -1 ELSE label END AS INTEGER) AS label FROM v WHERE label <> 9")
def vector_updates(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("refid"), F.col("label").cast("int").alias("label"))
    changed = rows.where("refid % 7 = 0").withColumn("label", F.lit(-1))
    return sim.update_vectors(rows, changed, rows.where("label = 9"))
