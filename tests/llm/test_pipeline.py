import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lexweave.llm import bpe, decontaminate, quality_rules, secrets


def test_stages_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = cp.quality_rules(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    flagged = quality_rules.with_trusted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "trusted")
    judged = quality_rules.with_quality(flagged, quality_rules.fit_ratios(flagged, "trusted"))
    passes = quality_rules.is_kept(F.col("_quality"), quality_rules.fit_threshold(judged, "trusted"))
    assert {r[0] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in judged.where(passes).collect()}
    deduped = cp.near_dedup(spark, kept, sf_dir)
    texts = [r["text"] for r in deduped.collect()]
    assert deduped.columns == docs.columns and len(texts) == len(set(texts))
    assert {r["text"] for r in kept.collect()} >= set(texts) and len(texts) < kept.count()
    clean = cp.decontaminate(spark, deduped, sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.find_benchmark_passages(clean, bench).count() == 0
    assert deduped.count() - clean.count() == decontaminate.find_benchmark_passages(deduped, bench).select("doc_id").distinct().count()
    safe = cp.secret_scan(spark, clean, sf_dir)
    assert safe.columns == docs.columns and safe.count() == clean.count()
    assert secrets.with_secrets(safe, secrets.fit_limits(clean)).where("size(_secrets) > 0").count() == 0
    assert safe.where("n_chars <> length(text)").count() == 0
    out = cp.bpe(spark, safe, sf_dir)
    assert out.count() == safe.count() and bpe.OffsetTable


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 0
    assert out.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_empty_and_null_documents(spark, sf_dir, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert cp.STAGES[k][1](spark, docs.limit(0), sf_dir).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "x", 0), (2, "a " * 12, "en", "x", 24)], docs.schema)
    assert cp.STAGES[k][1](spark, odd, sf_dir).count() <= 3


def test_odd_rows(spark, sf_dir):
    """Null and repeated ids, a benchmark passage in some of them, clashing columns, no n_chars, and a long text."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    long = " ".join(f"word{k % 9973}x{k % 7}" for k in range(200_000))
    rows = [(None, "a clean text of a few words"), (None, " ".join(f"before{k}" for k in range(40)) + " " + item + " and after"), (7, "seven " + item), (7, "seven without it"), (8, long), (9, None)]
    docs = spark.createDataFrame([(i, t, "k", "h", "i", 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, _key string, _h string, _id string, _target int, _quality int, _secrets int, _trusted int")
    clean = cp.decontaminate(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert sorted(map(repr, [tuple(r)[:2] for r in clean.collect()])) == sorted(map(repr, [rows[0], rows[3], rows[4], rows[5]]))
    kept = cp.near_dedup(spark, docs.unionByName(docs), sf_dir)
    assert kept.columns == docs.columns and sorted(map(repr, [tuple(r)[:2] for r in kept.collect()])) == sorted(map(repr, rows))
    assert cp.quality_rules(spark, docs, sf_dir).columns == docs.columns
    safe = cp.secret_scan(spark, docs, sf_dir)
    assert safe.columns == docs.columns and safe.where("doc_id = 8").first()["text"] == long
    out = cp.bpe(spark, safe, sf_dir)
    assert out.count() == 6 and out.where("doc_id = 9").first()["n_tokens"] == 0


def test_near_dedup_is_an_exact_join(spark, sf_dir):
    """Stage 2 keeps what an exact join on the similarity of five-word shingles keeps, on the first stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    kept = {r["doc_id"] for r in cp.near_dedup(spark, docs, sf_dir).collect()}
    assert kept == {rows[k][0] for k in set(root)} and len(kept) < len(rows)
