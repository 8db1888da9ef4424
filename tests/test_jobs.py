import json
import logging
import os
import shutil

import pytest
import yaml
from oracle import check
from pyspark.sql import functions as F

from jobs import law_report, queries, word_intake


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


@pytest.fixture
def places(tmp_path):
    return {n: str(tmp_path / n) for n in ("texts", "out", "checkpoint")}


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def held(df):
    return sorted(map(tuple, df.collect()))


def test_intake_takes_only_what_is_new(spark, sf_dir, places, caplog):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, second = docs.where("doc_id % 3 > 0 and lang in ('en', 'fr')"), docs.where("doc_id % 3 = 0 and lang <> 'fr'")
    first.repartition(5).write.parquet(places["texts"])
    with caplog.at_level(logging.INFO):
        done = word_intake.run(spark, **places, config={"files_per_step": 2})
    assert done["texts"] == first.count() and done["steps"] == 3 and done["languages"] == ["en", "fr"]
    assert "lang=fr" in caplog.text and f"read {done['texts']} texts" in caplog.text
    assert held(word_intake.lexicon(spark, places["out"]).select("lang", "form", "n", "n_capital", "first_doc")) == held(word_intake.word_counts(first))
    before = files_of(places["out"])
    second.coalesce(1).write.mode("append").parquet(places["texts"])
    done = word_intake.run(spark, **places, config={"files_per_step": 2})
    assert done["texts"] == second.count() and done["steps"] == 1 and "fr" not in done["languages"] and {"de", "en", "es"} <= set(done["languages"])
    after = files_of(places["out"])
    kept = {f: t for f, t in before.items() if "/counts/" in f or "lang=fr" in f}
    assert kept.items() <= after.items()
    assert held(word_intake.lexicon(spark, places["out"]).select("lang", "form", "n", "n_capital", "first_doc")) == held(word_intake.word_counts(first.unionByName(second)))
    shutil.rmtree(f"{places['out']}/lexicon/lang=de")
    assert word_intake.run(spark, **places)["languages"] == ["de"]
    assert held(word_intake.lexicon(spark, places["out"]).select("lang", "form", "n", "n_capital", "first_doc")) == held(word_intake.word_counts(first.unionByName(second)))
    assert word_intake.lexicon(spark, places["out"]).where("ipaform is null").count() == 0
    after = files_of(places["out"])
    # nothing new: nothing is read or written
    done = word_intake.run(spark, **places)
    assert (done["texts"], done["steps"], done["languages"]) == (0, 0, []) and files_of(places["out"]) == after


def test_intake_after_failures(spark, sf_dir, places, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(places["texts"])
    whole = held(word_intake.word_counts(docs))
    count, calls = word_intake.word_counts, []

    def failing(*given):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return count(*given)

    monkeypatch.setattr(word_intake, "word_counts", failing)
    with pytest.raises(Exception, match="lost"):
        word_intake.run(spark, **places, config={"files_per_step": 1})
    monkeypatch.setattr(word_intake, "word_counts", count)
    renew = word_intake.renew_lexicon
    monkeypatch.setattr(word_intake, "renew_lexicon", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        word_intake.run(spark, **places, config={"files_per_step": 1})
    monkeypatch.setattr(word_intake, "renew_lexicon", renew)
    done = word_intake.run(spark, **places)
    assert done["steps"] == 0 and len(done["languages"]) >= 4
    assert held(word_intake.lexicon(spark, places["out"]).select("lang", "form", "n", "n_capital", "first_doc")) == whole


def test_intake_of_odd_texts(spark, places):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (None, "Éa éA b", None, "x"), (3, "word " * 100_000, "", "x"), (3, "Word", "", "x"), (4, "12 . 3", "de", "x")]
    spark.createDataFrame(rows, "doc_id int, text string, lang string, form string").write.parquet(places["texts"])
    word_intake.run(spark, **places, config={"least_letters": 2})
    assert held(word_intake.lexicon(spark, places["out"]).select("lang", "form", "n", "n_capital", "first_doc")) == [("und", "word", 100_001, 1, 3), ("und", "éa", 2, 1, None)]
    with pytest.raises(ValueError):
        word_intake.run(spark, **places, config={"other": 1})


def test_intake_of_nothing(spark, sf_dir, places):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(places["texts"])
    done = word_intake.run(spark, **places)
    assert done["texts"] == 0 and word_intake.lexicon(spark, places["out"]).count() == 0


def small_tables(spark, folder, words):
    rows = [(k, w, lang) for k, (w, lang) in enumerate(words)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "matee tone"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


SYSTEM = {"name": "two/laws", "laws": {"short": ["ee", "e", "", ""], "loss": ["e", "", "", "\\Z"]}, "tree": {"ROOT": [{"child": "en", "laws": ["short"]}, {"child": "fr", "laws": ["loss", "nowhere"]}]}}


def test_law_report(spark, tmp_path, caplog):
    small_tables(spark, tmp_path / "in", [("mates", "en"), ("matee", "fr"), ("tone", "fr"), ("tona", "en"), (None, "en"), ("tonx", "xx")])
    out = str(tmp_path / "out")
    with caplog.at_level(logging.INFO):
        done = law_report.run(spark, str(tmp_path / "in"), out, {"system": SYSTEM})
    # mat/5: matee gives mate (en) and mate (fr); ton/4: tone gives tone (en) and ton (fr)
    assert (done["n_sets"], done["n_comparisons"], done["n_errors"], done["penalty"], done["score"]) == (2, 4, 4, 1 + 7.5, 12.5)
    assert "nowhere" in caplog.text and "4 comparisons" in caplog.text
    got = {(r["leaf"], r["form"]): (r["proto"], r["hypothesis"], r["expected"], r["found"], r["n"]) for r in law_report.output(spark, out).collect()}
    assert got == {("en", "mates"): ("matee", "mate", "s", "", 1), ("fr", "matee"): ("matee", "mate", "e", "", 2), ("en", "tona"): ("tone", "tone", "a", "e", 1), ("fr", "tone"): ("tone", "ton", "e", "", 2)}
    first = held(law_report.output(spark, out).fillna(""))
    # again, the same; another system stays beside it; a leaf that is dropped leaves nothing behind
    law_report.run(spark, str(tmp_path / "in"), out, {"system": SYSTEM})
    assert held(law_report.output(spark, out).fillna("")) == first
    law_report.run(spark, str(tmp_path / "in"), out, {"system": SYSTEM | {"name": "other"}})
    law_report.run(spark, str(tmp_path / "in"), out, {"system": SYSTEM | {"tree": {"ROOT": SYSTEM["tree"]["ROOT"][:1]}}})
    assert {(r["system"], r["leaf"]) for r in law_report.output(spark, out).collect()} == {("two_laws", "en"), ("other", "en"), ("other", "fr")}


def test_law_report_of_nothing(spark, tmp_path):
    small_tables(spark, tmp_path / "in", [(None, "en")])
    done = law_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), {"system": SYSTEM})
    assert done["n_comparisons"] == 0
    with pytest.raises(ValueError):
        law_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), {"system": SYSTEM, "other": 1})


def test_common_prefix(spark):
    rows = [("", ""), ("a", ""), ("", "b"), ("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("xbc", "abc"), ("é😀x", "é😀y")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", law_report.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()
    assert {(r["a"], r["b"]): r["n"] for r in got} == {(a, b): len(os.path.commonprefix([a, b])) for a, b in rows}


def test_config_files():
    assert set(yaml.safe_load(open(queries.law_report.CONFIG))) == {"laws_coeff", "refs_coeff", "system"}
    given = yaml.safe_load(open(os.path.join(os.path.dirname(word_intake.__file__), "word_intake.yaml")))
    assert given == word_intake.DEFAULTS and json.dumps(given)
