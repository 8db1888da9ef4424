"""The jobs as queries over whole tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.laws import System
from lexweave.plans.words import ORACLES as WORD_ORACLES
from lexweave.plans.words import laws_sql
from lexweave.sources.kept import shared_folder
from lexweave.sources.tables import SETS_SQL

from . import law_report, word_intake


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_word_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of all documents, after a second run that finds nothing new."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        word_intake.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return word_intake.lexicon(spark, f"{folder}/out")


def job2_law_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the sample system, after a second run that replaces the first one's."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        law_report.run(spark, sf_dir, folder)
    return law_report.output(spark, folder).withColumn("accuracy", F.round("accuracy", 9))


QUERIES = {"job1_word_intake": job1_word_intake, "job2_law_report": job2_law_report}
_SAMPLE = yaml.safe_load(law_report.CONFIG.read_text(encoding="utf-8"))
_SYSTEM = System.loads(yaml.safe_dump(_SAMPLE["system"]))
_PENALTY = _SYSTEM.penalty(_SAMPLE["laws_coeff"], _SAMPLE["refs_coeff"])
_MADE = " UNION ALL ".join(f"SELECT skey, form, '{leaf}' AS leaf, {x} AS hypothesis FROM protos WHERE form <> ''" for leaf, x in laws_sql(_SYSTEM).items())
#: The transcription of each word, as the query of whole words has it.
_TRANSCRIBED = WORD_ORACLES["normalize_full"]
ORACLES = {
    "job1_word_intake": rf"""WITH made AS ({_TRANSCRIBED}),
runs AS (SELECT doc_id, coalesce(nullif(lang, ''), 'und') AS lang, unnest(regexp_extract_all(text, '\p{{L}}+')) AS w FROM documents),
c AS (SELECT lang, lower(w) AS form, count(*) AS n, count(CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN 1 END) AS n_capital, min(doc_id) AS first_doc FROM runs GROUP BY 1, 2)
SELECT c.lang, c.form, made.made AS ipaform, n, n_capital, first_doc FROM c JOIN made ON c.lang = made.lang AND c.form = made.form""",
    "job2_law_report": SETS_SQL
    + f""", made AS ({_MADE}),
detail AS (SELECT m.skey, m.leaf, m.form AS proto, m.hypothesis, d.form, m.hypothesis = d.form AS correct FROM made m JOIN lasts d ON m.skey = d.skey AND m.leaf = d.lang WHERE d.form <> ''),
placed AS (SELECT *, list_min(list_filter(range(1, least(length(form), length(hypothesis)) + 2), lambda k: substr(form, k, 1) <> substr(hypothesis, k, 1) OR k > least(length(form), length(hypothesis)))) AS p FROM detail),
r AS (SELECT skey, leaf, proto, hypothesis, form, correct, CASE WHEN NOT correct THEN substr(form, p, 1) END AS expected, CASE WHEN NOT correct THEN substr(hypothesis, p, 1) END AS found FROM placed),
s AS (SELECT leaf, count(CASE WHEN NOT correct THEN 1 END) AS leaf_errors, count(*) AS total FROM r GROUP BY 1),
f AS (SELECT leaf, expected, found, count(*) AS n FROM r WHERE NOT correct GROUP BY ALL)
SELECT '{_SYSTEM.name}' AS system, leaf, expected, found, skey, proto, hypothesis, form, correct, leaf_errors, round(1 - leaf_errors / total, 9) AS accuracy, leaf_errors + CAST({_PENALTY} AS DOUBLE) AS score, n
FROM r JOIN s USING (leaf) LEFT JOIN f USING (leaf, expected, found)""",
}
