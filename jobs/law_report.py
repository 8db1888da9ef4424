"""Scores a system of sound laws on the words of texts, and shows where it goes wrong.

python -m jobs.law_report --tables FOLDER --out FOLDER [--config FILE]

Words of the documents are grouped with an ancestor form each, the laws are applied to that form
down to each leaf of the tree, and what comes out is compared with the leaf's own form. A run
replaces all that an earlier one wrote for the same system; other systems' results stay, so that
systems can be compared.

    out/results/system=S/leaf=L      skey, proto, hypothesis, form, correct, expected, found
    out/confusions/system=S/leaf=L   expected, found, n
    out/summary/system=S             leaf, n_sets, n_comparisons, n_errors, accuracy, penalty, score

expected and found are the first characters in which form and hypothesis differ, empty where one
has ended. The summary has a row for each leaf and one for all (leaf is null), with the penalty
that the laws cost; it is JSON, the others are Parquet.
"""

from __future__ import annotations

import argparse
import logging
import re
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import laws
from lexweave.sources.tables import cognate_sets, last_forms

log = logging.getLogger("jobs.law_report")
CONFIG = Path(__file__).with_suffix(".yaml")
DEFAULTS = {"laws_coeff": laws.LAW_COST, "refs_coeff": laws.REFERENCE_COST}
RESULTS = "skey string, proto string, hypothesis string, form string, correct boolean, expected string, found string, system string, leaf string"
CONFUSIONS = "expected string, found string, n long, system string, leaf string"
SUMMARY = "leaf string, n_sets long, n_comparisons long, n_errors long, accuracy double, penalty double, score double, system string"


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters both begin with."""
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)) + 1)
    return F.array_min(F.filter(places, lambda k: (F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1))) | (k > F.least(F.length(a), F.length(b))))) - 1


def with_difference(detail: DataFrame) -> DataFrame:
    """detail (form, hypothesis, correct) with expected and found, null where it is correct."""
    at = common_prefix(F.col("form"), F.col("hypothesis")) + 1
    return detail.withColumns({n: F.when(~F.col("correct"), F.substring(F.col(c), at, F.lit(1))) for n, c in (("expected", "form"), ("found", "hypothesis"))})


def summary_of(results: DataFrame, penalty: float) -> DataFrame:
    """Metrics of each leaf, and of all of them (leaf is null)."""
    errors = F.count(F.when(~F.col("correct"), 1))
    made = results.cube("leaf").agg(F.countDistinct("skey").alias("n_sets"), F.count("*").alias("n_comparisons"), errors.alias("n_errors"))
    accuracy = F.when(F.col("n_comparisons") > 0, 1 - F.col("n_errors") / F.col("n_comparisons")).otherwise(0.0)
    return made.select("*", accuracy.alias("accuracy"), F.lit(penalty).alias("penalty"), (F.col("n_errors") + F.lit(penalty)).alias("score"))


def folder_of(out: str, table: str, system: str) -> str:
    return f"{out}/{table}/system={re.sub('[^A-Za-z0-9_.-]', '_', system)}"


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict:
    """Scores the config's system on the words of tables; its metrics, as a dictionary."""
    config = DEFAULTS | (config or yaml.safe_load(CONFIG.read_text(encoding="utf-8")))
    if unknown := set(config) - {*DEFAULTS, "system"}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    system = laws.System.loads(yaml.safe_dump(config["system"]))
    for name in system.undefined():
        log.warning("the tree names a law that isn't defined: %s", name)
    sets = last_forms(cognate_sets(spark, tables))
    detail = laws.evaluate(sets.where("lang = 'proto'").select("skey", "form"), sets.where("lang <> 'proto'"), system)
    results, confusions, summary = (folder_of(out, t, system.name) for t in ("results", "confusions", "summary"))
    with_difference(detail).hint("rebalance", "leaf").write.mode("overwrite").partitionBy("leaf").parquet(results)
    # the rest is made of what has been written, so that the words are read once
    held = spark.read.schema(RESULTS).parquet(results)
    wrong = held.where("not correct").groupBy("leaf", "expected", "found").agg(F.count("*").alias("n"))
    wrong.hint("rebalance", "leaf").write.mode("overwrite").partitionBy("leaf").parquet(confusions)
    penalty = system.penalty(config["laws_coeff"], config["refs_coeff"])
    summary_of(held, penalty).coalesce(1).write.mode("overwrite").json(summary)
    rows = spark.read.schema(SUMMARY).json(summary).collect()  # a row for each leaf
    log.info("read the words of %s; %s has %d laws, %d mentions", tables, system.name, len(system.laws), system.references())
    for r in rows:
        log.info("wrote %s: %s, %d comparisons, %d errors, accuracy %.4f", results, r["leaf"] or "all leaves", r["n_comparisons"], r["n_errors"], r["accuracy"])
    return next((r.asDict() for r in rows if r["leaf"] is None), {"n_comparisons": 0, "n_errors": 0, "penalty": penalty})


def output(spark: SparkSession, out: str) -> DataFrame:
    """The results of all systems as they stand, each beside its leaf's metrics and how often that confusion occurs."""
    results = spark.read.schema(RESULTS).parquet(f"{out}/results")
    confusions = spark.read.schema(CONFUSIONS).parquet(f"{out}/confusions")
    summary = spark.read.schema(SUMMARY).json(f"{out}/summary").select("system", "leaf", F.col("n_errors").alias("leaf_errors"), "accuracy", "score")
    return results.join(F.broadcast(summary), ["system", "leaf"]).join(confusions, ["system", "leaf", "expected", "found"], "left")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--tables", required=True, help="a folder with documents.parquet and benchmark.parquet")
    p.add_argument("--out", required=True)
    p.add_argument("--config", default=str(CONFIG), help="a YAML file with the system and what laws cost")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("law_report").getOrCreate()
    try:
        run(spark, a.tables, a.out, yaml.safe_load(Path(a.config).read_text(encoding="utf-8")))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
