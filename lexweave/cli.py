"""python -m lexweave.cli: scores a system of sound laws on cognate sets or a lexicon, or lists the systems of a folder."""

from __future__ import annotations

import argparse

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import laws
from .sources.tables import Lexicon


def main(argv: list[str] | None = None) -> str:
    """Prints a report, set by set, and returns its last part, the metrics; or prints and returns the list of systems."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("system", nargs="?", help="a YAML file, or the name of a system or a file in --folder")
    p.add_argument("--folder", default=".")
    p.add_argument("--sets", help="Parquet of cognate sets: skey, lang, form")
    p.add_argument("--proto", default="proto", help="the ancestor's name in the sets")
    p.add_argument("--lexicon", help="a folder with Parquet tables reflexes, languages, ancestry and edges, in the place of --sets")
    p.add_argument("--proto-langid", type=int)
    p.add_argument("--proto-glottocode")
    p.add_argument("--laws-coeff", type=float, default=laws.LAW_COST)
    p.add_argument("--refs-coeff", type=float, default=laws.REFERENCE_COST)
    p.add_argument("--errors-only", action="store_true")
    p.add_argument("--limit", type=int, help="so many sets at most; all of them if it isn't given")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--list", action="store_true")
    a = p.parse_args(argv)
    if a.list:
        out = "\n".join(f"{name}: {path}" for path, name in laws.list_systems(a.folder)) or f"no systems in {a.folder}"
        print(out)
        return out
    if not a.system or not (a.sets or a.lexicon):
        p.error("a system and --sets or --lexicon are needed")
    spark = SparkSession.builder.getOrCreate()
    costs = {"law_cost": a.laws_coeff, "reference_cost": a.refs_coeff}
    try:
        with open(laws.locate(a.system, a.folder), encoding="utf-8") as f:
            text = f.read()
        system = laws.System.loads(text)
        if a.lexicon:
            lexicon = Lexicon(*(spark.read.parquet(f"{a.lexicon}/{t}.parquet") for t in ("reflexes", "languages", "ancestry", "edges")))
            detail = laws.lexicon_detail(lexicon, system, laws.resolve_proto(lexicon, a.proto_langid, a.proto_glottocode))
        else:
            sets = spark.read.parquet(a.sets)
            detail = laws.evaluate(sets.where(F.col("lang") == a.proto).select("skey", "form"), sets.where(F.col("lang") != a.proto), system)
    except (yaml.YAMLError, LookupError, ValueError) as e:
        p.error(f"{a.system}: {type(e).__name__}: {e}")
    parts = []
    for part in laws.report_parts(detail, system, a.errors_only, not a.no_color, a.limit, **costs):
        print(part, end="\n\n")
        parts = [part]
    return parts[0]


if __name__ == "__main__":
    main()
