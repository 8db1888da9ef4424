"""Systems of sound laws: loading, applying them forward, and scoring."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import morpheme
from ..sources.tables import Lexicon
from .search import language_identifiers

ROOT, MISSING = "ROOT", "???"
LAW_COST, REFERENCE_COST = 0.5, 2.5
#: Laws that one expression applies.
CHAIN = 16


@dataclass(frozen=True)
class Law:
    """source becomes target between left and right; all but target are patterns."""

    source: str
    target: str
    left: str = ""
    right: str = ""

    @classmethod
    def of(cls, given: list | dict) -> Law:
        if isinstance(given, dict):
            return cls(*(str(given.get(k, "")) for k in ("source", "target", "left", "right")))
        return cls(*(str(x) for x in [*given, "", "", ""][:4]))

    def java(self) -> tuple[str, str]:
        """Pattern and replacement for Spark. Python's spelling of groups and of the end of a text is put in Java's."""
        pattern = f"(?<left>{self.left})({self.source})(?<right>{self.right})"
        re.compile(pattern.replace("(?<left>", "(?P<left>").replace("(?<right>", "(?P<right>"))
        pattern = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
        return pattern, "${left}" + re.sub(r"([\\$])", r"\\\1", self.target) + "${right}"

    def apply(self, column: Column) -> Column:
        return F.regexp_replace(column, *self.java())

    def apply_to(self, word: str) -> str:
        return re.sub(f"(?P<left>{self.left})({self.source})(?P<right>{self.right})", lambda m: m["left"] + self.target + m["right"], word)


@dataclass
class System:
    """laws by name; tree: for each parent its children, each with the laws on its edge."""

    name: str = "unnamed"
    laws: dict[str, Law] = field(default_factory=dict)
    tree: dict[str, list[tuple[str, list[str]]]] = field(default_factory=dict)

    @classmethod
    def loads(cls, text: str) -> System:
        data = yaml.safe_load(text) or {}
        tree = {p: [(c["child"], list(c.get("laws") or [])) for c in children or []] for p, children in (data.get("tree") or {}).items()}
        return cls(data.get("name", "unnamed"), {k: Law.of(v) for k, v in (data.get("laws") or {}).items()}, tree)

    def leaves(self) -> dict[str, list[str]]:
        """The law names from the root to each leaf; {ROOT: []} if there is no tree. A leaf reached twice keeps the path met last; a cycle is an error."""
        if ROOT not in self.tree:
            return {ROOT: []}
        found: dict[str, list[str]] = {}
        todo: list[tuple[str, list[str], tuple[str, ...]]] = [(ROOT, [], ())]
        while todo:
            node, path, above = todo.pop()
            if node in above:
                raise ValueError(f"{node} is below itself")
            if node not in self.tree:
                found[node] = path
            for child, laws in self.tree.get(node, []):
                todo.append((child, path + laws, (*above, node)))
        return found

    def undefined(self) -> list[str]:
        return sorted({x for children in self.tree.values() for _, laws in children for x in laws} - set(self.laws))

    def references(self) -> int:
        return sum(len(laws) for children in self.tree.values() for _, laws in children)

    def penalty(self, law_cost: float = LAW_COST, reference_cost: float = REFERENCE_COST) -> float:
        """Laws that are defined, and mentions of laws, defined or not."""
        return law_cost * len(self.laws) + reference_cost * self.references()

    def steps(self) -> tuple[list[tuple[int, int, list[Law]]], dict[str, int]]:
        """The tree as steps (form, form before it, laws between them), forms numbered from 0, the ancestor's, each after the one it is made from; and each leaf's form.

        Leaves whose paths begin with the same laws share the forms of these: each law of the tree
        stands in one step, however many leaves lie below it. Laws that aren't defined are passed
        over. A step has at most CHAIN laws, so that no expression grows with a path's length.
        """
        paths = {leaf: [name for name in path if name in self.laws] for leaf, path in self.leaves().items()}
        steps: list[tuple[int, int, list[Law]]] = []
        forms: dict[str, int] = {}
        todo = [(0, 0, list(paths))]
        while todo:
            form, depth, below = todo.pop()
            branches: dict[str, list[str]] = {}
            for leaf in below:
                if len(paths[leaf]) == depth:
                    forms[leaf] = form
                else:
                    branches.setdefault(paths[leaf][depth], []).append(leaf)
            for name, leaves in branches.items():
                run, at = [self.laws[name]], depth + 1
                # on as long as all of these leaves go on alike
                while len(run) < CHAIN and len({tuple(paths[leaf][at : at + 1]) for leaf in leaves}) == 1 and len(paths[leaves[0]]) > at:
                    run.append(self.laws[paths[leaves[0]][at]])
                    at += 1
                steps.append((len(steps) + 1, form, run))
                todo.append((len(steps), at, leaves))
        return steps, forms


def apply_laws(rows: DataFrame, system: System, form: str = "form") -> DataFrame:
    """rows for each leaf, with the columns leaf and hypothesis. A node's form is made once for all leaves below it (System.steps): as a column of its own, which the optimizer leaves alone where several are made from it."""
    steps, forms = system.steps()
    clash = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in rows.columns), default=0))
    name = lambda k: f"{clash}form{k}"
    level = {0: 0}
    for k, before, _ in steps:
        level[k] = level[before] + 1
    out = rows.withColumn(name(0), F.col(form))
    for depth in range(1, max(level.values()) + 1):
        out = out.withColumns({name(k): functools.reduce(lambda c, law: law.apply(c), laws, F.col(name(before))) for k, before, laws in steps if level[k] == depth})
    made = F.array(*[F.struct(F.lit(leaf).alias("leaf"), F.col(name(k)).alias("hypothesis")) for leaf, k in forms.items()])
    return out.withColumn(f"{clash}x", F.explode(made)).select(*rows.columns, f"{clash}x.leaf", f"{clash}x.hypothesis")


def evaluate(protos: DataFrame, reflexes: DataFrame, system: System) -> DataFrame:
    """(skey, leaf, proto, hypothesis, form, correct) of protos (skey, form) and reflexes (skey, lang, form) whose language is a leaf. Blank ancestor forms and forms don't count."""
    made = apply_laws(protos.where("form <> ''").select("skey", F.col("form").alias("proto")), system, "proto")
    known = reflexes.where("form <> ''").select("skey", F.col("lang").alias("leaf"), "form")
    joined = made.join(known, ["skey", "leaf"]).withColumn("hypothesis", F.coalesce("hypothesis", F.lit(MISSING)))
    return joined.select("skey", "leaf", "proto", "hypothesis", "form", (F.col("hypothesis") == F.col("form")).alias("correct"))


def metrics(detail: DataFrame, system: System, **costs: float) -> DataFrame:
    """One row: n_sets, n_comparisons, n_errors, accuracy, penalty, score."""
    errors = F.count(F.when(~F.col("correct"), 1))
    found = detail.agg(F.countDistinct("skey").alias("n_sets"), F.count("*").alias("n_comparisons"), errors.alias("n_errors"))
    accuracy = F.when(F.col("n_comparisons") > 0, 1 - F.col("n_errors") / F.col("n_comparisons")).otherwise(F.lit(0.0))
    penalty = F.lit(system.penalty(**costs))
    return found.select("*", accuracy.alias("accuracy"), penalty.alias("penalty"), (F.col("n_errors") + penalty).alias("score"))


def with_errors(detail: DataFrame) -> DataFrame:
    """Sets with one error or more."""
    return detail.join(detail.where("not correct").select("skey").distinct(), "skey", "left_semi")


def colored_diff(expected: str, found: str, color: bool = True) -> str:
    """found with its differences from expected coloured for a terminal, or in brackets."""
    import difflib

    marks = {"replace": 33, "delete": 31, "insert": 32}
    parts = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, expected, found).get_opcodes():
        piece = expected[a:b] if tag == "delete" else found[c:d]
        if tag != "equal":
            piece = f"\033[{marks[tag]}m{piece}\033[0m" if color else f"[{piece}]"
        parts.append(piece)
    return "".join(parts)


def set_report(rows: list, color: bool = True) -> str:
    """One set's results (rows of evaluate), right ones first, each wrong one with what differs."""
    head = f"*{rows[0]['proto']} ({rows[0]['skey']})"
    lines = [f"  right {r['leaf']:8} {r['hypothesis']:10} is {r['form']}" for r in rows if r["correct"]]
    for r in rows:
        if not r["correct"]:
            lines.append(f"  wrong {r['leaf']:8} {r['hypothesis']:10} is {r['form']}  {colored_diff(r['form'], r['hypothesis'], color)}")
    return "\n".join([head, *lines])


def metrics_report(m, name: str) -> str:
    return f"{name}: {m['n_errors']} errors in {m['n_comparisons']} comparisons of {m['n_sets']} sets, accuracy {m['accuracy']:.4f}, penalty {m['penalty']:.1f}, score {m['score']:.1f}"


def report_parts(detail: DataFrame, system: System, errors_only: bool = False, color: bool = True, limit: int | None = None, **costs: float) -> Iterator[str]:
    """The text of every set with its results, or of those with errors only, by set, and then the metrics. The driver holds one set after the other. limit: so many sets, and then how many there are more."""
    shown = with_errors(detail) if errors_only else detail
    rows = shown.orderBy("skey", "leaf").toLocalIterator()
    sets = itertools.groupby(rows, key=lambda r: r["skey"])
    for _, held in itertools.islice(sets, limit):
        yield set_report(list(held), color)
    if limit is not None and (more := shown.select("skey").distinct().count() - limit) > 0:
        yield f"{more} more sets"
    yield metrics_report(metrics(detail, system, **costs).first(), system.name)


def report(detail: DataFrame, system: System, errors_only: bool = False, color: bool = True, limit: int | None = None, **costs: float) -> str:
    """report_parts as one text."""
    return "\n\n".join(report_parts(detail, system, errors_only, color, limit, **costs))


def resolve_proto(lexicon: Lexicon, langid: int | None = None, glottocode: str | None = None) -> int:
    """The ancestor language, by its number or else its code."""
    if langid is not None:
        return langid
    if glottocode is None:
        raise ValueError("the ancestor language's number or code is needed")
    found = None
    if "glottocode" in lexicon.languages.columns and glottocode not in ("", "unk"):
        found = lexicon.languages.where(F.col("glottocode") == glottocode).agg(F.max("langid")).first()[0]
    if found is None:
        raise ValueError(f"no language has the code {glottocode}")
    return found


def lexicon_detail(lexicon: Lexicon, system: System, plangid: int) -> DataFrame:
    """evaluate on the forms of one ancestor language and the forms below them; a leaf is a language's code, its name, or lang_ and its number. Of several forms of a language in a set the one with the largest id counts."""
    protos = lexicon.reflexes.where(F.col("langid") == plangid).select(F.col("refid").alias("skey"), F.col("ipaform").alias("form"))
    coded = lexicon.languages if "glottocode" in lexicon.languages.columns else lexicon.languages.withColumn("glottocode", F.lit(None).cast("string"))
    forms = lexicon.reflexes.where("ipaform <> ''").join(language_identifiers(coded), "langid").select("refid", F.col("identifier").alias("lang"), "ipaform")
    edges = lexicon.edges.select("refid", F.col("prefid").alias("skey"), "morph_index").join(protos.select("skey"), "skey", "left_semi").join(forms, "refid")
    last = edges.groupBy("skey", "lang").agg(F.max(F.struct("refid", "ipaform", "morph_index")).alias("x"))
    return evaluate(protos, last.select("skey", "lang", morpheme(F.col("x.ipaform"), F.col("x.morph_index")).alias("form")), system)


@dataclass
class Report:
    """A system's results on a lexicon: detail (evaluate), and the row of metrics."""

    system: System
    detail: DataFrame
    costs: dict[str, float]

    @property
    def metrics(self):
        return metrics(self.detail, self.system, **self.costs).first()

    def text(self, errors_only: bool = False, color: bool = True, limit: int | None = None) -> str:
        return report(self.detail, self.system, errors_only, color, limit, **self.costs)


def evaluate_yaml(text: str, lexicon: Lexicon, proto_langid: int | None = None, proto_glottocode: str | None = None, laws_coeff: float = LAW_COST, refs_coeff: float = REFERENCE_COST) -> Report:
    """The system of a YAML text on a lexicon. An ancestor language has to be named, and to be known."""
    system = System.loads(text)
    return Report(system, lexicon_detail(lexicon, system, resolve_proto(lexicon, proto_langid, proto_glottocode)), {"law_cost": laws_coeff, "reference_cost": refs_coeff})


def evaluate_file(path: str, lexicon: Lexicon, **given) -> Report:
    return evaluate_yaml(Path(path).read_text(encoding="utf-8"), lexicon, **given)


def list_systems(folder: str) -> list[tuple[str, str]]:
    """(file, the system's name) of a folder, by file; of a file that can't be read, why."""
    out = []
    for path in sorted(Path(folder).glob("*.yaml")):
        try:
            out.append((str(path), System.loads(path.read_text(encoding="utf-8")).name))
        except (yaml.YAMLError, OSError, TypeError, KeyError) as e:
            out.append((str(path), f"(unreadable: {type(e).__name__})"))
    return out


def locate(given: str, folder: str) -> str:
    """The file of a system: a path, a system's name, or a file's name without .yaml, in that order."""
    if Path(given).is_file():
        return given
    for path, name in list_systems(folder):
        if name == given:
            return path
    if (path := Path(folder) / f"{given}.yaml").is_file():
        return str(path)
    raise LookupError(given)
