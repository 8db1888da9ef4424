import itertools
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import phonology
from lexweave.operators import align, correspond, edits, generalize, laws, search
from lexweave.operators import similarity as sim
from lexweave.operators import vector_index
from lexweave.plans.words import SYSTEM
from lexweave.sources import files


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *itertools.accumulate(range(len(b)), lambda left, j, row=row, x=x: min(left + 1, row[j + 1] + 1, row[j] + (x != b[j])), initial=i)][1:]
    return row[-1]


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
@settings(max_examples=200, deadline=None)
def test_alignment_cost_and_rows(a, b):
    pairs = align.align_pair(list(a), list(b), align.unit_cost, 1.0)
    assert "".join(x for x, _ in pairs) == a and "".join(y for _, y in pairs) == b
    assert sum(x != y for x, y in pairs) == levenshtein(a, b) == align.cost_table(list(a), list(b), align.unit_cost, 1.0)[-1][-1] == align.batch_costs([list(a)], [list(b)], align.unit_cost, 1.0)[0]


def aligned_rows(spark, rows, **given):
    """{skey: {lang: segments}} of align_sets."""
    out = {}
    for r in align.align_sets(spark.createDataFrame(rows, "skey string, lang string, form string"), **given).collect():
        out.setdefault(r["skey"], {}).setdefault(r["lang"], {})[r["col"]] = r["seg"]
    return {k: {lang: [cells[c] for c in range(len(cells))] for lang, cells in held.items()} for k, held in out.items()}


def star_by_hand(members, proto, cost=align.distance, gap=align.GAP):
    """{lang: segments} of one set, all at once."""
    named = sorted(set(members), key=lambda m: (m[0] is not None, m[0] or "", m[1]))
    if proto:
        named = [("proto", proto), *named]
        middle = list(proto)
    else:
        every = sorted(members, key=lambda m: (m[0] is not None, m[0] or "", m[1]))
        apart = lambda a, b: sum(map(cost, a, b)) + align.GAP * abs(len(a) - len(b))
        middle = list(min(every, key=lambda m: round(sum(apart(m[1], o[1]) for o in every), 6))[1])
    blocks = [align.placed(middle, list(f), cost, gap) for _, f in named]
    room = [max(len(added[p]) for _, added in blocks) for p in range(len(middle) + 1)]
    out = {}
    for (lang, _), (own, added) in zip(named, blocks, strict=True):
        out[lang] = [x for p in range(len(middle) + 1) for x in [*added[p], *[""] * (room[p] - len(added[p])), *own[p : p + 1]]]
    return {lang: cells for lang, cells in out.items() if cells}


def test_sets_in_rows_are_aligned_as_at_once(spark):
    """Random sets with and without an ancestor, several forms of a language, repeated rows, empty and null forms, null keys and languages."""
    rng = random.Random(8)
    rows, expected = [], {}
    for k in [*range(60), None]:
        members = [(rng.choice(["de", "en", "fr", None]), "".join(rng.choice("aitkps") for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(1, 7))]
        proto = "".join(rng.choice("aitk") for _ in range(rng.randint(1, 6))) if rng.random() < 0.6 else None
        skey = None if k is None else f"s{k}"
        rows += [(skey, lang, form or rng.choice(["", None])) for lang, form in members]
        rows += [(skey, "proto", proto), (skey, "proto", ""), (skey, "proto", proto)] if proto else []
        expected[skey] = star_by_hand(members, proto)
    got = aligned_rows(spark, rows)
    assert got == {k: v for k, v in expected.items() if v}
    assert aligned_rows(spark, []) == {}


def test_set_alignment(spark):
    got = aligned_rows(spark, [("s", "proto", "pata"), ("s", "b", "pata"), ("s", "c", "ata"), ("s", "c", "ta"), ("t", "a", "pa")])
    assert got["s"] == {"proto": list("pata"), "b": list("pata"), "c": ["", "", "t", "a"]}  # the last of two forms of one language
    assert got["t"] == {"a": ["p", "a"]}


def test_a_large_set_is_dealt_over_tasks(spark):
    """A set of 100,000 forms is in several tasks, where Spark doesn't join small ones of its own accord, and all rows have one length."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    letters = F.array(*map(F.lit, "aitkpsmn"))
    form = F.concat(*[F.get(letters, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)).cast("int")) for k in range(3)])
    rows = spark.range(100_000).select(F.lit("s").alias("skey"), F.concat(F.lit("l"), F.col("id")).alias("lang"), form.alias("form"))
    rows = rows.unionByName(spark.createDataFrame([("s", "proto", "tak")], "skey string, lang string, form string"))
    out = align.align_sets(rows).withColumn("task", F.spark_partition_id())
    seen = out.groupBy("lang").agg(F.count("*").alias("cells"), F.concat_ws("", F.array_sort(F.collect_list(F.struct("col", "seg")))["seg"]).alias("form"), F.first("task").alias("task"))
    try:
        cells, tasks, n = seen.agg(F.countDistinct("cells"), F.countDistinct("task"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (cells, n) == (1, 100_001) and tasks > 1
    assert seen.join(rows.select("lang", F.col("form").alias("given")), "lang").where("form <> given").count() == 0


def merged_at_once(groups):
    """The sets of exact groups [(pattern, count)] by all pairs."""
    held = correspond.Merging()
    for p, n in groups:
        held.add(p, n)
    blanks = lambda p: sum(not x for x in p)
    fits = lambda p, q: all(x is None or y is None or x == y for x, y in zip(p, q, strict=True))
    turns = sorted((-blanks(p), blanks(q), -m, i, j) for i, (p, n) in enumerate(groups) for j, (q, m) in enumerate(groups) if i != j and fits(p, q) and (blanks(q), -m) < (blanks(p), -n))
    for *_, i, j in turns:
        held.turn(i, j)
    return {p: (groups[held.root(k)][0], held.patterns[held.root(k)]) for k, (p, _) in enumerate(groups)}


def random_patterns(rng, n, sounds="ab"):
    found = {}
    for _ in range(n):
        p = (rng.choice(sounds), *(rng.choice([None, "", "x", "y"]) for _ in range(4)))
        found[p] = found.get(p, 0) + rng.randint(1, 3)
    return list(found.items())


def test_merging_from_the_index_is_the_same_as_at_once(spark):
    rng = random.Random(3)
    for n in (1, 4, 40, 400):
        groups = random_patterns(rng, n)
        df = spark.createDataFrame([(p[0], list(p), c, (f"{k:04d}", 0)) for k, (p, c) in enumerate(groups)], "proto_seg string, pattern array<string>, n long, first struct<skey: string, col: int>")
        got = {tuple(r["pattern"]): (tuple(r["root"]), tuple(r["merged"])) for r in correspond.merged_groups(df).collect()}
        # all sounds at once, and so in any order of sounds
        assert got == merged_at_once(groups)
    assert correspond.merged_groups(df.limit(0)).count() == 0


def test_partial_matches(spark):
    """What meets in the index is what is compatible, both ways, and nothing else; counts are those of the pairs."""
    groups = random_patterns(random.Random(5), 300, "abc")
    rows = [(p[0], "".join("?" if x is None else x or "-" for x in p[1:]), list(p)) for p, _ in groups]
    df = spark.createDataFrame(rows, "proto_seg string, name string, pattern array<string>")
    fits = lambda p, q: all(x is None or y is None or x == y for x, y in zip(p, q, strict=True))
    expected = {(s, a, b) for s, a, p in rows for t, b, q in rows if s == t and a != b and fits(p, q)}
    got = [tuple(r) for r in correspond.compatible_pairs(df, ["name"], ["name"]).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    counts = {(r["proto_seg"], r["name"]): (r["n"], r["first"], r["last"]) for r in correspond.compatible_counts(df, "name").collect()}
    each = {}
    for s, a, b in expected:
        each.setdefault((s, a), []).append(b)
    assert counts == {k: (len(v), min(v), max(v)) for k, v in each.items()}


def test_correspondence_sets(spark):
    rows = [("s1", 0, ["t", "t", None]), ("s2", 0, ["t", "t", "d"]), ("s3", 0, ["t", "d", "d"]), ("s4", 0, ["a", "", None]), ("s5", 0, ["a", "", ""]), ("s6", 0, ["t", "t", ""])]
    df = spark.createDataFrame(rows, "skey string, col int, pattern array<string>")
    sets = {tuple(r["pattern"]): r["n"] for r in correspond.correspondence_sets(df).collect()}
    assert sets == {("t", "t", "d"): 2, ("t", "d", "d"): 1, ("t", "t", ""): 1}
    one = spark.createDataFrame([("s", 0, ["a", None, ""])], df.schema)
    assert correspond.correspondence_sets(one).count() == 1


def test_three_values(spark):
    df = spark.createDataFrame([(["a", None, ""], ["a", "b", ""]), (["a", ""], ["a", "b"]), ([None], [""])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(correspond.compatible(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert df.select(correspond.merged(F.col("a"), F.col("b"))).first()[0] == ["a", "b", ""]


def test_minimal_features():
    assert generalize.minimal_features([None], ["a"]) == generalize.EDGE_SPEC
    assert generalize.minimal_features([None, "a"], ["b"]) == generalize.EDGE_SPEC
    assert generalize.minimal_features(["a", "e"], ["t", "k"]) == {"syl": 1}
    assert generalize.minimal_features(["a"], ["a"]) is None
    assert generalize.minimal_features([None], [None]) is None
    assert generalize.describe({"syl": 1}, generalize.EDGE_SPEC) == "after [+syl] and word-finally"
    assert generalize.describe(None, None) == "no distinguishing context"


def test_laws(spark):
    system = laws.System.loads(SYSTEM)
    words = ["thee", "atate", "onte", "saso", "ba", "", "$1\\"]
    df = spark.createDataFrame([(w,) for w in words], "form string")
    made = {(r["form"], r["leaf"]): r["hypothesis"] for r in laws.apply_laws(df, system).collect()}
    for leaf, path in system.leaves().items():
        for w in words:
            x = w
            for name in path:
                x = system.laws[name].apply_to(x) if name in system.laws else x
            assert made[w, leaf] == x
    assert system.undefined() == ["not-defined"] and system.penalty() == 0.5 * 8 + 2.5 * 10
    assert laws.System.loads("").leaves() == {"ROOT": []}
    with pytest.raises(ValueError):
        laws.System.loads("tree: {ROOT: [{child: a}], a: [{child: ROOT}]}").leaves()
    special = spark.createDataFrame([("ax",)], "form string").select(laws.Law("x", "$0\\").apply(F.col("form"))).first()[0]
    assert special == "a$0\\"
    assert "???" == laws.MISSING and "\033" in laws.colored_diff("abc", "abd")


def test_features_by_bits_are_those_of_the_search(spark):
    """Random contexts of many sounds, with edges and unknown segments, each two sets against the search over all choices."""
    rng = random.Random(21)
    kinds = ["a", "e", "i", "u", "p", "t", "k", "s", "m", "n", "tʰ", "aː", "?", "ц", None]
    rows, held = [], {}
    for sound in range(40):
        few = rng.sample(kinds, rng.randint(2, 9))
        for k in range(rng.randint(1, 5)):
            own = {(rng.choice(few), rng.choice(few)) for _ in range(rng.randint(1, 6))}
            held[f"p{sound}", f"s{k}"] = list(own)
            rows += [(f"s{k}", f"p{sound}", a, b) for a, b in own]
    df = spark.createDataFrame(rows + rows[:50], "set_id string, proto_seg string, left string, right string")
    told = lambda one, other: generalize.describe(*generalize.generalize(one, other))
    got = {(r["proto_seg"], r["a"], r["b"]): (r["a_context"], r["b_context"]) for r in generalize.pairwise(df).collect()}
    assert got == {(p, a, b): (told(x, y), told(y, x)) for (p, a), x in held.items() for (q, b), y in held.items() if p == q and a < b}
    found = {(r["proto_seg"], r["set_id"]): r for r in generalize.default_and_conditioned(df).collect()}
    assert found.keys() == held.keys()
    for p in {p for p, _ in held}:
        sets = {s: own for (q, s), own in held.items() if q == p}
        scores = {}
        for s, own in sets.items():
            others = [c for o, cs in sets.items() if o != s for c in cs]
            specs = generalize.generalize(own, others) if others else (None, None)
            scores[s] = sum(f != generalize.EDGE for spec in specs for f in spec or ()) - 0.1 * len(own)
        default = min(sorted(scores), key=lambda s: scores[s])
        for s in sets:
            r = found[p, s]
            assert (r["is_default"], r["score"]) == (s == default, pytest.approx(scores[s]))
            assert r["context"] == ("default" if s == default else told(sets[s], sets[default]))


def test_pairs_of_sets_are_dealt_over_tasks(spark, monkeypatch):
    """One sound with many sets: its pairs come from several tasks, each pair once, as the search over all choices has it."""
    monkeypatch.setattr(generalize, "BLOCK", 8)
    rng = random.Random(5)
    kinds = ["a", "e", "p", "t", "k", "s", "m", "?", None]
    held = {f"s{k:02}": list({(rng.choice(kinds), rng.choice(kinds)) for _ in range(rng.randint(1, 4))}) for k in range(40)}
    df = spark.createDataFrame([(s, "x", a, b) for s, own in held.items() for a, b in own], "set_id string, proto_seg string, left string, right string")
    told = lambda one, other: generalize.describe(*generalize.generalize(one, other))
    found = generalize.pairwise(df).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in found}) > 1
    got = {(r["a"], r["b"]): (r["a_context"], r["b_context"]) for r in found}
    assert len(got) == len(found) and got == {(a, b): (told(x, y), told(y, x)) for a, x in held.items() for b, y in held.items() if a < b}


def test_the_task_of_a_lexicon_vector_step_stays_bounded(spark, monkeypatch):
    """tfidf_rows are tfidf's weights in order, no gram's rows meet in one task, and rows and products come in pieces of bounded size."""
    monkeypatch.setattr(sim, "ENTRIES_DEALT", 40)
    monkeypatch.setattr(sim, "ENTRIES", 7)
    grams = spark.createDataFrame([(k, g) for k in range(60) for g in ["all", "all", f"g{k % 4}", f"g{k % 3}"]] + [(70, "seldom")], "id long, gram string")
    ids = spark.createDataFrame([(k,) for k in [*range(60), 70, 71, 71]], "id long")
    weights = defaultdict(dict)
    for r in sim.tfidf(grams, 4).collect():
        weights[r["id"]][r["gram"]] = r["weight"]
    names = sorted({g for w in weights.values() for g in w})
    rows = sim.tfidf_rows(grams, ids, 4)
    assert len(names) == 4 and rows.rdd.getNumPartitions() >= 181 // 40
    got = {r["id"]: (r["at"], r["w"]) for r in rows.collect()}
    assert rows.count() == len(got) == 62 and got[70] == got[71] == ([], [])
    for k, (at, w) in got.items():
        assert at == sorted(at) and dict(zip((names[j] for j in at), w, strict=True)) == pytest.approx(weights[k])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [gram" in plan and "hashpartitioning(gram" not in plan
    held = rows.toPandas()
    assert max(sum(map(len, x["at"])) for x in sim._pieces(held)) < 7 + 4 and sum(map(len, sim._pieces(held))) == 62


def test_a_tree_of_many_laws(spark):
    """100 laws over nested nodes and 24 leaves, one of them with several parents and laws that aren't defined: each law stands in one step, and results are those of each path by itself."""
    rng = random.Random(12)
    letters = "abcdefgh"
    known = {f"l{k}": [rng.choice(letters), rng.choice(letters + "x"), rng.choice(["", "", rng.choice(letters)]), rng.choice(["", "", rng.choice(letters), "\\Z"])] for k in range(100)}
    names = iter(known)
    tree = {"ROOT": [], "shared": [{"child": "deep", "laws": ["l3", "l1"]}]}
    for i in range(4):
        tree["ROOT"].append({"child": f"n{i}", "laws": [next(names) for _ in range(13)]})
        tree[f"n{i}"] = [{"child": f"m{i}{j}", "laws": [next(names) for _ in range(4)]} for j in range(3)] + [{"child": "shared", "laws": []}]
        for j in range(3):
            tree[f"m{i}{j}"] = [{"child": f"leaf{i}{j}{k}", "laws": ["l0", "missing", f"l{k}"]} for k in range(2)]
    system = laws.System.loads(yaml.safe_dump({"laws": known, "tree": tree}))
    steps, forms = system.steps()
    assert max(len(run) for *_, run in steps) <= laws.CHAIN and len(forms) == 25
    # the laws of each edge once: 100 of the tree's own, and two for each of 24 leaves and for the shared one
    assert sum(len(run) for *_, run in steps) <= 100 + 2 * 24 + 2
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None]
    df = spark.createDataFrame([(w, "kept") for w in words], "form string, _form0 string")
    made = laws.apply_laws(df, system)
    assert made.columns == ["form", "_form0", "leaf", "hypothesis"]
    got = {(r["form"], r["leaf"]): r["hypothesis"] for r in made.collect()}
    for leaf, path in system.leaves().items():
        for w in words:
            x = w
            for name in path:
                x = system.laws[name].apply_to(x) if name in system.laws and x is not None else x
            assert got[w, leaf] == x
    # the plan names each law as often as it has steps, not as it has leaves
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 100 + 2 * 24 + 2


def test_reports_are_whole(spark):
    system = laws.System.loads(SYSTEM)
    protos = spark.createDataFrame([(f"k{k:03d}", "tota") for k in range(130)], "skey string, form string")
    known = protos.select("skey", F.lit("de").alias("lang"), F.lit("nope").alias("form"))
    detail = laws.evaluate(protos, known, system)
    parts = list(laws.report_parts(detail, system))
    assert len(parts) == 131 and "(k129)" in parts[129] and "130 errors" in parts[130]
    assert [p for p in laws.report_parts(detail, system, limit=2)][2] == "128 more sets"
    assert laws.report(detail, system, errors_only=True).count("wrong") == 130


def test_distances_are_joined(spark):
    segs = ["a", "p", "v", "w", "tʰ", "t͡s", "?", "g", "aː", None]
    df = spark.createDataFrame([(x, y, 1) for x in segs for y in segs], "a string, b string, _a int")
    got = {(r["a"], r["b"]): r["cost"] for r in phonology.with_distance(df.drop("_a")).collect()}
    for (x, y), cost in got.items():
        assert cost == pytest.approx(phonology.distance(x, y) if x and y else phonology.UNKNOWN_COST)
    assert len(got) == len(segs) ** 2


def test_law_report(spark, tmp_path):
    system = laws.System.loads(SYSTEM)
    protos = spark.createDataFrame([("k", "tota"), ("l", "tota"), ("m", None), ("n", "")], "skey string, form string")
    known = spark.createDataFrame([("k", "de", "toda"), ("k", "fr", "nope"), ("k", "xx", "tota"), ("l", "de", "toda")], "skey string, lang string, form string")
    detail = laws.evaluate(protos, known, system)
    assert {(r["skey"], r["leaf"], r["correct"]) for r in detail.collect()} == {("k", "de", True), ("k", "fr", False), ("l", "de", True)}
    m = laws.metrics(detail, system).first()
    assert (m["n_sets"], m["n_comparisons"], m["n_errors"]) == (2, 3, 1) and abs(m["accuracy"] - 2 / 3) < 1e-9
    assert laws.metrics(detail.limit(0), system).first()["accuracy"] == 0.0
    text = laws.report(detail, system)
    assert "nope" in text and text.index("*tota (k)") < text.index("*tota (l)") < text.index("1 errors in 3 comparisons of 2 sets")
    assert text.index("right de") < text.index("wrong fr") and "\033[" in text
    short = laws.report(detail, system, errors_only=True, color=False, law_cost=1.0)
    assert "(l)" not in short and "\033[" not in short and "[" in short and f"penalty {8 + 25:.1f}" in short
    (tmp_path / "a.yaml").write_text(SYSTEM)
    (tmp_path / "b.yaml").write_text("{")
    (tmp_path / "c.yaml").write_text("name: sample")
    (tmp_path / "d.yaml").write_text("name: other")
    assert [n for _, n in laws.list_systems(str(tmp_path))][0] == "sample" and "unreadable" in laws.list_systems(str(tmp_path))[1][1]
    assert laws.locate("sample", str(tmp_path)).endswith("a.yaml") and laws.locate("d", str(tmp_path)).endswith("d.yaml")
    assert laws.locate(str(tmp_path / "c.yaml"), "none").endswith("c.yaml")
    with pytest.raises(LookupError):
        laws.locate("none", str(tmp_path))


def test_differences_are_marked():
    assert laws.colored_diff("abcd", "axcde", False) == "a[x]c" + "[de]" or laws.colored_diff("abcd", "axcde", False) == "a[x]cd[e]"
    assert laws.colored_diff("same", "same", False) == "same" and laws.colored_diff("abc", "ac", False) == "a[b]c"
    assert laws.colored_diff("a", "b") == "\033[33mb\033[0m" and laws.colored_diff("a", "ab") == "a\033[32mb\033[0m"


@pytest.fixture
def lexicon(spark):
    from lexweave.sources.tables import Lexicon

    reflexes = [(1, 20, "tota", "water", "tota"), (2, 20, "pa", "Ash", None), (3, 20, "", "none", ""), (10, 1, "toda x", "w", "toda x"), (11, 1, "ze-toda", "w", "ze-toda"), (12, 2, "nope", "w", "nope"), (13, 3, "ba", "a", ""), (14, 4, "zz", "z", "zz")]
    languages = [(1, "German", "de"), (2, "fr", "unk"), (3, None, None), (4, "far", ""), (20, "Proto", "prot1")]
    return Lexicon(
        spark.createDataFrame(reflexes, "refid long, langid long, form string, gloss string, ipaform string"),
        spark.createDataFrame(languages, "langid long, name string, glottocode string"),
        spark.createDataFrame([(1, 20), (2, 20), (3, 20), (5, 20)], "langid long, plangid long"),
        spark.createDataFrame([(10, 1, 20, 0), (11, 1, 20, 1), (12, 1, 20, 0), (13, 2, 20, 0), (14, 1, 20, 0)], "refid long, prefid long, plangid long, morph_index int"),
    )


def test_systems_on_a_lexicon(spark, lexicon, tmp_path):
    found = laws.evaluate_yaml(SYSTEM, lexicon, proto_glottocode="prot1", laws_coeff=0.0, refs_coeff=1.0)
    # of two German forms the one with the larger id counts, by its second part
    assert {(r["skey"], r["leaf"], r["form"], r["correct"]) for r in found.detail.collect()} == {(1, "de", "toda", True), (1, "fr", "nope", False)}
    assert (found.metrics["n_errors"], found.metrics["penalty"]) == (1, 10.0) and "nope" in found.text()
    (tmp_path / "s.yaml").write_text(SYSTEM)
    assert laws.evaluate_file(str(tmp_path / "s.yaml"), lexicon, proto_langid=20).metrics["n_comparisons"] == 2
    with pytest.raises(ValueError):
        laws.evaluate_yaml(SYSTEM, lexicon)
    for code in ("nowhere", "unk", ""):
        with pytest.raises(ValueError):
            laws.evaluate_yaml(SYSTEM, lexicon, proto_glottocode=code)
    from lexweave import cli

    for name in ("reflexes", "languages", "ancestry", "edges"):
        getattr(lexicon, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = cli.main(["s", "--folder", str(tmp_path), "--lexicon", str(tmp_path), "--proto-glottocode", "prot1", "--errors-only", "--no-color", "--laws-coeff", "0"])
    assert "1 errors in 2 comparisons" in out and "\033[" not in out and "penalty 25.0" in out
    for bad in (["none", "--folder", str(tmp_path), "--lexicon", str(tmp_path)], ["s", "--folder", str(tmp_path), "--lexicon", str(tmp_path)], ["s"], []):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_sets_of_a_lexicon(lexicon):
    from lexweave.sources.tables import lexicon_sets

    got = {tuple(r) for r in lexicon_sets(lexicon, 20).collect()}
    # forms of languages that aren't below 20, or have no entry, take no part; a missing transcription falls back on the spelling
    assert got == {("1", "proto", "tota", "water"), ("1", "German", "toda", "water"), ("1", "fr", "nope", "water"), ("2", "proto", "", "Ash"), ("2", None, "ba", "Ash")}
    some = {tuple(r)[:2] for r in lexicon_sets(lexicon, 20, ["fr"]).collect()}
    assert some == {("1", "proto"), ("1", "fr")}


def test_columns_go_by_gloss(spark):
    rows = [("s1", 0, ["t", "t"], "beta"), ("s2", 0, ["t", "t"], "Alpha"), ("s3", 0, ["t", "t"], None), ("s4", 0, ["t", "d"], "x")]
    df = spark.createDataFrame(rows, "skey string, col int, pattern array<string>, gloss string")
    sets = correspond.ordered(correspond.correspondence_sets(df)).collect()
    assert [s["n"] for s in sets] == [3, 1] and [c["skey"] for c in sets[0]["columns"]] == ["s3", "s2", "s1"]
    held = correspond.phonemes_worth_analysing(correspond.correspondence_sets(df)).collect()
    assert [tuple(r) for r in held] == [("t", 2)]


def test_patterns_as_readers_see_them(spark):
    rows = [("s1", 0, ["a", "z", None], 10), ("s2", 0, ["a", "Ä", "x"], 9), ("s3", 0, ["a", "a", ""], 100), ("s4", 0, ["a", "", "y"], 1)]
    df = spark.createDataFrame(rows, "skey string, col int, pattern array<string>, n int")
    view = lambda terms, *sort: [r["skey"] for r in correspond.pattern_view(df, ["p", "b", "c"], terms, *sort).collect()]
    assert view({}, "count") == ["s4", "s2", "s1", "s3"] and view({}, "count", True) == ["s3", "s1", "s2", "s4"]
    assert view({}, "b") == ["s4", "s3", "s2", "s1"]  # those without first, Ä beside a
    assert view({"count": "^1"}, "count") == ["s4", "s1", "s3"] and set(view({"c": "^-$"})) == {"s1", "s3"} and len(view({"b": "("})) == 4 and view({"b": "^ä"}) == []
    segs = df.select("skey", correspond.by_language(F.col("pattern"), ["p", "b", "c"]).alias("m")).collect()
    assert {r["skey"]: r["m"] for r in segs}["s1"] == {"p": "a", "b": "z"} and {r["skey"]: r["m"] for r in segs}["s4"] == {"p": "a", "c": "y"}


def test_pattern_functions(spark):
    df = spark.createDataFrame([(["a", None, "", "b"], ["a", "x", "", "b"]), (["a", None, "", None], ["a", "x", "", "b"]), (["a", "y", "q", "b"], ["a", "x", "q", "b"])], "a array<string>, b array<string>")
    got = df.select(correspond.sort_key(F.col("a")).alias("k"), correspond.filled(F.col("a")).alias("f"), correspond.is_instance(F.col("a"), F.col("b")).alias("i"), correspond.merged(F.col("a"), F.col("b")).alias("m")).collect()
    assert got[0]["k"] == ["a", "￿", "", "b"] and [r["f"] for r in got] == [2, 1, 4]
    assert [r["i"] for r in got] == [True, False, False] and got[1]["m"] == ["a", "x", "", "b"]


def test_room_for_the_longest_insertion(spark):
    rows = aligned_rows(spark, [("s", "proto", "ta"), ("s", "a", "taxa"), ("s", "b", "tya")], cost=align.unit_cost, gap=0.4)["s"]
    assert len({len(r) for r in rows.values()}) == 1
    middle = [k for k, x in enumerate(rows["proto"]) if x]
    for lang, form in [("proto", "ta"), ("a", "taxa"), ("b", "tya")]:
        assert "".join(rows[lang]) == form
        for a, b in itertools.pairwise([-1, *middle, len(rows[lang])]):
            gap = rows[lang][a + 1 : b]
            assert gap == sorted(gap, key=lambda x: x == "")  # what is inserted starts at the left


def test_central_form(spark):
    apart = lambda a, b: sum(map(align.distance, a, b)) + align.GAP * abs(len(a) - len(b))
    rng = random.Random(4)
    rows, expected = [], {}
    for k in range(100):
        forms = [("abcdefgh"[i], "".join(rng.choice("aitkpsʔB") for _ in range(rng.randint(0, 5)))) for i in range(rng.randint(1, 8))]
        totals = [round(sum(apart(a, b) for _, b in forms), 6) for _, a in forms]
        expected[f"s{k}"] = forms[totals.index(min(totals))]
        rows += [(f"s{k}", lang, form) for lang, form in forms]
    got = align.centers(spark.createDataFrame(rows, "skey string, lang string, form string")).collect()
    assert {r["skey"]: (r["lang"], r["form"]) for r in got} == expected


@given(st.lists(st.tuples(st.lists(st.sampled_from("aitkv?"), max_size=6), st.lists(st.sampled_from("aitkw?"), max_size=6)), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_many_costs_at_once(pairs):
    got = align.batch_costs([a for a, _ in pairs], [b for _, b in pairs], align.distance, align.GAP)
    assert got.tolist() == pytest.approx([align.cost_table(a, b, align.distance, align.GAP)[-1][-1] for a, b in pairs])


def test_one_phoneme(spark):
    rows = [("a1", "t", None, "a"), ("a2", "t", "a", "i"), ("b1", "k", None, None)]
    found = generalize.default_and_conditioned(spark.createDataFrame(rows, "set_id string, proto_seg string, left string, right string"))
    t, k, z = (generalize.analyse_phoneme(found, x) for x in "tkz")
    assert t["num_sets"] == 2 and len(t["conditioned"]) == 1 and "message" not in t
    assert k["num_sets"] == 1 and k["default"] == "b1" and "default" in k["message"] and z["num_sets"] == 0 and "no " in z["message"]


@given(st.lists(st.sampled_from(["a", "i", "t", "k", "s", "m", "?", None]), max_size=4), st.lists(st.sampled_from(["a", "i", "t", "k", "s", "m", "?", None]), max_size=4))
@settings(max_examples=300, deadline=None)
def test_fewest_features(positive, negative):
    import plain

    assert generalize.minimal_features(positive, negative) == plain.minimal(positive, negative)


def test_search_conditions(spark):
    df = spark.createDataFrame([("Été",), ("a_b",), ("aXb",), (None,), ("a\\b",)], "v string")
    hits = lambda term: {r[0] for r in df.where(search.matches(F.col("v"), term)).collect()}
    assert hits("") == {"Été", "a_b", "aXb", "a\\b"}
    assert hits("a_b") == {"a_b", "aXb", "a\\b"}
    assert hits("été") == set() and hits("^été$") == {"Été"}
    assert hits("^(") == set() and hits("a\\b") == {"a\\b"} and hits("A%B") == {"a_b", "aXb", "a\\b"}
    assert search.ids_of("1, 2,-3,4") == [1, 4]


def test_page_bounds(spark):
    df = spark.range(5).select(F.col("id").alias("refid"))
    assert search.page(df, search.Search()).count() == 0
    assert search.page(df, search.Search(start=3, length=-1)).count() == 2
    assert [r[0] for r in search.page(df, search.Search(order="none", descending=True, length=2)).collect()] == [4, 3]


def test_not_in_with_nulls(spark):
    t = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    stays, gone = edits.delete_not_in(t, "x", spark.createDataFrame([(1,)], "k int"))
    assert gone.collect()[0][0] == 2 and stays.count() == 2
    assert edits.delete_not_in(t, "x", spark.createDataFrame([(1,), (None,)], "k int"))[1].count() == 0
    assert edits.delete_not_in(t, "x", spark.createDataFrame([], "k int"))[1].count() == 3


def upper(c):
    return F.upper(c)


def test_upload(spark, lexicon):
    reflexes = lexicon.reflexes.withColumn("sourceid", F.lit(-2).cast("long"))
    entries = spark.createDataFrame([("ga", "pha"), ("ba", "tha")], "gloss string, form string")
    r, l, a = edits.upload(reflexes, lexicon.languages, lexicon.ancestry, entries, "two", ["20", "x", "-3"], 100, upper)
    assert (r.count(), l.count(), a.count()) == (10, 6, 6)
    assert [tuple(x) for x in r.where("refid >= 100").orderBy("refid").select("refid", "langid", "sourceid", "form", "gloss", "ipaform").collect()] == [(100, 21, -1, "tha", "ba", "THA"), (101, 21, -1, "pha", "ga", "PHA")]
    r, l, a = edits.upload(reflexes, lexicon.languages, lexicon.ancestry, entries, "German", ["20"], 100, upper)
    assert (l.count(), a.count()) == (5, 4) and r.where("refid >= 100").first()["langid"] == 1
    assert edits.upload(reflexes.limit(0), lexicon.languages.limit(0), lexicon.ancestry, entries, "x", [], 0, upper)[0].count() == 2


def test_new_forms(spark, lexicon):
    new = spark.createDataFrame([(90, 1, "neu", "new")], "refid long, langid long, form string, gloss string")
    row = edits.add_reflex(lexicon.reflexes, new, upper).where("refid = 90").first()
    assert (row["ipaform"], row["gloss"]) == ("NEU", "new")
    ranking = spark.createDataFrame([(95, 20, "old", "o", 0.5), (1, 20, "tota", "water", 0.1)], "refid long, langid long, ipaform string, gloss string, sim double")
    r, p = edits.add_etymon(lexicon.reflexes, ranking, "x", "y", 20, 95, upper)
    assert tuple(r.where("refid = 95").select("langid", "ipaform").first()) == (20, "X") and {tuple(x) for x in p.select("refid", "ipaform", "sim").collect()} == {(95, "X", 0.0), (1, "tota", 0.1)}
    for bad in ((" ", "y", 20), ("x", "", 20), ("x", "y", 0)):
        with pytest.raises(ValueError):
            edits.add_etymon(lexicon.reflexes, ranking, *bad, 95, upper)
    r, p, e = edits.add_set(lexicon.reflexes, ranking, lexicon.edges, "x", "y", 20, 96, 12, 1, upper)
    assert p.count() == 3 and tuple(e.where("prefid = 96").select("refid", "plangid", "morph_index").first()) == (12, 20, 1) and e.count() == 6
    changed = edits.update_reflex({"reflexes": lexicon.reflexes, "ranking": ranking}, 1, "neu", "g", upper)
    assert tuple(changed["reflexes"].where("refid = 1").select("form", "gloss", "ipaform").first()) == ("neu", "g", "NEU")
    assert tuple(changed["ranking"].where("refid = 1").select("gloss", "ipaform", "sim").first()) == ("g", "NEU", 0.1) and changed["ranking"].where("ipaform = 'old'").count() == 1


def test_edges(spark, lexicon):
    new = spark.createDataFrame([(11, 2, 20), (11, 2, 20), (10, 1, 20), (77, 1, 20)], "refid long, prefid long, plangid long")
    got = edits.add_supporting(lexicon.edges, lexicon.reflexes.withColumn("ipaform", F.when(F.col("refid") == 2, "toda").otherwise(F.col("ipaform"))), new)
    assert {tuple(r) for r in got.select("refid", "prefid", "morph_index").collect()} == {(10, 1, 0), (11, 1, 1), (12, 1, 0), (13, 2, 0), (14, 1, 0), (11, 2, 1), (77, 1, 0)}
    assert edits.add_all_pairs(lexicon.edges, lexicon.reflexes, [10, 12], [1, 2], 20).count() == 7 and edits.add_all_pairs(lexicon.edges, lexicon.reflexes, [], [1], 20).count() == 5
    assert edits.remove_edges(lexicon.edges, new.select("refid", "prefid")).count() == 4
    assert edits.update_morph_index(lexicon.edges, 11, 1, 4).where("morph_index = 4").select("refid").collect()[0][0] == 11
    r, e = edits.delete_reflexes(lexicon.reflexes, lexicon.edges, spark.createDataFrame([(1,)], "refid long"), "prefid")
    assert (r.count(), e.count()) == (7, 1)
    r, e = edits.delete_reflexes(lexicon.reflexes, lexicon.edges, spark.createDataFrame([(10,)], "refid long"))
    assert (r.count(), e.count()) == (7, 4)


def test_clean_up(spark, lexicon):
    languages = lexicon.languages.where("langid <> 3")
    given = (lexicon.reflexes, languages, lexicon.ancestry.where("langid <> 3"), lexicon.edges, 20)
    edges, report = edits.clean_up(*given)
    assert edges.count() == 5 and {(r["refid"], r["name"]) for r in report.collect()} == {(14, "far")}
    edges, report = edits.clean_up(*given, dry_run=False)
    assert {r["refid"] for r in edges.collect()} == {10, 11, 12} and report.count() == 1  # a form without a named language goes too
    with_null = given[2].unionByName(spark.createDataFrame([(None, 20)], "langid long, plangid long"))
    assert edits.clean_up(lexicon.reflexes, languages, with_null, lexicon.edges, 20, dry_run=False)[0].count() == 5


def test_backfill(spark, lexicon):
    made, told = edits.backfill(lexicon.reflexes, upper)
    assert told["total"] == 8 and told["missing"] == 3 and told["remaining"] == 1 and ("tota", "TOTA") in told["samples"]
    assert {r["refid"]: r["ipaform"] for r in made.collect()}[3] == "" and made.where("ipaform is null").count() == 0
    done = lexicon.reflexes.where("ipaform <> ''")
    assert edits.backfill(done, upper) == (done, {"total": 5, "missing": 0, "remaining": 0, "samples": []})


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("\none\tpha, x\textra\n\ntwo\t\n\"three\tb\n".encode())
    (tmp_path / "b.csv").write_bytes("eins,été\n".encode("latin-1"))
    got = {(r["gloss"], r["form"]) for r in files.read_lexicon(spark, str(tmp_path)).collect()}
    assert got == {("one", "pha, x"), ('"three', "b"), ("eins", "été")}
    assert files.delimiter_of(["a,b"]) == "," and files.delimiter_of([]) == "\t" and files.delimiter_of(["x"] * 5 + ["a,b"]) == "\t"
    assert {r["form"] for r in files.read_lexicon(spark, str(tmp_path), ",").collect()} == {"x\textra", "été"}
    lines = spark.createDataFrame([("\n \n a\n\tb\nc\nd,\ne\nf,,,,",)], "t string").select(files.first_lines(F.col("t"))).first()[0]
    assert lines == " a\n\tb\nc\nd,\ne"


def test_large_files_are_read_by_several_tasks(spark, tmp_path):
    """Files of some megabytes in blocks of a quarter: one with a byte beyond UTF-8 in its last line, one without, one with commas after many blank lines and Windows line ends."""
    line = "gloss {0}\tfóo{0}\n"
    body = "".join(line.format(k) for k in range(60_000)).encode()
    (tmp_path / "utf.tsv").write_bytes(body)
    (tmp_path / "latin.tsv").write_bytes(body.decode().encode("latin-1")[:-1] + b"\xff\n")
    (tmp_path / "comma.csv").write_bytes(b"\r\n \r\n" * 100_000 + "a,b\r\nc,é\te\r\nd, \r\n".encode())
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, str(1 << 18))
        found = files.read_lexicon(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1)).withColumn("task", F.spark_partition_id())
        seen = {r["name"]: r for r in found.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("form").alias("forms"), F.max("form").alias("last"), F.collect_set(F.substring("form", 1, 3)).alias("heads")).collect()}
        assert (seen["utf.tsv"]["n"], seen["utf.tsv"]["forms"], seen["utf.tsv"]["heads"]) == (60_000, 60_000, ["fóo"])
        assert (seen["latin.tsv"]["n"], seen["latin.tsv"]["heads"]) == (60_000, ["fóo"])
        assert found.where("name = 'latin.tsv' and gloss = 'gloss 59999'").first()["form"].endswith("ÿ")
        assert {(r["gloss"], r["form"]) for r in found.where("name = 'comma.csv'").collect()} == {("a", "b"), ("c", "é\te")}
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_numbers_in_order(spark):
    rng = random.Random(17)
    rows = [(rng.choice("abcdef"), rng.choice(["x", "y", None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "gloss string, form string").repartition(7)
    got = sorted((r["number"], r["gloss"], r["form"]) for r in edits.numbered(df, "gloss", "form", first=40).collect())
    assert [n for n, *_ in got] == list(range(40, 540))
    assert [g for _, *g in got] == [list(x) for x in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or ""))]
    assert edits.numbered(df.limit(0), "gloss").count() == 0


def test_rankings_and_pages(spark, tmp_path):
    first, second = (spark.createDataFrame([(k, 0.5)], "refid long, sim double") for k in (1, 2))
    files.write_ranking(first, str(tmp_path / "r"))
    files.write_ranking(second, str(tmp_path / "r"))
    assert [r["refid"] for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [2]
    assert files.page_of(second, 7, 3, 4) == {"draw": 4, "recordsTotal": 7, "recordsFiltered": 3, "data": [{"refid": 2, "sim": 0.5}]}


def test_is_proto(lexicon):
    assert search.is_proto(lexicon, 1) and not search.is_proto(lexicon, 10) and not search.is_proto(lexicon, 999)
    assert {r["name"]: r["identifier"] for r in search.language_identifiers(lexicon.languages).collect()} == {"German": "de", "fr": "fr", None: "lang_3", "far": "far", "Proto": "prot1"}


def test_nearest_beyond_the_first_ten(spark):
    """Filters and penalties come before the nearest are chosen; ties after rounding go by id; all rows are ranked if asked."""
    rows = [(k, k % 4, [1.0, 0.001 * (k % 30)], [1.0, 0.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "refid long, langid long, p array<double>, s array<double>")
    ancestry = spark.createDataFrame([(0, 3), (1, 3)], "langid long, plangid long")
    asked = df.where("refid = 0")
    protos = [r["refid"] for r in sim.rank_protoforms(asked, df, ancestry, 5).orderBy("rank").collect()]
    assert protos == sorted((k for k in range(60) if k % 4 == 3), key=lambda k: (k % 30, k))[:5]
    related = [(r["refid"], round(r["dist"])) for r in sim.rank_related(asked, df, ancestry, None).orderBy("rank").collect()]
    assert len(related) == 45 and all(d == (0 if k % 4 == 1 else 1) for k, d in related) and [d for _, d in related] == sorted(d for _, d in related)
    assert {round(r["dist"]) for r in sim.rank_related(df.where("refid = 2"), df, ancestry, 3).collect()} == {1}  # a language without ancestors
    reflexes = sim.rank_reflexes(asked.withColumn("plangid", F.lit(3).cast("long")), df, ancestry, 20).collect()
    assert all(r["langid"] in (0, 1) for r in reflexes) and len(reflexes) == 20 and min(r["refid"] for r in reflexes) == 0
    assert {round(r["dist"]) for r in sim.rank_reflexes(asked.withColumn("plangid", F.lit(None).cast("long")), df, ancestry, 5).collect()} == {1}
    ties = spark.createDataFrame([(k, 9, [1.0, 1e-12 * k], [1.0, 0.0]) for k in range(40, 0, -1)], df.schema)
    assert [r["refid"] for r in sim.nearest(asked, ties, 7).orderBy("rank").collect()] == list(range(1, 8))


def test_sparse_components_are_the_dense_ones(spark):
    """Sparse rows, some empty and some equal, against the same rows made dense; up to sign where a weight is as large as another."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        at = sorted(rng.sample(range(60), rng.randint(0, 6)))
        rows.append((k, at, [rng.random() * (1 + 10 / (1 + j)) for j in at]))
    df = spark.createDataFrame(rows + [(k + 400, *rows[k][1:]) for k in range(5)], "id long, at array<int>, w array<double>")
    full = df.select(F.col("id").alias("refid"), F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.coalesce(F.try_element_at(F.map_from_arrays(F.col("at"), F.col("w")), j.cast("int")), F.lit(0.0))).alias("p"))
    dense = {r["refid"]: r["v"] for r in sim.whitened_pca(full, 6).collect()}
    got = {r["id"]: r["v"] for r in sim.whitened_sparse(df, 6, 60).collect()}
    assert got.keys() == dense.keys()
    for j in range(6):
        sign = 1 if sum(got[k][j] * dense[k][j] for k in got) > 0 else -1
        assert max(abs(sign * got[k][j] - dense[k][j]) for k in got) < 5e-3
    assert sim.whitened_sparse(df.limit(0), 6, 60).count() == 0
    assert {tuple(r["v"]) for r in sim.whitened_sparse(spark.createDataFrame([(1, [], []), (2, [], [])], df.schema), 6, 60).collect()} == {()}


def test_rows_of_weights(spark):
    weights = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.25), (2, "c", 1.0), (2, "d", 9.0)], "id long, gram string, weight double")
    got = {r["id"]: (r["at"], r["w"]) for r in sim.sparse_rows(weights, spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long"), 3).collect()}
    assert got == {1: ([0, 1], [0.25, 0.5]), 2: ([2], [1.0]), 3: ([], [])}


def clustered(rng, n, clusters, spread):
    """Vectors around random directions, some zero, some equal."""
    middles = [([rng.gauss(0, 1) for _ in range(6)], [rng.gauss(0, 1) for _ in range(4)]) for _ in range(clusters)]
    rows = []
    for k in range(n):
        p, s = rng.choice(middles)
        near = lambda v: [x + rng.gauss(0, spread) for x in v]
        rows.append((k, k % 5, *(([0.0] * 6, [0.0] * 4) if k % 97 == 5 else (p, s) if k % 13 == 0 else (near(p), near(s)))))
    return rows


@pytest.mark.parametrize("alpha, penalty", [(0.4, 0.0), (1.0, 0.0), (0.0, 0.7)])
def test_index_finds_what_comparing_all_finds(spark, tmp_path, monkeypatch, alpha, penalty):
    monkeypatch.setattr(vector_index, "CORPUS_BLOCK", 70)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 40)
    df = spark.createDataFrame(clustered(random.Random(2), 3000, 30, 0.05), "refid long, langid long, p array<double>, s array<double>")
    path = str(tmp_path / "index")
    vector_index.build(df, path, 60)
    index = vector_index.VectorIndex(spark, path)
    assert sum(index.centers.n) == 3000 and index.rows([0]).select("part").distinct().count() == 1
    asked = df.where("refid % 50 < 2").withColumn("kin", F.when(F.col("refid") % 2 == 0, F.array(F.lit(1).cast("long"))))
    read = []
    got = index.search(asked, 7, alpha, penalty=penalty, read=read).orderBy("q", "rank").collect()
    expected = sim.nearest(asked, df, 7, alpha, penalty=penalty).orderBy("q", "rank").collect()
    assert [(r["q"], r["refid"], r["langid"], r["rank"]) for r in got] == [(r["q"], r["refid"], r["langid"], r["rank"]) for r in expected]
    assert [r["dist"] for r in got] == pytest.approx([r["dist"] for r in expected], abs=1e-8)
    assert penalty or read[0] < 0.5 * read[1]  # most parts are never read


def test_index_of_odd_tables(spark, tmp_path):
    schema = "refid long, langid long, p array<double>, s array<double>"
    path = str(tmp_path / "index")
    vector_index.build(spark.createDataFrame([], schema), path)
    one = spark.createDataFrame([(1, 1, [1.0], [1.0])], schema)
    assert vector_index.VectorIndex(spark, path).search(one, 3).count() == 0
    # a language that fills the first parts, more neighbours than there are, all of them, and a table rewritten in place
    rows = [(k, 0 if k < 40 else 1, [1.0, 0.01 * k], [1.0, 0.0]) for k in range(50)]
    df = spark.createDataFrame(rows, schema)
    vector_index.build(df, path, 5)
    index = vector_index.VectorIndex(spark, path)
    asked = df.where("refid = 0")
    for k in (3, 10, 20, None):
        assert [tuple(r) for r in index.search(asked, k).orderBy("rank").collect()] == [tuple(r) for r in sim.nearest(asked, df, k).orderBy("rank").collect()]
    with pytest.raises(ValueError):
        index.search(asked, 3, penalty=-1.0)


def test_similarity_of_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sim, "QUERY_BLOCK", 3)
    monkeypatch.setattr(sim, "CORPUS_BLOCK", 4)
    left, right = (spark.range(n).select(F.col("id").alias("refid"), (F.col("id") * 2).alias("x")) for n in (8, 11))
    assert {tuple(r) for r in sim.with_all(left, right).collect()} == {(a, 2 * a, b, 2 * b) for a in range(8) for b in range(11)}


def test_index_of_tables_with_empty_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "MOST_GROUPS", 3)
    vector = lambda n: F.array(*[F.sin(F.col("id") * n + k) for k in range(3)])
    df = spark.range(0, 400, 1, 8).where("id < 60").select(F.col("id").alias("refid"), (F.col("id") % 3).alias("langid"), vector(1.3).alias("p"), vector(2.1).alias("s"))
    vector_index.build(df, str(tmp_path / "index"), 5)
    index = vector_index.VectorIndex(spark, str(tmp_path / "index"))
    assert len(index.centers.part) > 3 and len(set(index.group)) <= 3
    asked = df.where("refid < 9")
    assert sorted(map(tuple, index.search(asked, 4).collect())) == sorted(map(tuple, sim.nearest(asked, df, 4).collect()))


def test_cosines_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sim, "PAIR_QUERIES", 2)
    monkeypatch.setattr(sim, "CORPUS_BLOCK", 4)
    vectors = [[1.0, 0.0], [0.0, 0.0], None, [3.0, 4.0], [-1.0, -1.0], [1.0, 0.0], [0.5, 2.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "refid long, s array<double>")
    got = {(r["q"], r["refid"]): r["cosine"] for r in sim.cosines_with_all(df.where("refid % 2 = 0"), df).collect()}
    plain = df.alias("a").where("refid % 2 = 0").crossJoin(df.alias("b")).select("a.refid", "b.refid", sim.cosine(F.col("a.s"), F.col("b.s"))).collect()
    assert len(got) == len(plain) == 28 and all(abs(got[a, b] - x) < 1e-12 for a, b, x in plain)


def test_all_pairs_shuffle_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(sim, "PAIR_QUERIES", 2)
    monkeypatch.setattr(sim, "CORPUS_BLOCK", 4)
    monkeypatch.setattr(sim, "PAIR_CORPUS", 4, raising=False)
    df = spark.range(0, 60, 1, 2).select(F.col("id").alias("refid"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("s"))
    found = sim.cosines_with_all(df.where("refid % 5 = 0"), df)
    assert found.count() == found.distinct().count() == 12 * 60
    rows = found.toPandas()
    plan = found._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    written = 0
    leaves = plan.collectLeaves()
    for k in range(leaves.length()):
        written += leaves.apply(k).plan().metrics().apply("shuffleRecordsWritten").value()
    assert len(rows) == 12 * 60 and written == 12 + 60


def test_similarities_of_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sim, "PAIR_QUERIES", 3)
    monkeypatch.setattr(sim, "PAIR_CORPUS", 5)
    monkeypatch.setattr(sim, "PAIRS", 7)
    monkeypatch.setattr(sim, "HANDED", 2)
    monkeypatch.setattr(sim, "CELLS", 9)
    vectors = [[1.0, 0.0], [0.0, 0.0], None, [3.0, 4.0], [-1.0, -1.0], [1.0, 0.0], [0.5, 2.0], [-1e-8, 1.0]]
    forms = ["", "a", "abc", "tʰa", "𝄞a", None, "a" * 300, "ab"]
    df = spark.createDataFrame([(k, forms[k % 8], vectors[k // 2 % 8]) for k in range(16)], "refid long, form string, s array<double>")
    both = df.alias("a").where("refid % 3 = 0").crossJoin(df.alias("b"))
    plain = both.select("a.refid", "b.refid", F.round(sim.pair_similarity(F.col("a.s"), F.col("b.s"), F.levenshtein("a.form", "b.form")), 6))
    found = sim.similarities_with_all(df.where("refid % 3 = 0"), df)
    assert found.dtypes == [("q", "bigint"), ("refid", "bigint"), ("similarity", "double")]
    assert sorted(map(repr, map(tuple, found.replace(-0.0, 0.0).collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    assert sim.similarities_with_all(df.limit(0), df).count() == sim.similarities_with_all(df, df.limit(0)).count() == 0
    # the values of two blocks come in order, so that a file has equal ones together
    monkeypatch.setattr(sim, "PAIRS", 100)
    for part in sim.similarities_with_all(df.where("form is not null"), df.where("form is not null")).rdd.glom().collect():
        values = [r["similarity"] for r in part]
        assert values == sorted(values)
    # as SQL has it, a small negative value is a negative zero
    zero = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [-1e-8, 1.0])], "refid long, form string, s array<double>")
    assert str(sim.similarities_with_all(zero, zero).where("q = 1 and refid = 2").first()["similarity"]) == "-0.0"


def test_ngrams_are_made_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(sim, "TEXTS", 10)
    df = spark.range(200).select("id", F.concat(F.lit("Ab"), F.col("id").cast("string")).alias("text")).coalesce(1)
    for grams in (sim.char_ngrams(df, F.col("text")), sim.word_ngrams(df, F.col("text"))):
        assert grams.rdd.getNumPartitions() == 20
        assert grams.select("id").distinct().count() == 200
    assert {r["gram"] for r in sim.char_ngrams(df.where("id = 7"), F.col("text")).collect()} == {"a", "b", "7", "ab", "b7", "ab7"}


def test_blocks_are_compared_piece_by_piece():
    rng = np.random.default_rng(3)
    table = lambda n: pd.DataFrame({"refid": np.arange(n), "langid": rng.integers(0, 9, n), "p": list(rng.standard_normal((n, 4)).round(1)), "s": list(rng.standard_normal((n, 4)).round(1))})
    queries, corpus = table(1500).assign(kin=[np.array([1, 2]) if i % 2 else None for i in range(1500)]), table(4096)
    tracemalloc.start()
    got = sim.nearest_in_blocks(7, 0.4, True, 1.0)(queries, corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e7  # a matrix of all distances has 49 MB, and the sum is made of several
    d = 1 - (0.4 * sim._units(queries["p"]) @ sim._units(corpus["p"]).T + 0.6 * sim._units(queries["s"]) @ sim._units(corpus["s"]).T)
    d = np.round(d + ((corpus["langid"].to_numpy() > 2) | (corpus["langid"].to_numpy() == 0)) * (np.arange(1500) % 2)[:, None], sim.PLACES)
    for i, found in got.groupby("q"):
        at = np.flatnonzero(corpus["langid"] != queries["langid"][i])
        assert found["refid"].tolist() == at[np.lexsort((at, d[i][at]))][:7].tolist()
    assert len(got) == 1500 * 7


def test_vectors_are_updated(spark):
    rows = spark.createDataFrame([(k, k) for k in range(5)], "refid long, v long")
    got = sim.update_vectors(rows, spark.createDataFrame([(1, 10), (9, 90)], rows.schema), spark.createDataFrame([(2,), (9,)], "refid long"))
    assert {tuple(r) for r in got.collect()} == {(0, 0), (1, 10), (3, 3), (4, 4)}


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(sim.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert df.select(sim.unit(F.col("a"))).first()[0] == [0.0, 0.0]
    scores = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0)], "alpha double, mrr double")
    assert tuple(sim.best_alpha(scores).first()) == (0.5, 0.0)


def test_stream(spark, tmp_path):
    from lexweave.streaming.intake import append_to, lexicon_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("water\tthi\nbad\n")
    append_to(lexicon_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("water", "thi", "tʰi")]


def test_forms(spark):
    from lexweave.operators import forms

    df = spark.createDataFrame([("x", "ta-pha na"), ("y", " "), ("z", None)], "gloss string, form string")
    page, n = forms.preview(df)
    assert n == 3 and {r["gloss"]: r["processed"] for r in page.collect()} == {"x": "ta-pʰa na", "y": "", "z": ""}
    sets = spark.createDataFrame([("k", "proto", "a"), ("k", "b", "c"), ("m", "proto", "a")], "skey string, lang string, form string")
    assert forms.set_of(sets, "k").count() == 2 and forms.selected(sets, []).count() == 2 and forms.selected(sets, None).count() == 3
    for key in ("m", "none"):
        with pytest.raises(LookupError):
            forms.set_of(sets, key)


def test_vectors_are_kept(spark, tmp_path):
    from lexweave.sources import store

    rows = spark.createDataFrame([(1, 1, "pata", "water"), (2, 2, "pata", None), (3, 1, None, "")], "refid long, langid long, ipaform string, gloss string")
    vectors = store.build_vectors(rows, 16)
    store.save_vectors(vectors, str(tmp_path / "v"))
    found = {r["refid"]: r for r in store.load_vectors(spark, str(tmp_path / "v")).collect()}
    assert found[1]["p"] == found[2]["p"] and found[2]["s"] == found[3]["s"] and set(found[3]["p"]) == {0.0}
    rows.write.parquet(str(tmp_path / "w"))
    with pytest.raises(RuntimeError):
        store.load_vectors(spark, str(tmp_path / "w"))


def test_command_line(spark, tmp_path):
    from lexweave import cli

    (tmp_path / "a.yaml").write_text(SYSTEM)
    spark.createDataFrame([("k", "proto", "tota"), ("k", "de", "toda")], "skey string, lang string, form string").write.parquet(str(tmp_path / "sets"))
    assert cli.main(["--list", "--folder", str(tmp_path)]) == f"sample: {tmp_path}/a.yaml"
    assert "0 errors in 1 comparisons" in cli.main(["sample", "--folder", str(tmp_path), "--sets", str(tmp_path / "sets")])


def test_every_benchmark_word_is_looked_up(spark, sf_dir):
    import __spark_entry__ as entry
    from lexweave.sources.tables import read, word_lexicon, words_of

    asked = words_of(read(spark, sf_dir, "benchmark"), "item_id").select("form").distinct()
    wanted = word_lexicon(spark, sf_dir).join(asked, "form", "left_semi")
    found = entry.QUERIES["related_words"](spark, sf_dir)
    assert {r[0] for r in found.select("query").distinct().collect()} == {r[0] for r in wanted.select("form").distinct().collect()}
    assert wanted.where("lang <> 'es'").count() > 0


def test_a_side_without_weight_is_not_needed(spark):
    from lexweave.sources.store import build_vectors

    rows = spark.createDataFrame([(k, k % 3, w, None) for k, w in enumerate(["pata", "pate", "pota", "miso", "mise", ""])], "refid long, langid long, ipaform string, gloss string")
    both, sound = build_vectors(rows, 16), build_vectors(rows, 16, "p")
    assert sound.columns == ["refid", "langid", "p"]
    ranked = lambda v: sorted((r["q"], r["rank"], r["refid"], r["dist"]) for r in sim.nearest(v, v, 3, 1.0).collect())
    assert ranked(sound) == ranked(both)


def test_few_nearest_hold_all_ties():
    rng = np.random.default_rng(5)
    for n, k in ((3, 5), (64, 2), (700, 5), (20000, 10), (20000, 400)):
        for row in (rng.random(n), rng.integers(0, 4, n) / 4, np.where(rng.random(n) < 0.99, np.inf, rng.random(n))):
            assert set(np.flatnonzero(row <= np.sort(row)[min(k, n) - 1])) <= set(sim.few_nearest(row, k))
    assert len(sim.few_nearest(rng.random(20000), 10)) < 100


def test_turns_together_are_the_same_as_one_by_one():
    rng = random.Random(7)
    for n in (1, 40, 900):
        groups = random_patterns(rng, n, "a")
        one, many = correspond.Merging(), correspond.Merging()
        for p, count in groups:
            one.add(p, count)
            many.add(p, count)
        turns = [(rng.randrange(len(groups)), rng.randrange(len(groups))) for _ in range(4 * n)]
        for i, j in turns:
            one.turn(i, j)
        many.turns(*np.array(turns).T)
        assert (one.roots.tolist(), one.patterns, one.counts.tolist()) == (many.roots.tolist(), many.patterns, many.counts.tolist())


def test_morphemes_of_a_batch_are_aligned_together(monkeypatch):
    calls, whole = [], align.batch_costs
    monkeypatch.setattr(align, "batch_costs", lambda a, b, *rest: calls.append(len(a)) or whole(a, b, *rest))
    pairs = [(a, b) for a in ("ta", "pi", "", "?", "stra") for b in ("tapa", "i", "?")]
    together = align.feature_errors(pairs)
    assert calls == [6] and together == [align.feature_error(a, b) for a, b in pairs] and together[2] is None


def test_texts_are_read_once_for_cognate_sets(spark, sf_dir):
    from lexweave.sources.tables import cognate_sets

    assert not any("documents" in f for f in cognate_sets(spark, sf_dir).inputFiles())
