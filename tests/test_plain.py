"""Queries that SQL can't express, held against the plain implementations, over whole tables."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexweave.functions import phonology as ph
from lexweave.functions import text as tx
from lexweave.plans.comparative import LANGUAGES
from lexweave.sources.tables import cognate_sets, star_lexicon, word_lexicon


def rows(spark, sf_dir, name):
    return [r.asDict() for r in entry.QUERIES[name](spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def sets(spark, sf_dir):
    held = defaultdict(list)
    for r in cognate_sets(spark, sf_dir).collect():
        held[r["skey"]].append((r["lang"], r["form"]))
    return {k: (dict(m)["proto"], sorted(x for x in m if x[0] != "proto")) for k, m in held.items()}


@pytest.fixture(scope="module")
def aligned(sets):
    return {k: plain.star(proto, members) for k, (proto, members) in sets.items()}


@pytest.fixture(scope="module")
def merged(aligned):
    columns = []
    for skey in sorted(aligned):
        held = defaultdict(dict)
        for (c, lang), seg in aligned[skey].items():
            held[c][lang] = seg
        columns += [((skey, c), held[c]) for c in sorted(held)]
    return plain.merge(columns, LANGUAGES)


def test_star_alignment(spark, sf_dir, aligned):
    got = {(r["skey"], r["col"], r["lang"]): r["seg"] for r in rows(spark, sf_dir, "star_alignment")}
    assert got == {(k, c, lang): seg for k, cells in aligned.items() for (c, lang), seg in cells.items()}


def test_align_pair(spark, sf_dir, sets):
    got = {(r["skey"], r["lang"], r["form"]): r["aligned"] for r in rows(spark, sf_dir, "align_pair")}
    expected = {}
    for k, (proto, members) in sets.items():
        for lang, form in members:
            expected[k, lang, form] = " ".join(f"{x or '-'}:{y or '-'}" for x, y in plain.pair(plain.segments(proto), plain.segments(form)))
    assert got == expected


def test_correspondence_sets(spark, sf_dir, merged):
    got = rows(spark, sf_dir, "correspondence_sets")
    show = lambda p: "".join("?" if x is None else x for x in p)
    assert Counter((r["proto_seg"], r["pattern"], r["n"], r["n_filled"]) for r in got) == Counter((p[0], show(p), len(m), sum(1 for x in p if x)) for p, m in merged)
    assert [r["n"] for r in got] == sorted((r["n"] for r in got), reverse=True)


def test_sets_by_sound_and_language(spark, sf_dir, sets, merged):
    sounds = Counter(p[0] for p, _ in merged if p[0])
    order = sorted(merged, key=lambda x: (-len(x[1]), tuple("￿" if s is None else s for s in x[0])))
    first = {}
    for k, (p, _) in enumerate(order):
        first.setdefault(p[0], k)
    got = [(r["proto_seg"], r["n"]) for r in rows(spark, sf_dir, "phonemes_to_analyse")]
    assert got == sorted(((s, n) for s, n in sounds.items() if n >= 2), key=lambda x: (-x[1], first[x[0]]))
    expected = Counter(",".join(sorted({"proto"} | {lang for skey, _ in m for lang, _ in sets[skey][1]})) for _, m in merged)
    assert Counter(r["languages"] for r in rows(spark, sf_dir, "set_languages")) == expected


@pytest.fixture(scope="module")
def contexts(spark, sf_dir, sets, aligned, merged):
    """{sound: {set_id: contexts}}, set ids as the query names them, by what the sets hold."""
    out = defaultdict(dict)
    for pattern, members in merged:
        held = set()
        for skey, col in members:
            own = [(c, aligned[skey][c, "proto"]) for c in sorted({c for c, lang in aligned[skey] if lang == "proto"}) if aligned[skey][c, "proto"]]
            at = next((k for k, (c, _) in enumerate(own) if c == col), None)
            if at is not None:
                held.add((own[at - 1][1] if at else None, own[at + 1][1] if at + 1 < len(own) else None))
        if held:
            out[pattern[0]][pattern] = held
    return out


def test_default_and_conditioned(spark, sf_dir, contexts):
    got = defaultdict(list)
    for r in rows(spark, sf_dir, "default_and_conditioned"):
        got[r["proto_seg"]].append((r["score"], r["is_default"]))
    size = lambda s: sum(f != "#" for f in s or {})
    for sound, held in contexts.items():
        scores = []
        for p, own in held.items():
            others = [c for q, o in held.items() if q != p for c in o]
            specs = [plain.minimal({c[k] for c in own}, {c[k] for c in others}) for k in (0, 1)] if others else [None, None]
            scores.append(round(sum(map(size, specs)) - 0.1 * len(own), 6))
        assert sorted(s for s, _ in got[sound]) == sorted(scores)
        assert [s for s, d in got[sound] if d] == [min(scores)]
    assert got.keys() == contexts.keys()


def test_pairwise_generalization(spark, sf_dir, contexts):
    got = defaultdict(Counter)
    for r in rows(spark, sf_dir, "pairwise_generalization"):
        got[r["proto_seg"]][frozenset(Counter([r["a_context"], r["b_context"]]).items())] += 1
    memo = {}

    def told(one, other):
        sides = []
        for k in (0, 1):
            key = frozenset(c[k] for c in one), frozenset(c[k] for c in other)
            if key not in memo:
                memo[key] = plain.minimal(*key)
            sides.append(memo[key])
        return plain.words(*sides)

    for sound, held in contexts.items():
        expected = Counter(frozenset(Counter([told(a, b), told(b, a)]).items()) for a, b in itertools.combinations(held.values(), 2))
        assert got[sound] == expected


def test_words_in_normal_form_and_syllables(spark, sf_dir):
    words = {r["form"] for r in word_lexicon(spark, sf_dir).select("form").distinct().collect()}
    normal = {w: plain.normalized(w) for w in words}
    assert {r["form"]: r["made"] for r in rows(spark, sf_dir, "normalize_full")} == normal
    syllables = {w: "-".join(plain.syllabify(plain.segments(x))) for w, x in normal.items()}
    made = rows(spark, sf_dir, "syllabify")
    assert {r["form"]: r["made"] for r in made} == syllables
    assert {r["form"]: r["processed"] for r in rows(spark, sf_dir, "processed_forms")} == {w: plain.processed(w) for w in words}
    inventory = {(r["lang"], s) for r in made for s in syllables[r["form"]].split("-") if s}
    assert {(r["lang"], r["syllable"]) for r in rows(spark, sf_dir, "syllable_inventory")} == inventory


ODD = ["ḍa ṭha-ṣoo", "ṭá", "d͡zhya", "tshya-ky ay", "ngaa ngg", "ǘǜ", "yy y-y", "pʰh", "ñå", "ḷ̤a", "  x ", "-", "ts͡h", "aaaa", "ÿÿ", "h", "ʈhɖh", "ɡɣh", "kxhy", "цaʰ漢", "t͡ц", "ц͡ta", "ʰa", "aBc", "ɒʉ", "ßg", "ṩə", "x̌ː1"]


def test_odd_forms(spark):
    from lexweave.operators.forms import process_form

    df = spark.createDataFrame([(w,) for w in ODD], "w string").select("w", tx.normalized(F.col("w")).alias("n"), process_form(F.col("w"))["processed"].alias("p"), tx.segments(F.col("w")).alias("s"))
    for r in df.collect():
        assert (r["w"], r["n"]) == (r["w"], plain.normalized(r["w"]))
        assert (r["w"], r["p"]) == (r["w"], plain.processed(r["w"]))
        assert (r["w"], r["s"]) == (r["w"], plain.segments(r["w"]))


@pytest.mark.parametrize("classes, conflated", [(ph.COARSE, True), (ph.FINE, False)])
def test_syllables_of_all_shapes(classes, conflated):
    if conflated:
        for n in range(6):
            for parts in itertools.product("talsi", repeat=n):
                assert ph.syllables(list(parts), classes) == plain.syllabify(list(parts))
    else:
        fine = ph.syllables(list("stain"), classes)
        assert "".join(fine) == "stain" and classes[8] == 9 and classes[2] == 2
    assert ph.syllables(list("taia"), classes, onsetless=False) != [] and "".join(ph.syllables(list("taia"), classes, onsetless=False)) == "taia"


def test_parse_syllable_of_all_shapes():
    for n in range(1, 5):
        for parts in itertools.product("tais", repeat=n):
            onset, nucleus, coda = ph.parse_syllable(list(parts))
            level = [ph.sonority(p) for p in parts]
            assert onset + nucleus + coda == "".join(parts) and len(onset) == level.index(max(level)) and len(nucleus) == 1


def test_morphemes_by_features(spark, sf_dir, sets):
    got = {(r["skey"], r["lang"], r["form"]): r["morph_index"] for r in rows(spark, sf_dir, "best_morph_by_features")}
    for k in sorted(sets)[::7]:
        proto, members = sets[k]
        b = plain.segments(proto)
        for lang, form in members:
            parts = form.replace("e", "-").split("-")
            costs = []
            for i, part in enumerate(parts):
                a = plain.segments(part)
                if len(parts) > 1 and any(map(ph.features, a)) and any(map(ph.features, b)):
                    costs.append((sum(3.0 if not x or not y else ph.distance(x, y) for x, y in plain.pair(a, b)) / len(b), i))
            assert got[k, lang, form] == (min(costs)[1] if costs else 0)


def test_lexicon_correspondences(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    reflexes = {r["refid"]: r for r in lexicon.reflexes.collect()}
    below = {r["langid"] for r in lexicon.ancestry.where("plangid = 1001").collect()}
    name = {r["langid"]: r["name"] for r in lexicon.languages.collect()}
    held = defaultdict(list)
    for e in lexicon.edges.collect():
        if reflexes[e["prefid"]]["langid"] == 1001 and e["refid"] in reflexes and reflexes[e["refid"]]["langid"] in below:
            form = reflexes[e["refid"]]["ipaform"]
            parts = [x for x in re.split(r"[-\s]+", form) if x]
            held[str(e["prefid"])].append((name[reflexes[e["refid"]]["langid"]], parts[e["morph_index"]] if e["morph_index"] < len(parts) else form))
    columns = []
    for skey in sorted(held):
        cells = defaultdict(dict)
        for (c, lang), seg in plain.star(reflexes[int(skey)]["ipaform"], sorted(held[skey])).items():
            cells[c][lang] = seg
        columns += [((skey, c), cells[c]) for c in sorted(cells)]
    languages = ["proto", *sorted(name[x] for x in below)]
    expected = Counter()
    for p, members in plain.merge(columns, languages):
        glosses = sorted(reflexes[int(s)]["gloss"].lower() for s, _ in members)
        segs = [(x, s) for x, s in zip(languages, p, strict=True) if s]
        expected[p[0], len(members), tuple(segs), glosses[0], glosses[-1]] += 1
    got = Counter((r["proto_seg"], r["n"], tuple(zip(r["languages"], r["segments"], strict=True)), r["first_gloss"], r["last_gloss"]) for r in rows(spark, sf_dir, "lexicon_correspondences"))
    assert got == expected and len(got) > 5


def test_related_words(spark, sf_dir):
    from lexweave.sources.store import build_vectors
    from lexweave.sources.tables import read, words_of

    words = word_lexicon(spark, sf_dir)
    key, code = F.xxhash64("lang", "form"), F.expr("crc32(cast(lang as binary))")
    vectors = build_vectors(words.select(key.alias("refid"), code.alias("langid"), F.col("form").alias("ipaform"), F.col("form").alias("gloss")), 32).select("refid", "langid", "p").collect()
    named = {r[0]: (r["lang"], r["form"]) for r in words.select(key, "lang", "form").collect()}
    asked = {r["form"] for r in words_of(read(spark, sf_dir, "benchmark"), "item_id").select("form").distinct().collect()}
    m = np.array([r["p"] for r in vectors])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    ids, langs = np.array([r["refid"] for r in vectors]), np.array([r["langid"] for r in vectors])
    expected = []
    for k in range(len(ids)):
        if named[ids[k]][1] in asked:
            d = np.round(1 - m @ m[k], 9)
            d[langs == langs[k]] = 9
            best = np.lexsort((ids, d))[:5]
            expected += [(named[ids[k]][1], float(d[j])) for j in best]
    got = sorted((r["query"], r["dist"]) for r in rows(spark, sf_dir, "related_words"))
    expected.sort()
    assert [q for q, _ in got] == [q for q, _ in expected] and np.allclose([d for _, d in got], [d for _, d in expected], atol=2e-6)


def whitened(m, dims):
    centered = m - m.mean(0)
    _, s, turn = np.linalg.svd(centered, full_matrices=False)
    out = centered @ turn[:dims].T / (s[:dims] / np.sqrt(len(m)))
    signs = np.sign(turn[:dims][np.arange(dims), np.abs(turn[:dims]).argmax(1)])
    return out * signs, s


def test_whitened_components(spark, sf_dir):
    held = sorted((r["vec_id"], r["embedding"][:32]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    expected, _ = whitened(np.array([v for _, v in held], float), 8)
    got = np.array([r["v"] for r in sorted(rows(spark, sf_dir, "pca_whiten"), key=lambda r: r["refid"])])
    assert np.allclose(got, expected, atol=2e-3)


def test_lexicon_vectors(spark, sf_dir):
    reflexes = sorted((r["refid"], r["ipaform"], r["gloss"]) for r in star_lexicon(spark, sf_dir).reflexes.collect())
    got = {r["refid"]: r for r in rows(spark, sf_dir, "lexicon_vectors")}
    chars = lambda t: [x[k : k + n] for x in [" ".join(plain.segments(t)).lower()] for n in (1, 2, 3) for k in range(len(x) - n + 1)]
    pairs = lambda t: [*(w := re.findall(r"\w\w+", t.lower())), *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]
    for name, grams, column in (("p", chars, 1), ("s", pairs, 2)):
        weights = plain.tfidf({r[0]: r[column] for r in reflexes}, grams, 1024)
        places = sorted({g for w in weights.values() for g in w})
        m = np.array([[weights[r[0]].get(g, 0.0) for g in places] for r in reflexes])
        mine = np.array([got[r[0]][name] for r in reflexes])
        full, s = whitened(m, min(16, len(places)))
        assert mine.shape == (len(reflexes), 16)
        solid = [k for k in range(16) if s[k] > 1e-6 and (k == 0 or s[k - 1] - s[k] > 1e-6) and s[k] - s[k + 1] > 1e-6]
        assert np.allclose(np.abs(mine[:, solid]), np.abs(full[:, solid]), atol=5e-3)
