import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from oracle import check
from pyspark.sql import functions as F

from lexweave.llm import bpe, decontaminate, language, passages, quality_rules, queries, secrets, sharding, simhash, spelling, substring, templates, urls
from lexweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, h string, slot int, shard int, _id string, _h string, _key string, _target int, key string, part int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("abcdeinorst") for _ in range(RNG.randint(1, 7))) for _ in range(400)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = sentence(4000)
TEXTS = [None, "", "  \n\t ", "one", "one two", "###", "word " * 120, sentence(80), LONG, LONG, LONG.replace("a", "e", 1), "ünï çödé \u2028 漢字 😀 <|endoftext|>", sentence(60) + "\n" + LONG[:900], sentence(12), "x" * 5000]
TEXTS += [TEXTS[7] + " " + sentence(3), TEXTS[7].upper(), sentence(200) + " " + " ".join(LONG.split()[100:180])]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, a repeated row, a null id, and columns whose names clash with working names."""
    rows = [(i, t, "en", None, None, "a", "b", "c", 1, 2, "d", "e", "f", 3, "g", 4) for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, TEXTS[7], *[None] * 14)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(-50, 50), rng.randint(-50, 50)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(60)] + [(5, None), (7, 7), (200, 201), (200, 201)] + [(300, 300 + k) for k in range(1, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {}
    for a, b in links:
        if b is not None and a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(400):
        before = dict(least)
        for a, b in links:
            if b is not None and a != b:
                least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert got == least
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, docs, empty):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = held(docs)
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    ids = [min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in root]
    expected = sorted((repr(i), f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, ids, strict=True))
    got = sorted((repr(r[0]), r[1], r[2]) for r in simhash.near_duplicates(docs).collect())
    assert got == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_blocks_grow_with_the_number_of_fingerprints():
    assert [simhash.blocks_for(n, 3) for n in (0, 10**6, 10**8, 10**9, 10**10, 10**12)] == [6, 6, 6, 7, 9, 12]
    assert simhash.blocks_for(10, 0) == 1 and len(simhash.cell_masks(3, 8)) == 56


@pytest.mark.parametrize("blocks", [6, 9])
def test_cells_hold_all_links_and_hot_cells_are_parted(spark, monkeypatch, blocks):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    while len(fps) < 300:
        x = base
        for b in rng.integers(0, 64, 4):
            x ^= 1 << int(b)
        fps.add(x)
    bits = np.array(sorted(fps), np.uint64)
    assert (simhash.manhattan(simhash.embed(bits[:, None]), simhash.embed(bits[None, :])) <= np.bitwise_count(bits[:, None] ^ bits[None, :])).all()
    monkeypatch.setattr(simhash, "CELL", 16)
    links = simhash._links(simhash._cells(spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "fp long"), 3, blocks), 3)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    label = np.arange(len(bits))
    for _ in range(len(bits)):
        label = np.where(near, label[None, :], len(bits)).min(1)
    own = [roots.get(int(x), int(x)) for x in bits.view(np.int64)]
    assert len(set(zip(label.tolist(), own, strict=True))) == len(set(label.tolist())) == len(set(own))


def test_near_copies_go(spark, docs, empty):
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted(set(kept))
    assert {3, 4, 5, 6, 7, 8, 12, 13} <= set(kept) and not {9, 10, 15, 16} & set(kept)
    assert len({0, 1, 2} & set(kept)) == 1 and None not in kept
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_cells_of_long_fingerprints_do_not_depend_on_their_number():
    masks = simhash.fine_masks()
    assert masks.shape == (simhash.FINE_CELLS, simhash.LANES)
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, (400, simhash.LANES), dtype=np.uint64)
    met = {}
    for distance in (50, simhash.FINE_RADIUS):
        bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
        for row in bits:
            row[rng.choice(512, distance, replace=False)] ^= 1
        x, y = simhash.embed(fps), simhash.embed(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        met[distance] = np.mean(((x[:, None] & masks) == (y[:, None] & masks)).all(2).any(1))
    assert met[50] >= 0.99 and met[simhash.FINE_RADIUS] >= 0.92


@pytest.mark.parametrize("size", [16, 2048])
def test_each_member_of_a_cell_is_compared(spark, monkeypatch, size):
    # two near copies share one cell with many unrelated fingerprints
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, (90, simhash.LANES), dtype=np.uint64)
    fps[70] = fps[20] ^ np.array([0xFFFF] * 3 + [0] * 5, np.uint64)
    fps[71] = fps[70] ^ np.array([0] * 3 + [0xFFFF] * 3 + [0] * 2, np.uint64)
    monkeypatch.setattr(simhash, "CELL", size)
    monkeypatch.setattr(simhash, "fine_masks", lambda: np.zeros((simhash.FINE_CELLS, simhash.LANES), np.uint64))
    links = simhash._fine_links(spark.createDataFrame([(bytearray(x.tobytes()),) for x in fps], "fp binary"))
    names = simhash._names(fps).tolist()
    assert {frozenset(r) for r in links.collect()} == {frozenset((names[20], names[70])), frozenset((names[70], names[71]))}


@pytest.mark.parametrize("part", [3, 2048])
def test_near_copies_have_a_similarity_of_four_fifths(spark, monkeypatch, part):
    rng = random.Random(11)
    texts = []
    for _ in range(8):
        base = sentence(120, rng).split()
        texts.append(base)
        for k in (1, 2, 3, 4, 5, 6, 8):  # every change of a word takes up to five shingles
            copy = list(base)
            for x in rng.sample(range(len(copy)), k):
                copy[x] = f"changed{rng.random()}"
            texts.append(copy)
    texts += [texts[0] * 3, texts[0] + texts[1] + texts[0]]  # repeats change the counts, not the set
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)) for x in sets]
    monkeypatch.setattr(simhash, "PART", part)
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(rows).collect())
    assert kept == sorted(set(root)) and 8 < len(kept) < len(texts) - 8


def test_url_rules(spark, sf_dir):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "")]
    given = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/78?x", "http://example.com/en/6", "http://com/en/", "http://xcom/en/", "ftp://a.b.net#y://com/en/", "http://bad.org/a", "http://x.bad.org", "http://notbad.org", "http://a..com/en/\n?", "x://ExÄ.com/en/"]
    pages = spark.createDataFrame([(k, u, "rule") for k, u in enumerate(given)] + [(0, None, "host")], "page_id long, url string, host string")
    blocked = spark.createDataFrame([("bad.org",), (None,)], "key string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules, blocked).collect()}
    expected = set()
    for k, u in enumerate(given):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict = max(fit)[2] if fit else ("block" if host == "bad.org" or host.endswith(".bad.org") else "allow")
        expected.add((k, host, path, max(fit)[1] if fit else None, verdict))
    assert got == expected
    assert urls.judge_urls(pages.limit(0), rules, blocked).count() == 0
    assert urls.judge_urls(pages, [], blocked.limit(0)).where("verdict = 'block'").count() == 0
    check(spark, sf_dir, queries.QUERIES["op3_url_cascade"], queries.ORACLES["op3_url_cascade"])


def test_url_rules_are_the_contract_s(spark, tmp_path):
    given = {"http://a.org/es/1": ("org/es/", "block"), "http://a.net/de/1": ("net/de/", "allow"), "http://spam-farm.net/de/1": ("net/de/", "allow"), "http://m.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://com/en/": ("com/en/", "block"), "http://x.example.com/en/71": ("example.com/en/7", "allow"), "http://example.com/en/8": ("com/en/", "block"), "http://spam-farm.net/fr/1": (None, "block"), "http://a.net/fr/1": (None, "allow")}
    spark.createDataFrame(list(enumerate(given)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.QUERIES["op3_url_cascade"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(given.values()))


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.BloomCascade(keys.where("listed").select("key"), keys.select("key"))
    assert len(cascade.levels) > 2
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


@pytest.mark.parametrize("most", [100, 1000])
def test_long_lists_take_passes(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "PASS_KEYS", most)
    monkeypatch.setattr(urls, "BITS_PER_KEY", 3)
    rows = spark.range(1500).select("id", F.array(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit(None).cast("string"), F.concat(F.lit("m"), (F.col("id") % 40).cast("string"))).alias("keys"))
    listed = spark.createDataFrame([(f"k{k}",) for k in range(0, 1500, 3)] + [("m7",), (None,), ("elsewhere",)], "key string")
    got = {r["id"] for r in urls.with_listed(rows, "keys", listed, "flag").where("flag").collect()}
    assert got == {k for k in range(1500) if k % 3 == 0 or k % 40 == 7}


def test_hosts_are_listed_by_their_parts(spark):
    pages = spark.createDataFrame([("http://m.spam-farm.example.com/x",), ("http://farm.example.com",), ("http://x.my-ads.example.org",), ("http://spam.example.org",), (None,)], "url string")
    assert {r[0] for r in urls.hosts_with_parts(pages).collect()} == {"spam-farm.example.com", "my-ads.example.org"}


def test_quality_rules(spark, docs, empty):
    flagged = docs.withColumn("trusted", F.col("doc_id").isin(7, 8, 15))
    ratios = quality_rules.fit_ratios(flagged, "trusted")
    judged = quality_rules.with_quality(flagged, ratios)
    threshold = quality_rules.fit_threshold(judged, "trusted", most_lost=0.5)
    got = {r["doc_id"]: r for r in judged.select("doc_id", "_quality.*", quality_rules.is_kept(F.col("_quality"), threshold).alias("kept")).collect() if r["doc_id"] is not None}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(text):
        w = WORD.findall(text or "")
        h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
        pairs = [spark_hash(a, b) for a, b in zip(h, h[1:], strict=False)]
        return [x % quality_rules.BUCKETS for x in (*h, *pairs)]

    def spark_hash(a, b):
        # the hash of two longs one after the other, as XXH64 of eight bytes with the first's hash as seed
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
        return signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), first))

    fold = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42)) % quality_rules.FOLDS
    target, raw = [Counter() for _ in range(quality_rules.FOLDS)], [Counter() for _ in range(quality_rules.FOLDS)]
    for i, t in held(docs):
        for k in range(quality_rules.FOLDS):
            if k != fold(t):  # what a fold is judged by
                raw[k].update(grams(t))
                if i in (7, 8, 15):
                    target[k].update(grams(t))
    scores = {}
    for i, t in held(docs):
        k, g = fold(t), grams(t)
        share = sum(target[k].values()) / max(1, sum(raw[k].values()))
        total = sum(round(100 * np.log((target[k][x] + quality_rules.PRIOR) / (share * raw[k][x] + quality_rules.PRIOR))) for x in g)
        scores[i] = total / max(len(g), 1) / 100
    for i, t in held(docs):
        if i is None:
            continue
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert abs(scores[i] - q["score"]) < 1e-2
        assert q["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert q["kept"] == (not q["base_failed"] and q["score"] * 1000 >= threshold)
    # of three trusted scores (one of its rows is there twice) half may be turned away
    assert abs(threshold - 1000 * sorted([scores[7], scores[7], scores[8], scores[15]])[2]) < 10
    nothing = empty.withColumn("trusted", F.lit(True))
    nothing = quality_rules.with_quality(nothing, quality_rules.fit_ratios(nothing, "trusted"))
    assert nothing.count() == 0 and quality_rules.fit_threshold(nothing, "trusted") is None
    clash = docs.withColumn("_quality", F.lit(1))
    assert quality_rules.with_quality(clash, ratios, into="_q").count() == docs.count()
    with pytest.raises(ValueError):
        quality_rules.with_quality(clash, ratios)


def test_no_trusted_text_keeps_what_passes_the_rules(spark, docs):
    flagged = docs.withColumn("trusted", F.lit(None).cast("boolean"))
    ratios = quality_rules.fit_ratios(flagged, "trusted")
    assert len(ratios) == quality_rules.FOLDS and {x for t in ratios for x in t.split(",")} == {"0"}
    judged = quality_rules.with_quality(flagged, ratios)
    threshold = quality_rules.fit_threshold(judged, "trusted")
    assert threshold is None
    assert judged.where(quality_rules.is_kept(F.col("_quality"), threshold) == F.col("_quality.base_failed")).count() == 0


def test_low_quantile():
    assert quality_rules.low_quantile({}) is None
    counts = {-300: 1, -100: 3, 0: 996}
    assert quality_rules.low_quantile(counts, 0.0) == -300
    assert quality_rules.low_quantile(counts, 0.001) == -100
    assert quality_rules.low_quantile(counts, 0.004) == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_quality_rules_on_documents_outside_the_target(spark, scale):
    """Learnt from four fifths of the labels and judged on the others, of each language."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
    others = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flagged = quality_rules.with_trusted(docs, labels.where(~others), "trusted")
    judged = quality_rules.with_quality(flagged, quality_rules.fit_ratios(flagged, "trusted"))
    kept = quality_rules.is_kept(F.col("_quality"), quality_rules.fit_threshold(judged, "trusted"))
    judged = judged.withColumn("kept", kept).join(labels, "doc_id").where("toxic = 0 and not _quality.base_failed")
    good = judged.where(others & (F.col("quality") == 1)).select("lang", "kept").collect()
    assert len(good) > 10 and sum(not r["kept"] for r in good) <= 0.02 * len(good)
    junk = judged.where("quality = 0").select("kept").collect()
    assert sum(not r["kept"] for r in junk) >= 0.9 * len(junk)


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_every_trusted_text_counts(spark, monkeypatch, sent):
    monkeypatch.setattr(quality_rules, "MOST_SENT", sent)
    docs = spark.range(20_100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") == 5, 1).alias("toxic"))
    flagged = quality_rules.with_trusted(docs, labels.unionByName(labels), "trusted")
    assert flagged.count() == 20_100 and flagged.where("trusted").count() == 20_099


def test_decontamination(spark, docs, empty):
    words = LONG.split()
    items = [(1, " ".join(words[200:230])), (2, " ".join(words[200:230])), (3, sentence(3) + " zzz"), (4, "one two"), (5, None), (6, ""), (7, " ".join(words[500:540]) + " x"), (8, sentence(50))]
    bench = spark.createDataFrame([(i, t, "id") for i, t in items], "item_id long, text string, start string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_benchmark_passages(docs, bench).collect()}
    tokens = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    expected = {}
    for d, text in held(docs):
        w = tokens(text)
        for i, t in items:
            b = tokens(t)
            k = min(5, len(b))
            if not b:
                continue
            own = Counter(tuple(b[j : j + k]) for j in range(len(b) - k + 1))
            for s in range(len(w) - k + 1):
                a = Counter(tuple(w[j : j + k]) for j in range(s, min(s + len(b) - k + 1, len(w) - k + 1)))
                common = sum((a & own).values())
                sim = common / (a.total() + own.total() - common)
                if sim >= 0.8:
                    expected[d, i] = max(expected.get((d, i), 0), sim)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert decontaminate.find_benchmark_passages(empty, bench).count() == 0
    assert decontaminate.find_benchmark_passages(docs, bench.limit(0)).count() == 0


def test_blocks_guarantee_the_radius():
    """Whatever bits differ, up to the radius, some block is near; and the values listed for an item's blocks are all near ones."""
    rng = random.Random(2)
    edges = decontaminate.block_edges()
    assert len(edges) == decontaminate.BLOCKS and sum(hi - lo for _, lo, hi in edges) == 64 * decontaminate.LANES
    flips = decontaminate.RADIUS // decontaminate.BLOCKS
    for _ in range(2000):
        bits = rng.sample(range(64 * decontaminate.LANES), rng.randint(0, decontaminate.RADIUS))
        assert min(sum(64 * lane + lo <= b < 64 * lane + hi for b in bits) for lane, lo, hi in edges) <= flips


def test_fingerprints_meet_in_blocks(spark):
    rng = np.random.default_rng(3)
    items = rng.integers(-(1 << 63), (1 << 63) - 1, (40, 2))
    windows = []
    for k, d in enumerate([0, 5, 20, 31, 32, 33, 40, 64] * 5):
        fp = items[k].view(np.uint64).copy()
        for b in rng.choice(128, d, replace=False):
            fp[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        windows.append((k, d, *map(int, fp.view(np.int64))))
    w = spark.createDataFrame(windows, "k int, d int, fp0 long, fp1 long")
    w = w.select("*", F.explode(decontaminate.blocks([F.col("fp0"), F.col("fp1")])).alias("b")).select("k", "d", "fp0", "fp1", "b.*")
    i = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(items)], "item int, i0 long, i1 long")
    i = i.select("*", F.explode(decontaminate.blocks_near([F.col("i0"), F.col("i1")], 32)).alias("b")).select("item", "i0", "i1", "b.*")
    pairs = w.join(i, ["block", "value"])
    differences = [F.col("fp0").bitwiseXOR(F.col("i0")), F.col("fp1").bitwiseXOR(F.col("i1"))]
    found = pairs.withColumn("h", F.bit_count(differences[0]) + F.bit_count(differences[1])).where((F.col("block") == decontaminate.first_near_block(differences, 32)) & (F.col("h") <= 32)).collect()
    own = [(r["k"], r["d"]) for r in found if r["k"] == r["item"]]
    assert sorted(own) == sorted((k, d) for k, d, *_ in windows if d <= 32)
    # about a quarter of unrelated pairs meet at all
    assert pairs.where("k <> item").select("k", "item").distinct().count() <= 0.3 * 40 * 39


def test_recall_of_the_radius(spark):
    """Of windows with a similarity of 0.8 to 0.83 at least 99.5 in 100 lie in the radius."""
    rng = random.Random(7)
    rows = []
    for k in range(1500):
        n = rng.randint(11, 55)
        own = [rng.getrandbits(63) for _ in range(n)]
        other = [rng.getrandbits(63) if j < n // 9 else x for j, x in enumerate(own)]
        rows.append((k, own, other))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>").withColumn("similarity", decontaminate.weighted_similarity(F.col("a"), F.col("b"))).where("similarity between 0.8 and 0.83")
    pairs = zip(decontaminate.fingerprint(F.col("a")), decontaminate.fingerprint(F.col("b")), strict=True)
    h = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in pairs), F.lit(0))
    n, near = df.select(F.count("*"), F.sum((h <= decontaminate.RADIUS).cast("int"))).first()
    assert n > 400 and near >= 0.995 * n


@pytest.mark.parametrize("broadcast, region", [(500, 1024), (0, 64)])
def test_many_items_of_one_length(spark, monkeypatch, broadcast, region):
    """Ten thousand items of equal length, boilerplate that many share, and windows that start in any region."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ITEMS", broadcast)
    monkeypatch.setattr(decontaminate, "REGION", region)
    rng = random.Random(13)
    frame = sentence(12, rng)
    n = 10_000 if broadcast else 60
    items = [(k, frame + " " + " ".join(f"{rng.choice(VOCABULARY)}{rng.randint(0, 99)}" for _ in range(18))) for k in range(n)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = [rng.randrange(n) for _ in range(40)]
    docs = spark.createDataFrame([(k, sentence(rng.randint(0, 400), rng) + " " + items[p][1] + " " + sentence(rng.randint(0, 90), rng)) for k, p in enumerate(planted)] + [(1000 + k, (frame + " ") * 6 + sentence(40, rng)) for k in range(40)], "doc_id long, text string")
    got = decontaminate.find_benchmark_passages(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(enumerate(planted)) and all(r["similarity"] == 1.0 and r["hamming"] == 0 for r in got)


def test_several_passes(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(LONG.split()[100 * k : 100 * k + 30])) for k in range(12)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_benchmark_passages(docs.where("doc_id < 12"), bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_SHINGLES", 100)
    assert sorted(map(tuple, decontaminate.find_benchmark_passages(docs.where("doc_id < 12"), bench).collect())) == whole and len(whole) >= 35


def test_sharding(spark, docs, empty):
    rows = docs.where("text is null or length(text) < 800").unionByName(spark.range(100, 1100).select(F.col("id").alias("doc_id"), F.concat(F.lit("copy"), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("id").cast("string"))).alias("text")), allowMissingColumns=True)
    got = sharding.shard_by_bytes(rows, 8, interval_rows=20).collect()
    assert len(got) == rows.count()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    texts = dict(held(rows))
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    copies = sorted({r["shard"] for r in got if r["doc_id"] and r["doc_id"] >= 100 and r["doc_id"] % 3 == 0})
    assert copies == list(range(copies[0], copies[-1] + 1))
    assert sharding.shard_by_bytes(empty, 8).count() == 0
    assert sharding.shard_by_bytes(docs.limit(1), 8).count() == 1


def without_repeats(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out.append(repr((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())))
    return sorted(out)


def test_shards_follow_one_order_and_keep_groups(spark):
    rng = random.Random(12)
    texts = [sentence(rng.randint(1, 60), rng) for _ in range(600)] + ["x" * 40] * 7 + [sentence(30, rng)] * 400 + [None, ""]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 6, interval_rows=50).collect()
    by = {r["doc_id"]: r for r in got}
    hashed = lambda t: int(np.array([xxhash.xxh64_intdigest((t or "").encode(), 42)], np.uint64).view(np.int64)[0])
    order = [k for k, _ in sorted(rows, key=lambda r: (hashed(r[1]), r[0]))]
    assert [(by[k]["shard"], by[k]["slot"]) for k in order] == sorted((r["shard"], r["slot"]) for r in got)
    total = sum(r["size"] for r in got)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 6 and all(abs(s - total / 6) <= 2 * sharding.WHOLE * total / 6 + max(r["size"] for r in got) for s in sizes.values())
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(by[k])
    for own in groups.values():
        shards = {r["shard"] for r in own}
        assert len(shards) == 1 or sum(r["size"] for r in own) > sharding.WHOLE * total / 6
    assert len({r["shard"] for r in groups[texts[-3]]}) > 1


def test_substring(spark, docs, empty, sf_dir):
    assert sorted(repr(tuple(r)) for r in substring.remove_repeats(docs).collect()) == without_repeats(held(docs))
    assert substring.remove_repeats(empty).count() == 0
    check(spark, sf_dir, queries.QUERIES["op7_block_anchors"], queries.ORACLES["op7_block_anchors"])


@pytest.mark.parametrize("hot, words", [(1000, 8 << 20), (2, 8 << 20), (2, 200)])
def test_hot_passages(spark, monkeypatch, hot, words):
    # two passages that very many texts share, at any offset and in part, and texts cut off within them
    rng = random.Random(5)
    a, b = sentence(120, rng).split(), sentence(70, rng).split()
    rows = []
    for k in range(150):
        head, tail = sentence(rng.randint(0, 60), rng).split(), sentence(rng.randint(0, 60), rng).split()
        cut = rng.choice([0, 0, 0, 30, 75])
        rows.append((rng.randint(-50, 500), " ".join(head + a[cut:] + (b if k % 3 else a[:90]) + tail)))
    monkeypatch.setattr(substring, "HOT_LEAST", hot)
    monkeypatch.setattr(substring, "HOT_SHARE", 1_000_000)
    monkeypatch.setattr(substring, "WORDS_PER_PART", words)
    monkeypatch.setattr(substring, "SLICE_BYTES", 4000)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = substring.index_blocks(table.select(F.col("doc_id").alias("id"), "text"))
    found = substring.HotBlocks(index, index.agg(F.sum("n")).first()[0])
    assert (len(found.hashes) > 100) == (hot == 2) and (found.spread > 1) == (words == 200)
    assert sorted(repr(tuple(r)) for r in substring.remove_repeats(table).collect()) == without_repeats(rows)


def base_spans(text):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(spark, docs, empty):
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    given = [f"é token=secret:abcdefgh1 PASSWORD = 'abcdefgh.' api_key:\"{'a1' * 20}\"", f"x AKIA{'B' * 12}AKIA {'0f' * 16}g AKIA12", f"key {key} and aaaaaaaaaaaaaaaaaaaaaaaaaaaa1A", "secret=short passwd=", " ".join([f"token={'ab12' * 3}"] * 600), f"{key}"]
    rows = docs.unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(given)], "doc_id long, text string"), allowMissingColumns=True)
    limits = secrets.fit_limits(rows)
    found = secrets.with_secrets(rows, limits)
    assert found.columns == [*rows.columns, "_secrets"]
    for r in found.collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["_secrets"] if s["kind"] < 3] == base_spans(r["text"] or "")
        assert all((r["text"][s["start"] : s["end"]]) == s["value"] for s in r["_secrets"])
        random_ones = {s["value"] for s in r["_secrets"] if s["kind"] == 3}
        assert random_ones == ({key} if r["doc_id"] in (102, 105) else set())
    clean = {r["doc_id"]: r["x"] for r in rows.select("doc_id", secrets.redact(F.col("text"), limits).alias("x")).collect()}
    assert clean[104] == " ".join(["[SECRET]"] * 600) and clean[102].startswith("key [SECRET] and aaa") and clean[0] is None and clean[8] == LONG
    assert secrets.with_secrets(empty, secrets.fit_limits(empty)).count() == 0


def test_long_prefix_sums(spark):
    sizes = [random.Random(k).randint(0, 9) for k in range(1000)]
    got = spark.createDataFrame([(sizes,), ([],)], "x array<int>").select(secrets.sums_before(F.col("x")).alias("y")).collect()
    assert got[0]["y"] == [sum(sizes[:k]) for k in range(1000)] and got[1]["y"] == []


KEY_ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"}


def keys_of(n, rng, lengths=(32, 40, 48, 64)):
    return ["".join(rng.choice(a) for _ in range(length)) for a in KEY_ALPHABETS.values() for length in lengths for _ in range(n)]


def identifiers(n, rng):
    words = "release notes final version user token list handler factory default config parser request response session manager build number update index table merge branch linux image north south report yearly budget meeting summary draft quarter service cluster".split()
    out = []
    for _ in range(n):
        parts, text = [], ""
        style = rng.choice(["camel", "snake", "kebab", "digits"])
        while len(text) < 22:
            parts.append(rng.choice(words) if style != "digits" or rng.random() < 0.7 else str(rng.randint(2000, 2030)))
            if style in ("camel", "digits"):
                text = parts[0] + "".join(p.capitalize() for p in parts[1:]) + str(rng.choice(["", 2024, 7]))
            else:
                text = ("_" if style == "snake" else "-").join(parts)
        out.append(text)
    return out


def brute_battery(token):
    """The battery in plain Python."""
    body = token.rstrip("=")
    k = next(k for k, (p, _) in enumerate(secrets.ENCODINGS) if re.match(p, token))
    alphabet = secrets.ENCODINGS[k][1]
    classes = dict(zip(*secrets.changes_of(alphabet)[:2], strict=True))
    n, size, x = len(body), len(alphabet), [alphabet.index(c) for c in body]
    tail = lambda z: 1 / (1 + np.exp(1.5976 * np.clip(z, -12, 12) + 0.07056 * np.clip(z, -12, 12) ** 3))
    chi = sum((x.count(c) - n / size) ** 2 for c in range(size)) / (n / size)
    df = size - 1
    p = [tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))]
    share = Counter(classes.values())
    share = [v / size for v in share.values()]
    change = 1 - sum(q * q for q in share)
    changes = sum(classes[a] != classes[b] for a, b in zip(body, body[1:], strict=False))
    spread = np.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (sum(q * (1 - q) ** 2 for q in share) - change**2))
    p.append(2 * tail(abs(changes - (n - 1) * change) / spread))
    d = np.array(x) - np.mean(x)
    z = (n * (d[1:] * d[:-1]).sum() / (d**2).sum() + 1) / np.sqrt(n) if (d**2).sum() else 12.0
    p.append(2 * tail(abs(z)))
    return min(1.0, 3 * min(p)) >= secrets.REJECTED, changes


def test_randomness_battery(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(sentence(3000),)], "text string")
    limits = secrets.symbol_limits(docs)
    assert len(limits.same) == len(secrets.ENCODINGS) and all(1 / len(set(a.lower())) <= s < 1 for s, (_, a) in zip(limits.same, secrets.ENCODINGS, strict=True))
    dull = ["0a" * 30, "0123456789abcdef" * 4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "=" * 30, "-" * 25, "onlyletters" * 3, "A" * 20 + "==", "x=" * 15]
    tokens = keys_of(10, rng, (20, 25, 32, 40, 64, 200)) + identifiers(150, rng) + dull
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.test_token(F.col("t"), limits).alias("x")).collect()
    got = {r["t"]: r["x"] for r in rows}
    for t in tokens:
        if len(t.rstrip("=")) > 1:
            assert got[t]["random"] == brute_battery(t)[0], t
        assert got[t]["length_class"] == max(0, int(np.log2(max(len(t.rstrip("=")), 2) / 10)))
    assert not any(got[t]["random"] for t in dull)
    # random tokens of all encodings and lengths pass but for a share of REJECTED, and look less ordinary the longer they are
    keys = keys_of(400, rng, (20, 40))
    passed = [brute_battery(t)[0] for t in keys]
    assert np.mean(passed) >= 0.99
    steps = {n: np.median([got[t]["step"] for t in tokens[:360] if len(t) == n]) for n in (20, 40, 64, 200)}
    assert steps[20] < steps[40] < steps[64] <= steps[200]


def test_symbols_of_all_texts_are_counted(spark):
    texts = ["aab B\tAé9\x0b--", None, "", "  ", "b" * 5000 + "\nzz=" + " b" * 700, "\u00a0q\u2003q"]
    counts = Counter("".join(t or "" for t in texts).lower())
    limits = secrets.symbol_limits(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    for k, (_, alphabet) in enumerate(secrets.ENCODINGS):
        held = [1 + counts[c] for c in sorted(set(alphabet.lower()))]
        share = [(c / sum(held) + 1 / len(held)) / 2 for c in held]
        assert abs(limits.same[k] - sum(p**2 for p in share)) < 1e-12 and abs(limits.thrice[k] - sum(p**3 for p in share)) < 1e-12
    none = secrets.symbol_limits(spark.createDataFrame([], "text string"))
    assert all(abs(s - 1 / len(set(a.lower()))) < 1e-12 for s, (_, a) in zip(none.same, secrets.ENCODINGS, strict=True))


def test_binomial_tails():
    tails = secrets.binomial_tails(0.25, 20)
    for n in (0, 1, 7, 20):
        for s in range(n + 1):
            exact = sum(math.comb(n, k) * 0.25**k * 0.75 ** (n - k) for k in range(s, n + 1))
            assert abs(tails[n * 21 + s] / 1000 + np.log(exact)) < 2e-3


def test_discoveries_are_those_of_the_procedure():
    rng = random.Random(1)
    for _ in range(50):
        steps = [rng.choice([0, 1, 2, 5, 20, 40, 60, 90]) for _ in range(rng.randint(1, 60))]
        p = sorted(10 ** (-s / secrets.STEPS) for s in steps)
        rank = max((k + 1 for k, x in enumerate(p) if x <= 0.05 * (k + 1) / len(p)), default=0)
        assert sum(s >= secrets.discoveries(Counter(steps)) for s in steps) == rank
    assert secrets.discoveries({}) == secrets.LAST_STEP + 1


@pytest.mark.parametrize("n", [0, 1, 5])
def test_keys_among_identifiers(spark, n):
    rng = random.Random(20 + n)
    keys, names = set(keys_of(n, rng)), identifiers(400, rng)
    keys -= {k for k in keys if re.search(r"[0-9a-f]{32}", k)}
    tokens = [*keys, *names]
    rng.shuffle(tokens)
    docs = spark.createDataFrame([(k, sentence(60, rng) + " " + t + " " + sentence(20, rng)) for k, t in enumerate(tokens)], "doc_id long, text string")
    found = secrets.with_secrets(docs, secrets.fit_limits(docs)).select(F.explode("_secrets").alias("s")).where("s.kind = 3").select("s.value").collect()
    found = [r[0] for r in found]
    right = sum(x in keys for x in found)
    assert right >= 0.9 * len(keys) and right >= 0.9 * len(found)


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe(docs, empty, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    got = sorted((repr(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in bpe.bpe_encode_decode(docs, vocabulary).collect())
    expected = []
    for i, text in held(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected.append((repr(i), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)
    assert bpe.bpe_encode_decode(empty, vocabulary).count() == 0


def test_bpe_on_random_texts(vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 50)
    t, e = Tokenizer.from_file(vocabulary), bpe.Encoder(bpe.load_vocabulary(vocabulary))
    rng = random.Random(6)
    alphabet = [*"aabcdeehiinnorsst'éÉÀßſKİΣςσ 0123½²_-<|>\u0327\u0301 \x1c\x85\xa0漢字😀\t\n", "<|endoftext|>", "'ll", "'S", " the "]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(text), "<u4").tolist() == ids
        assert e.table.decode(np.array(ids, np.int64)).decode() == t.decode(ids, skip_special_tokens=False)


def test_language(spark, docs, empty):
    rng = random.Random(8)
    texts = [("aa", " ".join("".join(rng.choice("abcd") for _ in range(5)) for _ in range(40))) for _ in range(60)] + [("zz", " ".join("".join(rng.choice("wxyz") for _ in range(5)) for _ in range(40))) for _ in range(60)]
    train = spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(texts)] + [(500, None, "aa"), (501, "abc", None), (502, "12", "qq")], "doc_id long, text string, lang string")
    net = language.fit_language(train)
    assert net.languages == ["aa", "zz"]
    asked = spark.createDataFrame([(1, "dcba abba"), (2, "xyzzy wxyz"), (3, None), (4, "12 #½"), (5, ""), (6, "dcab " * 4000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict_language(asked, net).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 7)] == ["aa", "zz", "und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict_language(docs, net).count() == docs.count() and language.predict_language(empty, net).count() == 0
    assert language.fit_language(train.where("false")) is None
    assert {r["lang_pred"] for r in language.predict_language(docs, None).collect()} == {"und"}


def test_gru_gradients():
    rng = np.random.default_rng(0)
    net = language.Network.new(["a", "b", "c"], rng)
    for p in net.parameters():
        p.astype(float)
    data = rng.integers(90, 110, (12, 5)).astype(np.uint8)
    mask = (np.arange(12)[:, None] < np.array([12, 12, 5, 9, 1])[None, :]).astype(np.float32)
    y = np.array([0, 1, 2, 1, 0])
    _, grads = language.gradients(net, data, mask, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p.shape[0] == 256:
                at = (int(data[0, 0]), at[1])
            old, step = p[at], np.float32(1e-2)
            p[at] = old + step
            up = language.gradients(net, data, mask, y)[0]
            p[at] = old - step
            down = language.gradients(net, data, mask, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_passage_gradients():
    rng = np.random.default_rng(1)
    texts = [sentence(n).encode() for n in (5, 200, 90)]
    x, text = passages.describe(texts)
    f = lambda *s: rng.normal(0, 0.3, s)
    m = passages.Model(x.mean(0), np.ones(passages.FEATURES), f(passages.FEATURES, passages.CODE), f(passages.CODE), f(passages.CODE, passages.ATTENTION), f(passages.CODE, passages.ATTENTION), f(passages.ATTENTION), f(passages.CODE), f(1))
    y = np.array([1.0, 0.0, 1.0])
    _, grads = passages.gradients(m, x, text, y)
    for p, g in zip(m.parameters(), grads, strict=True):
        at = tuple(rng.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = passages.gradients(m, x, text, y)[0]
        p[at] = old - 1e-5
        down = passages.gradients(m, x, text, y)[0]
        p[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_passages_by_brute_force():
    """Features of passages, and the pooled score, one text and passage at a time."""
    rng = np.random.default_rng(2)
    texts = ["", " \n", "one", sentence(64), sentence(65) + "\nx", " ".join(sentence(30).split() * 3), sentence(200) + "\n\n" + sentence(7)]
    x, text = passages.describe([t.encode() for t in texts])
    expected, owner = [], []
    for k, t in enumerate(texts):
        data = t.encode()
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        words = [data[a:b] for a, b in spans]
        windows = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        covered = {i for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for i in range(j, j + 5)}
        for j in range(0, max(len(words), 1), passages.PASSAGE_WORDS):
            f = np.zeros(passages.FEATURES)
            if words:
                last = min(j + passages.PASSAGE_WORDS, len(words))
                piece = data[spans[j][0] : spans[last][0] if last < len(words) else len(data)]
                for byte in piece:
                    f[byte] += 1
                f[257] = np.log1p(f[10])
                f[:256] = np.sqrt(f[:256] / len(piece))
                f[256] = len([i for i in covered if j <= i < last]) / (last - j)
                f[258] = np.log1p(len(piece) / (last - j))
            expected.append(f)
            owner.append(k)
    assert text.tolist() == owner and np.allclose(x, expected, atol=1e-5)
    f = lambda *s: rng.normal(0, 0.3, s)
    m = passages.Model(x.mean(0), np.ones(passages.FEATURES), f(passages.FEATURES, passages.CODE), f(passages.CODE), f(passages.CODE, passages.ATTENTION), f(passages.CODE, passages.ATTENTION), f(passages.ATTENTION), f(passages.CODE), f(1))
    got = m.scores(x, text, len(texts))
    for k in range(len(texts)):
        codes, weights = [], []
        for row, o in zip(x, owner, strict=True):
            if o == k:
                code = np.tanh((row - m.mean) @ m.encode + m.encode_bias)
                codes.append(code)
                weights.append(np.exp(m.attend @ (np.tanh(code @ m.tanh) / (1 + np.exp(-(code @ m.gate))))))
        pooled = sum(w * c for w, c in zip(weights, codes, strict=True)) / sum(weights)
        assert abs(got[k] - 1 / (1 + np.exp(-(pooled @ m.out + m.bias[0])))) < 1e-9


def test_network_by_brute_force():
    """Document probabilities of the network, byte by byte."""
    rng = np.random.default_rng(5)
    net = language.Network.new(["a", "b", "c"], rng)
    texts = [b"hello w\xc3\xb6rld 12", b"x" * 200, b"!! 5", bytes(range(97, 123)) * 5]
    got = language.text_probabilities(net, texts)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for text, row in zip(texts, got, strict=True):
        total, letters = np.zeros(3), 0
        for start in range(0, len(text), language.WINDOW):
            window = text[start : start + language.WINDOW]
            states = []
            for k, order in ((0, range(len(window))), (1, range(len(window) - 1, -1, -1))):
                h, held = np.zeros(language.HIDDEN), {}
                for t in order:
                    n = language.HIDDEN
                    x, u = net.tables[k][window[t]], h @ net.gates[k]
                    z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
                    h = (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :]) + z * h
                    held[t] = h
                states.append(held)
            for t, byte in enumerate(window):
                if chr(byte).isalpha() and byte < 128 or byte >= 128:
                    v = np.exp(np.concatenate([states[0][t], states[1][t]]) @ net.head + net.bias)
                    total += v / v.sum()
                    letters += 1
        assert np.allclose(row, total / max(letters, 1), atol=1e-4)


def test_texts_for_learning_are_settled_before_they_are_fetched(spark):
    rows = spark.createDataFrame([(k % 50, f"text {k % 60}", "en" if k % 2 else "de") for k in range(400)] + [(None, "none", "en"), (3, "text 3", None)], "doc_id long, text string, lang string")
    assert language.fit_language(rows, limit=5) is not None
    assert language.fit_language(rows.where("lang is null")) is None


def test_very_long_texts():
    """Ten megabytes in one text: pieces give the same hashes as the whole, and no kernel fails."""
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(np.frombuffer(b"abcdefghij    \n", np.uint8), 10_000_000)) + b"y" * 2_500_000 + b" end"
    data = np.frombuffer(text, np.uint8)
    s = substring.Slice([text])
    for k in (0, 1000, len(s.words) // 2, len(s.words) - 3, len(s.words) - 1):
        piece = data[s.starts[k] : s.ends[k]]
        alone = substring.Slice([piece.tobytes()])
        assert alone.words.tolist() == [s.words[k]]
    rolled = simhash.rolling_hashes(s.words, 5)
    for k in (0, (1 << 20) - 3, 1 << 20, len(rolled) - 1):
        assert simhash.rolling_hashes(s.words[k : k + 5], 5)[0] == rolled[k]
    assert 0 <= simhash.fingerprint(text, 3) < 1 << 64
    x, owner = passages.describe([text])
    assert np.isfinite(x).all() and (owner == 0).all()


def test_a_decoder_of_its_own_is_refused(vocabulary):
    import json

    spec = json.loads(bpe.load_vocabulary(vocabulary))
    with pytest.raises(ValueError):
        bpe.Encoder(json.dumps(spec | {"decoder": {"type": "ByteLevel"}}))


def test_quality_model(spark, docs, empty):
    good, bad = [sentence(100) for _ in range(40)], [" ".join(w + "###" for w in sentence(100).split()) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k, _ in rows] + [(500, 1), (0, 1), (900, 0), (None, 1)], "doc_id long, quality int")
    model = passages.fit_quality(table, labels)
    got = {r["doc_id"]: r["score"] for r in passages.score_quality(table, model).collect()}
    assert all((got[k] >= 0.3) == (k < 40) for k, _ in rows) and 0 <= got[500] <= 1
    assert passages.score_quality(docs, model).count() == docs.count() and passages.score_quality(empty, model).count() == 0
    assert passages.fit_quality(empty, labels) is None
    assert {r["score"] for r in passages.score_quality(docs, None).collect()} == {0.5}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES["op2_bidirectional_gru"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = queries.QUERIES["op9_attention_passages"](spark, folder).join(labels.select("doc_id", "quality"), "doc_id").where("held_out")
    assert scored.where("quality = predicted").count() >= 0.93 * scored.count()


def test_query_columns(spark, sf_dir):
    columns = {"op1": ["doc_id", "fingerprint", "component_id"], "op2": ["doc_id", "held_out", "lang_pred", "score"], "op6": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op8": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op9": ["doc_id", "held_out", "score", "predicted"], "op10": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op11": ["page_id", "url", "text", "n_chars"]}
    for name, f in queries.QUERIES.items():
        if (wanted := columns.get(name.split("_")[0])):
            assert f(spark, sf_dir).columns == wanted
    assert hashlib.sha256(b"").hexdigest() in {r[0] for r in queries.QUERIES["op8_randomness_battery"](spark, sf_dir).select("base_sha256").collect()}


def edits_of(counts):
    """(word -> form, n_near) by deleting and comparing, over all words."""
    near = {w: set() for w in counts}
    shorter = {}
    for w in counts:
        for k in range(len(w)):
            shorter.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
            if (v := w[:k] + w[k + 1 :]) in near and v:
                near[w].add(v), near[v].add(w)
    for same in shorter.values():
        for w in same:
            near[w] |= same - {w}
    best = {w: min(x, key=lambda v: (-counts[v], v)) for w, x in near.items() if x}
    return {w: b for w, b in best.items() if counts[b] >= 5 * counts[w]}, {w: len(x) for w, x in near.items()}


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_spelling_variants(spark, monkeypatch, block):
    """Words of few letters, so that blocks are full, and a long one; parted blocks and whole ones give the same."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(600)} | {"é" * 4000, "é" * 4001, "é" * 3999 + "b", "thethethe", "thethetha", "xthethethe", "thethethex"}
    counts = {w: rng.choice([1, 2, 5, 9, 30, 160, 800]) for w in words}
    rows = [(w, n, "s") for w, n in counts.items()] + [(None, 3, "s")]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long, form string")).collect()
    forms, n_near = edits_of(counts)
    assert len(got) == len(counts)
    for r in got:
        root = r["word"]
        while root in forms:
            root = forms[root]
        form = forms.get(r["word"])
        assert tuple(r) == (r["word"], form, root, n_near[r["word"]], counts[form] if form else None)


def test_blocks_are_bounded_and_hold_each_pair_once(spark):
    """Words of one hot prefix: no block with a stretch of two or more has over the bound."""
    words = [("international" + a + b + c, 1) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    df = spark.createDataFrame(words, "word string, n long")
    blocks = spelling.blocks_of(df, 16)
    assert blocks.groupBy(*spelling.KEY).count().join(blocks.where("hi - lo > 1"), spelling.KEY, "left_semi").agg(F.max("count")).first()[0] <= 16
    got = {r["word"]: r["n_near"] for r in spelling.near_words(df, 16).collect()}
    assert got == {w: 21 for w, _ in words}


def test_spelling_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(none).count() == 0 and spelling.runs_of_letters(empty).count() == 0
    twice = spark.createDataFrame([("aaaaaa", 3), ("aaaaaa", 3), ("aaaaab", 30), ("", 1)], "word string, n long")
    assert sorted(tuple(r) for r in spelling.spelling_variants(twice).collect()) == [("", None, "", 0, None), ("aaaaaa", "aaaaab", "aaaaab", 1, 30), ("aaaaab", None, "aaaaab", 1, None)]
    runs = Counter(r["word"] for r in spelling.runs_of_letters(docs, 6, "text", "doc_id").where("doc_id is not null").collect())
    brute = Counter(re.sub("[A-Z]", lambda m: m.group().lower(), w) for i, t in held(docs) if i is not None for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or "") if len(w) >= 6)
    assert runs == brute


def test_spelling_query_by_brute_force(spark, sf_dir):
    counts = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", r["text"] or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            k = h % len(w)
            counts[w[:k] + w[k + 1 :] if h % 199 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, n_near = edits_of(counts)
    got = queries.QUERIES["op12_spelling_variants"](spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n_near", "form_n"]
    assert {(r["word"], r["form"], r["n_near"]) for r in got.collect()} == {(w, forms.get(w), n_near[w]) for w in counts}


def layout(k, body, title="A title"):
    """A page of a host whose markup names no roles but in its side notes: fixed texts, a slot of prose and a slot of links."""
    return f"""<html><head><title>{title}</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class=page-{k}>
    <div class=c1><div>Our house paper</div><div><a href=/>home</a> <a href=/{k}>more {k}</a></div></div>
    <div class=c2><h1>{title}</h1>{body}<div>Read this paper on paper too</div><div class="user-comments"><p>What a comment {k}, {"so long " * 60}</p></div></div>
    <div class=c3>Written by hand, printed by machine {k}</div></body></html>"""


def test_templates_without_named_roles(spark):
    rng = random.Random(3)
    bodies = [[sentence(30, rng) for _ in range(3)] for _ in range(6)]
    pages = [(k, f"http://paper.example/{k}", layout(k, "".join(f"<p>{p}" for p in b), f"Title {k}"), "c", 1) for k, b in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in templates.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string, host string, container long")).collect()}
    for k, b in enumerate(bodies):
        assert got[k] == "\n".join([f"Title {k}", *b])


def test_copies_are_not_a_template(spark):
    """A host of which most pages are copies of one article keeps the article's text."""
    text = [sentence(40, random.Random(k)) for k in range(3)]
    page = "<body><div class=x>" + "".join(f"<p>{p}</p>" for p in text) + "</div></body>"
    pages = [(k, "http://copies.example/a", page) for k in range(9)] + [(9, "http://copies.example/b", "<body><div class=x><p>another text of its own</p></div></body>")]
    got = templates.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"\n".join(text), "another text of its own"} and len(got) == 10


@pytest.mark.parametrize("sent", [-1, 1 << 25])
def test_odd_pages(spark, monkeypatch, sent):
    monkeypatch.setattr(templates, "MOST_SENT", sent)
    article = "<nav><a>menu</a></nav><article><header><h1>One &amp; two</h1></header><p>a <b>bold</b>er\n  word<br>and&nbsp;more<p>second<ul><li>x<li>y</ul><form><p>send</form><aside>note</aside><div class='ad-box'>buy</div><table><tr><td>1<td>2</table>tail</article><footer>end"
    odd = {
        0: (None, None, ""), 1: ("http://a.example/", "", ""), 2: ("no host", "   ", ""), 3: (None, "plain text", "plain text"),
        4: ("http://b.example/1", article, "One & two\na bolder word and more\nsecond\nx\ny\n1\n2\ntail"),
        5: ("http://b.example/1", article, "One & two\na bolder word and more\nsecond\nx\ny\n1\n2\ntail"),
        6: ("http://c.example/", "<p>open <!-- <p>no</p> --> still <a title='a > b'>link</a> &lt;p&gt; &#233;&copy;</i></div></p>", "open still link <p> é©"),
        7: ("http://c.example/", "<script>never closed <p>x", ""), 8: ("http://c.example/", "<!-- never closed <p>x", ""),
        9: ("http://d.example/", "<div hidden><p>gone</p></div><p style='display: none'>gone</p><p>" + "long " * 200_000 + "</p>", ("long " * 200_000).strip()),
        10: ("http://e.example/", "<H1>Big</H1><P CLASS=Intro>text<HR>after</P><section id=Comments><article class=comment><p>me too</p></article></section>", "Big\ntext\nafter"),
        12: ("http://g.example/", "<body class='nav-open'><nav><ul><li>never closed<article class='post has-comments no-sidebar'><h1>T</h1><p>kept</article><div class='with-sidebar'><p>so is this beside it</div>", "T\nkept"),
        13: ("http://h.example/", "<div class='widget'><p>all of it is in one widget</p><form>but no form</form></div>", "all of it is in one widget"),
        14: ("http://i.example/", "<header><h1>Site</h1><main><p>main part</main></header><section class=comments><article><p>said</article></section>", "main part"),
        15: ("http://j.example/", "<div class='page with-sidebar menu-visible'><div class='content no-sidebar'><p>in two columns</p></div><div class=sidebar><p>beside</p></div></div>", "in two columns"),
        11: ("http://f.example/", "a < b and c > d <3 &unknown; &amp", "a < b and c > d <3 &unknown; &"),
    }
    rows = [(k, u, h, "x", None) for k, (u, h, _) in odd.items()]
    df = spark.createDataFrame([*rows, rows[4]], "page_id long, url string, html string, host string, fixed string")
    got = templates.main_texts(df)
    assert got.columns == ["page_id", "url", "text"] and got.count() == len(rows) + 1
    assert {r["page_id"]: (r["url"], r["text"]) for r in got.collect()} == {k: (u, t) for k, (u, _, t) in odd.items()}
    assert templates.main_texts(df.limit(0)).count() == 0


def test_main_texts_of_pages(spark):
    """Every page of the table against its article, taken apart by its own simple markup."""
    folder = "/root/testdata/sf0.01"
    import html

    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.QUERIES["op11_template_classes"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(rows) == len(got)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = (" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner).replace("<br>", " ")))
        text = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]] == (r["url"], text, len(text))
