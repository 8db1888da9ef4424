"""Related words by vectors of sound and meaning."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import dealt, kept
from .search import sharing_ancestor

#: Rows of a block of queries or of the corpus: what one group compares.
QUERY_BLOCK, CORPUS_BLOCK = 2048, 16384
#: Queries of a block that are compared at once: 4 MB for a matrix of their distances.
TOGETHER = 32
#: Decimal places of distances: what is equal in them is a tie.
PLACES = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v with length 1; a zero vector stays. Lambdas keep v and its length from being made anew for each place."""
    scaled = lambda x: F.when(x["length"] > 0, F.transform(x["v"], lambda y: y / x["length"])).otherwise(x["v"])
    sized = F.transform(F.array(v), lambda v: F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("length")))
    return F.get(F.transform(sized, scaled), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def blocks_of(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt into blocks of bounded size: each row once for every block of the other side, with the columns bq and bc. Rows of one pair of blocks are what one group compares."""
    n_q, n_c = (max(1, -(-t.count() // size)) for t, size in ((queries, QUERY_BLOCK), (corpus, CORPUS_BLOCK)))

    def dealt(rows: DataFrame, own: str, n: int, other: str, n_other: int) -> DataFrame:
        # new names: a cogroup tells the two sides apart by their columns' identity
        return rows.select(*[F.col(c).alias(c) for c in rows.columns], F.pmod(F.xxhash64("refid"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    return dealt(queries, "bq", n_q, "bc", n_c), dealt(corpus, "bc", n_c, "bq", n_q)


def nearest(queries: DataFrame, corpus: DataFrame, k: int | None, alpha: float = 0.4, exclude_language: bool = True, penalty: float = 0.0) -> DataFrame:
    """(q, refid, langid, dist, rank): the k nearest of the corpus for every query, exactly; all of it for None.

    Both have (refid, langid, p, s): array<double> for sound and meaning. dist is 1 minus the
    weighted cosines, rounded to PLACES; rows of the query's own language are left out if asked.
    Where queries have the column kin (array<long>), rows of other languages than these are
    penalty further off, before the nearest are chosen. Ties go by refid. Each pair of blocks is one
    matrix product, and only its best k for each query go on: the work is every query times the
    corpus, the shuffle the queries once for each block of the corpus and the reverse.
    """
    if "kin" not in queries.columns:
        queries = queries.withColumn("kin", F.lit(None).cast("array<long>"))
    used = [name for name, _ in weights_of(alpha)]
    left, right = blocks_of(queries.select("refid", "langid", *used, "kin"), corpus.select("refid", "langid", *used))
    found = left.groupBy("bq", "bc").cogroup(right.groupBy("bq", "bc")).applyInPandas(nearest_in_blocks(k, alpha, exclude_language, penalty), FOUND)
    return ranked(found, k)


#: What comparing a block of queries with one of the corpus gives.
FOUND = "q long, refid long, langid long, dist double"
#: Runs of a row of distances of which the least value each bounds the nearest.
RUNS = 64


def weights_of(alpha: float) -> list[tuple[str, float]]:
    """The columns that count in a distance, and their weights."""
    return [(name, w) for name, w in (("p", alpha), ("s", 1 - alpha)) if w]


def few_nearest(row: np.ndarray, k: int) -> np.ndarray:
    """Places of a row of distances among which are its k least, all that equal them in PLACES too. The k-th least of the least of parts of the row is no less than its k-th least, and to find it costs little."""
    if len(row) <= k:
        return np.arange(len(row))
    parts = len(row) // RUNS
    least = row[: parts * RUNS].reshape(RUNS, parts).min(0) if parts >= k else row
    return np.flatnonzero(row <= np.partition(least, k - 1)[k - 1] + 2 * 10.0**-PLACES)


def nearest_in_blocks(k: int | None, alpha: float, exclude_language: bool, penalty: float):
    """A function of a block of queries (refid, langid, p, s, kin) and one of the corpus (refid, langid, p, s): the k nearest of the block for each query."""

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            # a language's rows stand together
            c = c.iloc[np.argsort(c["langid"].to_numpy(), kind="stable")]
            ids, langs = c["refid"].to_numpy(), c["langid"].to_numpy()
            across = np.hstack([_units(c[name]) for name, _ in weights_of(alpha)]).T
            held = np.empty((min(TOGETHER, len(q)), len(c)))  # one piece of memory for all matrices
            # the same few languages and kins come again with each query
            own = functools.cache(lambda lang: slice(np.searchsorted(langs, lang), np.searchsorted(langs, lang, "right")))
            further = functools.cache(lambda kin: penalty * ~np.isin(langs, kin))
            for start in range(0, len(q), TOGETHER):
                piece = q.iloc[start : start + TOGETHER]
                d = np.matmul(np.hstack([w * _units(piece[name]) for name, w in weights_of(alpha)]), across, out=held[: len(piece)])
                np.subtract(1, d, out=d)
                for row, query, lang, kin in zip(d, piece["refid"], piece["langid"], piece["kin"], strict=True):
                    if kin is not None:
                        row += further(tuple(sorted(kin)))
                    if exclude_language:
                        row[own(lang)] = np.inf
                    at = np.arange(len(row)) if k is None else few_nearest(row, k)
                    at = at[row[at] < np.inf]
                    near = np.round(row[at], PLACES)
                    order = np.lexsort((ids[at], near))[:k]
                    out.append((np.full(len(order), query), ids[at[order]], langs[at[order]], near[order]))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("q", "refid", "langid", "dist"), zip(*out, strict=True), strict=True)} if out else {"q": [], "refid": [], "langid": [], "dist": []})

    return best


def ranked(found: DataFrame, k: int | None) -> DataFrame:
    """found (q, refid, dist) with rank, the k nearest of each query; ties go by refid."""
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "refid")).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def _units(rows: pd.Series) -> np.ndarray:
    """The vectors with length 1; zero vectors stay."""
    m = np.stack(rows.to_list()).astype(float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=m, where=n > 0)


def rank_related(queries: DataFrame, corpus: DataFrame, ancestry: DataFrame, k: int | None, alpha: float = 0.4, penalty: float = 1.0, exclude_language: bool = True) -> DataFrame:
    """The k nearest forms, those of languages that share no ancestor (ancestry: langid, plangid) with the query's penalty further off; for a language without ancestors all are."""
    pairs = sharing_ancestor(ancestry).groupBy(F.col("a").alias("langid")).agg(F.collect_set("b").alias("kin"))
    asked = queries.join(pairs, "langid", "left").withColumn("kin", F.coalesce("kin", F.expr("cast(array() as array<long>)")))
    return nearest(asked, corpus, k, alpha, exclude_language, penalty)


def rank_protoforms(queries: DataFrame, corpus: DataFrame, ancestry: DataFrame, k: int | None, alpha: float = 0.4, exclude_language: bool = False) -> DataFrame:
    """The k nearest forms of languages that something descends from; no penalty."""
    return nearest(queries, corpus.join(ancestry.select(F.col("plangid").alias("langid")).distinct(), "langid", "left_semi"), k, alpha, exclude_language)


def rank_reflexes(queries: DataFrame, corpus: DataFrame, ancestry: DataFrame, k: int | None, alpha: float = 0.4, penalty: float = 1.0, exclude_language: bool = False) -> DataFrame:
    """The k nearest forms of languages that nothing descends from, those that don't descend from the query's plangid (a column) penalty further off; without one all are."""
    forms = corpus.join(ancestry.select(F.col("plangid").alias("langid")).distinct(), "langid", "left_anti")
    own = ancestry.groupBy("plangid").agg(F.collect_set("langid").alias("kin"))
    asked = queries.join(own, "plangid", "left").withColumn("kin", F.coalesce("kin", F.expr("cast(array() as array<long>)")))
    return nearest(asked, forms, k, alpha, exclude_language, penalty)


ALPHAS, CUTS, MOST = [k / 10 for k in range(11)], (5, 10, 20, 50), 50


def evaluate_alphas(members: DataFrame, per_set: int = 2) -> DataFrame:
    """(alpha, n_queries, recall5, recall10, recall20, recall50, mrr) over cognate sets.

    members: (skey, refid, langid, p, s). Queries are the first per_set of each set of two or more
    by refid; their targets are the set's other members of other languages. Each query meets every
    row once: both cosines are computed once, for all weights; per query and weight the best MOST go
    on. There are per_set queries for each set, dealt in blocks as in nearest.
    """
    order = Window.partitionBy("skey").orderBy("refid")
    sized = members.groupBy("skey").agg(F.count("*").alias("n")).where("n >= 2")
    queries = members.join(sized, "skey", "left_semi").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_set)
    totals = members.groupBy("skey", "langid").agg(F.count("*").alias("own")).join(members.groupBy("skey").agg(F.count("*").alias("n")), "skey")
    queries = queries.join(totals, ["skey", "langid"]).withColumn("targets", F.col("n") - F.col("own")).where("targets > 0")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"q": [], "alpha": [], "dist": [], "refid": [], "hit": []})
        cp, cs = _units(q["p"]) @ _units(c["p"]).T, _units(q["s"]) @ _units(c["s"]).T
        ids, parts = c["refid"].to_numpy(), []
        keys, langs = c["skey"].to_numpy(), c["langid"].to_numpy()
        for i, row in enumerate(q.itertuples()):
            other = langs != row.langid
            hit = (keys == row.skey) & other
            for a in ALPHAS:
                d = np.where(other, np.round(1 - (a * cp[i] + (1 - a) * cs[i]), PLACES), np.inf)
                at = np.lexsort((ids, d))[:MOST]
                at = at[np.isfinite(d[at])]
                parts.append(pd.DataFrame({"q": row.refid, "alpha": a, "dist": d[at], "refid": ids[at], "hit": hit[at]}))
        return pd.concat(parts)

    left, right = blocks_of(queries.select("refid", "langid", "skey", "p", "s"), members.select("refid", "langid", "skey", "p", "s"))
    found = left.groupBy("bq", "bc").cogroup(right.groupBy("bq", "bc")).applyInPandas(compare, "q long, alpha double, dist double, refid long, hit boolean")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("alpha", "q").orderBy("dist", "refid"))).where(F.col("rank") <= MOST)
    hits = ranked.groupBy("alpha", "q").agg(*[F.sum(F.when(F.col("hit") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"h{k}") for k in CUTS], F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    hits = hits.join(queries.select(F.col("refid").alias("q"), "targets"), "q")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return hits.groupBy("alpha").agg(F.count("*").alias("n_queries"), *[mean(F.col(f"h{k}") / F.col("targets"), f"recall{k}") for k in CUTS], mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"))


def best_alpha(scores: DataFrame) -> DataFrame:
    """(alpha, mrr) of the first largest mrr; 0.5 and 0 if none is over 0."""
    found = scores.where("mrr > 0").agg(F.max(F.struct("mrr", (-F.col("alpha")).alias("a"))).alias("x"))
    return found.select(F.coalesce(-F.col("x.a"), F.lit(0.5)).alias("alpha"), F.coalesce("x.mrr", F.lit(0.0)).alias("mrr"))


#: Texts whose n-grams one task makes and counts, and counts that one task sorts.
TEXTS, COUNTS = 8192, 1_000_000
#: Counts that one task puts together to sparse rows.
ENTRIES_DEALT = 250_000


def _counted(grams: DataFrame, features: int | None) -> tuple[DataFrame, DataFrame]:
    """(id, gram, tf), made once, and (gram, idf) of all grams or of the features most frequent ones."""
    counts = kept(grams.groupBy("id", "gram").agg(F.count("*").alias("tf")))
    n = counts.select("id").distinct().agg(F.count("*").alias("n"))
    known = counts.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if features is not None:
        known = known.orderBy(F.desc("total"), "gram").limit(features)
    # the number of ids is one row
    return counts, known.join(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(grams: DataFrame, features: int | None = None) -> DataFrame:
    """(id, gram, weight) of (id, gram) rows: counts times ln((1 + n) / (1 + df)) + 1, of length 1 for each id. features: only so many grams, the most frequent (of equals the first); ids without any of them have no rows but count among all.

    The counts are made once; what is known of a gram is joined to them, and a row's length is a sum
    over its id's rows, which never stand in one array.
    """
    counts, idf = _counted(grams, features)
    raw = counts.join(idf if features is None else F.broadcast(idf), "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    raw = dealt(raw, counts.count(), COUNTS, "id")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "gram", (F.col("w") / length).alias("weight"))


def sparse_rows(weights: DataFrame, ids: DataFrame, features: int) -> DataFrame:
    """(id, at: array<int>, w: array<double>) of weights (id, gram, weight) for all ids: the places of their grams among the first features in order, and the weights; empty for those without any."""
    known = weights.select("gram").distinct().orderBy("gram").limit(features)
    # features rows at most
    places = known.agg(F.array_sort(F.collect_list("gram")).alias("g")).select(F.posexplode("g").alias("place", "gram"))
    held = weights.join(F.broadcast(places), "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("x"))
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    both = ids.select("id").distinct().join(held, "id", "left")
    return both.select("id", F.coalesce(F.col("x")["place"], none("int")).alias("at"), F.coalesce(F.col("x")["weight"], none("double")).alias("w"))


def tfidf_rows(grams: DataFrame, ids: DataFrame, features: int) -> DataFrame:
    """(id, at: array<int>, w: array<double>) of (id, gram) rows for all ids: the places of their grams among the features most frequent ones in order, and their weights as tfidf has them; empty for those without any.

    Counts stay where they are until those of frequent grams are dealt by id, so many to a task; no
    gram's rows meet anywhere, and ids without grams come by a row of their own instead of a join.
    """
    counts, idf = _counted(grams, features)
    # features rows at most
    places = kept(idf.agg(F.array_sort(F.collect_list(F.struct("gram", "idf"))).alias("g")).select(F.posexplode("g").alias("place", "g")).select("place", "g.gram", "g.idf"))
    raw = counts.join(F.broadcast(places), "gram").select("id", F.struct("place", (F.col("tf") * F.col("idf")).alias("w")).alias("e"))
    every = raw.unionByName(ids.select("id", F.lit(None).cast(raw.schema["e"].dataType).alias("e")))
    # collect_list passes over nulls
    held = dealt(every, counts.count(), ENTRIES_DEALT, "id").groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("x"))
    sized = held.select("id", "x", F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, e: t + e["w"] * e["w"])).alias("length"))
    return sized.select("id", F.col("x")["place"].alias("at"), F.transform("x", lambda e: e["w"] / F.col("length")).alias("w"))


def _texts(rows: DataFrame, text: Column) -> DataFrame:
    """(id, _text) in tasks of bounded size: short texts have many n-grams, whose counts are a task's memory."""
    rows = kept(rows.select("id", F.lower(text).alias("_text")))
    return dealt(rows, rows.count(), TEXTS, "id")


def char_ngrams(rows: DataFrame, text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(id, gram): character n-grams of lower-cased texts."""
    rows, low = _texts(rows, text), F.col("_text")
    grams = []
    for n in sizes:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), _sub(low, n))
        grams.append(F.when(F.length(low) >= n, made).otherwise(F.expr("cast(array() as array<string>)")))
    return rows.select("id", F.explode(F.concat(*grams)).alias("gram"))


def _sub(text: Column, n: int):
    return lambda i: F.substr(text, i, F.lit(n))


def word_ngrams(rows: DataFrame, text: Column) -> DataFrame:
    """(id, gram): words of two characters or more, and pairs of neighbours."""
    rows = _texts(rows, text)
    words = F.regexp_extract_all(F.col("_text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return rows.select("id", F.explode(F.concat(words, pairs)).alias("gram"))


def whitened_pca(rows: DataFrame, dims: int) -> DataFrame:
    """(refid, v): the strongest directions of (refid, p), dims at most and no more than rows or places, each with variance 1 and its largest weight positive.

    Means and products are summed for each partition and then over all by Spark, a square of the
    vector's length; only that comes to the driver.
    """
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                m = np.stack(b["p"].to_list()).astype(float)
                m = np.hstack([np.ones((len(m), 1)), m])
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "row": total.tolist()})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "row": [np.stack(group["row"].to_list()).sum(0).tolist()]})

    sums = rows.select("p").mapInPandas(moments, "k int, row array<double>").groupBy("k").applyInPandas(add, "k int, row array<double>").orderBy("k").collect()
    if not sums:
        return rows.select("refid", F.col("p").alias("v"))
    table = np.array([r["row"] for r in sums])
    n, mean = table[0, 0], table[0, 1:] / table[0, 0]
    values, vectors = np.linalg.eigh(table[1:, 1:] / n - np.outer(mean, mean))
    order = np.argsort(-values, kind="stable")[: min(dims, int(n), len(mean))]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    turn = vectors / np.sqrt(np.maximum(values[order], 1e-12))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"refid": b["refid"], "v": ((np.stack(b["p"].to_list()) - mean) @ turn).tolist()})

    return rows.select("refid", "p").mapInPandas(project, "refid long, v array<double>")


#: Directions beyond those that are wanted, and rounds, of the search for the strongest ones.
SPARE, TURNS = 16, 8
#: Places whose sums are made by one task.
PLACES_TOGETHER = 16
#: Entries of sparse rows that are multiplied at once: 25 MB for 32 directions.
ENTRIES = 100_000


def _pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch of sparse rows in pieces of bounded size."""
    sizes = batch["at"].map(len).astype(int)
    for _, piece in batch.groupby((sizes.cumsum() - sizes) // ENTRIES):
        yield piece


def _products(batch: pd.DataFrame, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sparse rows: the row, place and weight of each entry, and each row times turn."""
    sizes = batch["at"].map(len).to_numpy(int)
    row = np.repeat(np.arange(len(batch)), sizes)
    at = np.concatenate([np.zeros(0, int), *batch["at"]]).astype(int)
    w = np.concatenate([np.zeros(0), *batch["w"]])
    out = np.zeros((len(batch), turn.shape[1]))
    if len(at):
        some = sizes > 0
        out[some] = np.add.reduceat(w[:, None] * turn[at], (np.cumsum(sizes) - sizes)[some])
    return row, at, w, out


def whitened_sparse(rows: DataFrame, dims: int, features: int, seed: int = 7) -> DataFrame:
    """(id, v): what whitened_pca gives for sparse rows (id, at, w), at below features; no row is ever made dense.

    The strongest directions of the rows about their mean are sought in the space that random ones
    and their products with the covariance span (a block Krylov space). In each round the tasks
    multiply their rows with the last directions and back, Spark sums what comes out for each place,
    and the driver makes the result orthogonal to what it has: features times the directions so far,
    whatever the rows. Eigenvectors of the covariance within that space are the components; where it
    is the whole space they are exact. Equally strong directions may come out turned in their plane.
    """
    rows = kept(rows)
    sums = rows.select(F.explode(F.arrays_zip("at", "w")).alias("x")).groupBy("x.at").agg(F.sum("x.w").alias("w")).collect()  # features at most
    n, width = rows.count(), max((r["at"] for r in sums), default=-1) + 1
    if not width:
        return rows.select("id", F.expr("cast(array() as array<double>)").alias("v"))
    mean = np.zeros(width)
    for r in sums:
        mean[r["at"]] = r["w"] / n
    size = min(dims + SPARE, n, width)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]

    def covariance_times(turn: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(turn.shape)
            for b in batches:
                for piece in _pieces(b):
                    row, at, w, out = _products(piece, turn)
                    if len(at):
                        order = np.argsort(at, kind="stable")
                        place, first = np.unique(at[order], return_index=True)
                        total[place] += np.add.reduceat(w[order, None] * out[row[order]], first)
            used = np.flatnonzero(total.any(1))
            if len(used):  # a table without rows has no arrays, which Spark refuses
                yield pd.DataFrame({"part": used // PLACES_TOGETHER, "place": used, "x": total[used].tolist()})

        def add(group: pd.DataFrame) -> pd.DataFrame:
            place, at = np.unique(group["place"].to_numpy(), return_inverse=True)
            total = np.zeros((len(place), turn.shape[1]))
            np.add.at(total, at, np.stack(group["x"].to_list()))
            return pd.DataFrame({"place": place, "x": total.tolist()})

        # a row for each task and place
        made = rows.select("at", "w").mapInPandas(work, "part int, place int, x array<double>").groupBy("part").applyInPandas(add, "place int, x array<double>")
        out = np.zeros(turn.shape)
        for r in made.collect():
            out[r["place"]] = r["x"]
        return out / n - np.outer(mean, mean @ turn)

    blocks, products = [turn], []
    while len(products) < TURNS and len(products) < len(blocks):
        products.append(covariance_times(blocks[-1]))
        basis = np.hstack(blocks)
        rest = products[-1]
        for _ in range(2):  # twice, for rounding
            rest = rest - basis @ (basis.T @ rest)
        new, strength, _ = np.linalg.svd(rest, full_matrices=False)
        new = new[:, strength > 1e-12 * max(np.linalg.norm(products[-1]), 1e-300)][:, : width - basis.shape[1]]
        if new.shape[1]:
            blocks.append(new)
    basis, made = np.hstack(blocks[: len(products)]), np.hstack(products)
    small = basis.T @ made
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(dims, n, width)]
    vectors = basis @ vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    final = vectors / np.sqrt(np.maximum(values[order], 1e-12))
    middle = mean @ final

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for piece in _pieces(b):
                yield pd.DataFrame({"id": piece["id"], "v": (_products(piece, final)[3] - middle).tolist()})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(project, f"id {kind}, v array<double>")


def update_vectors(vectors: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors (refid, ...) with rows added or replaced by changed, without those in gone."""
    return vectors.join(changed.select("refid"), "refid", "left_anti").unionByName(changed).join(gone.select("refid"), "refid", "left_anti")


def pair_similarity(a: Column, b: Column, form_distance: Column) -> Column:
    return cosine(a, b) / (form_distance + 1)


def with_all(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every query beside every row of the corpus (its columns with c_ before them), block by block."""
    left, right = blocks_of(queries, corpus)
    return left.join(right.select("bq", "bc", *[F.col(c).alias(f"c_{c}") for c in corpus.columns]), ["bq", "bc"]).drop("bq", "bc")


#: Rows of a block of queries and of one of the corpus of which every pair is handed on, and pairs of them that are held at once (80 MB for each of a few numbers).
PAIR_QUERIES, PAIR_CORPUS, PAIRS = 1950, 3900, 10_000_000
#: Pairs that go to Spark at once.
HANDED = 1 << 18


def in_blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name: array of structs): rows in blocks of about size, each a row and a task of its own."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("refid"), F.lit(n)).cast("int")).repartitionById(n, "b")
    return dealt.groupBy("b").agg(F.collect_list(F.struct(*rows.columns)).alias(name)).select(name)


def every_pair(queries: DataFrame, corpus: DataFrame, name: str, value: Callable[[pa.RecordBatch, pa.RecordBatch], np.ndarray], places: int | None = None) -> DataFrame:
    """(q, refid, name) of every query and every row of the corpus, value being a matrix for rows of both, infinite where there is none.

    Both sides are dealt into blocks once, and a task reads one of each: what is shuffled is the two
    tables, and only the pairs, which are the result, grow with their product. places: values, up to
    1 either way, are rounded so and those of two blocks come in their order, so that equal ones
    stand together and take little room in a file.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for both in zip(batch["queries"], batch["corpus"], strict=True):
                q, c = (pa.RecordBatch.from_struct_array(side.values) for side in both)
                pieces = -(-len(q) * len(c) // PAIRS)
                for rows in np.array_split(np.arange(len(q)), pieces):
                    piece = q.slice(rows[0], len(rows))
                    yield from handed(piece, c, value(piece, c))

    def handed(q: pa.RecordBatch, c: pa.RecordBatch, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = values.ravel()
        at = np.arange(values.size)
        if places is not None:
            values *= 10**places
            values += np.copysign(0.5, values)
            np.trunc(values, out=values)
            # sorts as whole numbers, each with its place in the lower bits
            bits = values.size.bit_length()
            at |= np.nan_to_num(values, nan=10.0**places + 1, posinf=10.0**places + 2).astype(np.int64) << bits
            at.sort()
            at &= (1 << bits) - 1
            values /= 10**places
        for start in range(0, len(at), HANDED):
            some = at[start : start + HANDED]
            shown = values[some]
            yield pa.RecordBatch.from_arrays([q["refid"].take(pa.array(some // len(c))), c["refid"].take(pa.array(some % len(c))), pa.array(shown, mask=np.isinf(shown))], names=["q", "refid", name])

    left, right = in_blocks(corpus, PAIR_CORPUS, "corpus"), in_blocks(queries, PAIR_QUERIES, "queries")
    # without the hint Spark may send all queries to all tasks
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(compare, f"q long, refid long, {name} double")


def _cosines(q: pa.RecordBatch, c: pa.RecordBatch) -> np.ndarray:
    """Cosines of the vectors s of two blocks, 0 if either is zero or missing."""

    def matrix(rows: pa.RecordBatch) -> np.ndarray:
        vectors = rows["s"].to_pandas()
        width = vectors.dropna().map(len).max()
        return np.stack([np.zeros(0 if np.isnan(width) else int(width)) if v is None else v for v in vectors]).astype(float)

    a, b = matrix(q), matrix(c)
    if not a.shape[1] or not b.shape[1]:
        return np.zeros((len(a), len(b)))
    norm = np.sqrt(np.outer((a * a).sum(1), (b * b).sum(1)))
    return np.divide(a @ b.T, norm, out=np.zeros(norm.shape), where=norm > 0)


#: Cells of the tables of distances that are worked on at once: half a megabyte for short forms.
CELLS = 1 << 19


def form_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of every left form and every right one. A table's row is made for several left forms and all right ones at once."""
    longest = max(map(len, right), default=0)
    kind = np.uint8 if max([longest, *map(len, left)]) < 255 else np.int32

    def letters(forms: list[str]) -> np.ndarray:
        """A row for each place, a column for each form."""
        width = max([1, *map(len, forms)])
        codes = np.array(forms, dtype=f"<U{width}").view("<u4").reshape(len(forms), width)
        return np.ascontiguousarray(codes.T, np.uint8 if codes.max(initial=0) < 256 else np.uint32)

    across, lengths, columns = letters(right)[:longest, None], np.array([*map(len, right)], int), np.arange(len(right))
    out = np.empty((len(left), len(right)), kind)
    together = max(1, CELLS // ((longest + 1) * max(1, len(right))))
    for start in range(0, len(left), together):
        some = left[start : start + together]
        row = np.empty((longest + 1, len(some), len(right)), kind)
        row[:] = np.arange(longest + 1)[:, None, None]
        for i, down in enumerate([None, *letters(some)[: max(map(len, some))]]):
            if i:
                above, row = row, np.empty_like(row)
                row[0] = i
                np.minimum(above[:-1] + (across != down[:, None]), above[1:] + kind(1), out=row[1:])
                for j in range(longest):
                    np.minimum(row[j + 1], row[j] + kind(1), out=row[j + 1])
            for k, form in enumerate(some):
                if len(form) == i:
                    out[start + k] = row[lengths, k, columns]
    return out


def cosines_with_all(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(q, refid, cosine) of the vectors s of every query and every row of the corpus (refid, s), 0 if either is zero or missing. Each pair of blocks is one matrix product; the pairs are the result, so the work is the queries times the corpus."""
    return every_pair(queries.select("refid", "s"), corpus.select("refid", "s"), "cosine", _cosines)


def similarities_with_all(queries: DataFrame, corpus: DataFrame, places: int = 6) -> DataFrame:
    """(q, refid, similarity) of every query and every row of the corpus (refid, form, s): what pair_similarity gives for the vectors s and the Levenshtein distance of the forms, rounded; null where a form is missing."""

    def similarities(q: pa.RecordBatch, c: pa.RecordBatch) -> np.ndarray:
        values = _cosines(q, c)
        values /= form_distances(*([x or "" for x in rows["form"].to_pylist()] for rows in (q, c))) + 1.0
        for rows, side in ((q, values), (c, values.T)):
            side[rows["form"].is_null().to_numpy(zero_copy_only=False)] = np.inf
        return values

    return every_pair(queries.select("refid", "form", "s"), corpus.select("refid", "form", "s"), "similarity", similarities, places)
