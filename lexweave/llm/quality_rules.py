"""Quality rules: plain counts, and a likelihood ratio of hashed n-grams.

Single words and pairs of neighbours are hashed into a fixed number of buckets. Two multinomials
over the buckets are counted: one over trusted target texts, one over the whole raw corpus. A
bucket's ratio is that of what the target holds to what it would hold if it were like the raw
corpus, both raised by a constant, so that it leaves one only as far as the counts bear out,
however few the trusted texts. Texts are dealt into folds by their hash, and each is judged by the
counts of the other folds, so no text is held against itself or its copies. A text's score is the
sum of its n-grams' log ratios, in hundredths and as whole numbers, divided by their number; it is
kept if the score reaches a threshold: a low quantile of the trusted texts' scores, which their own
counts have no part in. All of it is made of built-in expressions; the table of ratios has one
entry for each bucket and fold, whatever the corpus.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, free_name, let, words_column

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Added to what a bucket of the target holds, and to what it would hold.
PRIOR = 5.0
#: Parts of the corpus, by the hash of the text; each is judged by the counts of the others.
FOLDS = 3
#: Share of the trusted texts that the threshold may turn away, and the words that a text needs to count for it.
MOST_LOST, LEAST_WORDS = 0.002, 10
#: Trusted ids that are sent to all tasks; more are joined by a merge.
MOST_SENT = 2_000_000
SYMBOLS = r"[#*$%&|<>]+"


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def _pair_buckets(hashes: Column) -> Column:
    """Buckets of all pairs of neighbours."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: _bucket(F.xxhash64(a, b)))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def fold_of(text: Column) -> Column:
    """The fold of a text, by its hash; copies are in one."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def fit_ratios(docs: DataFrame, trusted: str, text_column: str = "text") -> list[str]:
    """For each fold the log ratios of all buckets, in hundredths, with commas between: of target (rows whose column trusted is true) to raw (all rows), without the fold's own. Spark sums the counts of all texts and puts the tables together: BUCKETS rows, and one text a fold for the driver. Without a target all ratios are zero."""
    fold, flag = fold_of(docs[text_column]), F.coalesce(docs[trusted], F.lit(False)).cast("int")
    hashes = docs.select((2 * fold + flag).alias("part"), _word_hashes(words_column(docs[text_column])).alias("h"))
    grams = hashes.select("part", F.explode(F.concat(F.transform("h", _bucket), _pair_buckets(F.col("h")))).alias("bucket"))
    # bucket, fold and flag as one number, which is cheap to count by
    counts = grams.groupBy((F.col("bucket") * (2 * FOLDS) + F.col("part")).alias("key")).count()
    counts = counts.select(F.expr(f"key div {2 * FOLDS}").cast("int").alias("bucket"), F.expr(f"key % {2 * FOLDS} div 2").alias("fold"), (F.col("key") % 2 * F.col("count")).alias("t"), F.col("count").alias("r"))
    own = [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(x))), F.lit(0)).alias(f"{x}{k}") for k in range(FOLDS) for x in "tr"]
    counts = checkpointed(counts.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("r").alias("r"), *own))
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns if c != "bucket"]).first()

    def ratio(k: int) -> Column:
        share = (sums["t"] - sums[f"t{k}"]) / max(1, sums["r"] - sums[f"r{k}"])
        return F.round(100 * F.log((F.col("t") - F.col(f"t{k}") + PRIOR) / (share * (F.col("r") - F.col(f"r{k}")) + PRIOR))).cast("int")

    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    ratios = every.select(F.struct("bucket", *[F.coalesce(ratio(k), F.lit(0)).alias(f"x{k}") for k in range(FOLDS)]).alias("r"))
    table = ratios.agg(F.array_sort(F.collect_list("r")).alias("all"))
    return list(table.select(*[F.array_join(F.col("all")[f"x{k}"], ",") for k in range(FOLDS)]).first())


def _score(hashes: Column, fold: Column, ratios: list[str]) -> Column:
    """The mean log ratio of a text's n-grams, given the hashes of its words; 0 without any."""
    tables = [F.split(F.lit(t), ",").cast("array<int>") for t in ratios]
    chosen = functools.reduce(lambda rest, k: F.when(fold == k, tables[k]).otherwise(rest), range(FOLDS - 1), tables[-1])
    n = F.size(hashes)
    ratio = lambda table, bucket: F.get(table, bucket.cast("int"))

    def total_by(table: Column) -> Column:
        words = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + ratio(table, _bucket(h)))
        return F.aggregate(_pair_buckets(hashes), words, lambda a, b: a + ratio(table, b))

    total = let(chosen, total_by)
    return F.when(n > 0, total / F.greatest(2 * n - 1, F.lit(1)) / 100.0).otherwise(F.lit(0.0))


def low_quantile(counts: dict[int, int], share: float = MOST_LOST) -> int | None:
    """The largest value that at most that share of the values lie below, given how often each occurs; None without any."""
    below, total = 0, sum(counts.values())
    for value in sorted(counts):
        if below + counts[value] > share * total:
            return value
        below += counts[value]
    return None


def fit_threshold(judged: DataFrame, trusted: str, quality: str = "_quality", most_lost: float = MOST_LOST) -> int | None:
    """The score, in thousandths, from which texts are kept, of rows that with_quality has judged: it turns away at most a share of most_lost of the trusted ones (of those of LEAST_WORDS words or more). None without any."""
    of = F.col(quality)
    scores = judged.where(F.col(trusted) & (of["n_words"] >= LEAST_WORDS)).select(F.floor(1000 * of["score"]).alias("s"))
    # whole numbers between the smallest and the largest log ratio
    return low_quantile({r["s"]: r["count"] for r in scores.groupBy("s").count().collect()}, most_lost)


def is_kept(quality: Column, threshold: int | None) -> Column:
    """Whether a judged text passes the base rules and reaches the threshold, if there is one; ties with it stay."""
    enough = F.lit(True) if threshold is None else quality["score"] * 1000 >= threshold
    return ~quality["base_failed"] & enough


def with_trusted(docs: DataFrame, labels: DataFrame, flag: str, id_column: str = "doc_id") -> DataFrame:
    """docs with the boolean column flag: whether the document's quality label is 1 and it isn't toxic. Null ids and those without a label aren't trusted."""
    key = free_name("_target", *docs.columns, flag)
    good = checkpointed(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias(key)).distinct())
    # labels grow with the corpus: their number says how they are joined
    good = good.hint("broadcast" if good.count() <= MOST_SENT else "merge")
    return docs.join(good, docs[id_column] == F.col(key), "left").withColumn(flag, F.col(key).isNotNull()).drop(key)


def window_hashes(words: Column, size: int = 5) -> Column:
    """Hashes of all windows of size words, given as texts or as hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, windows).otherwise(F.expr("cast(array() as array<bigint>)"))


def repeated_words(windows: Column, size: int = 5) -> Column:
    """How many words lie in a window that occurs twice or more. The windows are sorted only if some do."""

    def count(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, start, lambda a, p: F.struct((p + size).alias("end"), (a["n"] + p + size - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, count)).otherwise(F.lit(0)).cast("long")


def with_quality(docs: DataFrame, ratios: list[str], text_column: str = "text", into: str = "_quality") -> DataFrame:
    """docs with one more column into: struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long, score: double, base_failed: boolean>.

    A null or blank text has no words and fails the base rules. score is the mean log ratio by the
    text's fold; a text without words has 0. Every row is judged by itself: repeated rows get equal
    results, and further columns pass through (a column that is named into is an error: take a free
    name). A very long text is one row's work, some dozen arrays of its words. No rows give no rows.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the column {into} is taken")
    text = F.coalesce(docs[text_column], F.lit(""))

    def judge(words: Column, hashes: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(window_hashes(hashes), lambda h: repeated_words(h)).alias("n_repeat_words"),
            let(fold_of(text), lambda fold: _score(hashes, fold, ratios)).alias("score"),
        )

    def decide(q: Column) -> Column:
        return q.withField("base_failed", (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"]))

    # one expression, each part bound once: were its parts columns, a filter on the result would have them made anew for every word
    return docs.withColumn(into, let(let(words_column(docs[text_column]), lambda w: let(_word_hashes(w), lambda h: judge(w, h))), decide))
