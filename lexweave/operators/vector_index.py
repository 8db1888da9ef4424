"""Vectors of sound and meaning kept by clusters, and the nearest of them found exactly without reading most.

Vectors are stored with length 1, in parts around centers; a part's radius is the largest distance
of its members from its center, for sound and for meaning. A query's similarity to any member is at
most its similarity to the center plus the radius (Cauchy and Schwarz), whatever the two weights,
so a part whose best possible distance is beyond the k-th one found so far need not be read. A
search first reads the parts that may be nearest, and then those that the k-th distance found there
leaves open: what it returns is what comparing with every row returns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.kept import kept
from .similarity import CORPUS_BLOCK, FOUND, PLACES, QUERY_BLOCK, nearest_in_blocks, ranked, unit

#: Rows for which there is one part, and parts at most: their centers are held by the driver and sent to each task.
ROWS, MOST_PARTS = 2048, 4096
#: How often centers are moved to the middle of their parts.
ROUNDS = 3
#: Groups of neighbouring parts at most: a query is sent to groups, at most so many times.
MOST_GROUPS = 256
#: Rows that _asked hands on at once.
BATCH = 8192
#: The first parts that a query reads have so many times k rows at least.
FIRST = 4
#: What rounding may change in a bound.
SLACK = 2 * 10.0**-PLACES
QUERY = "refid long, langid long, p array<double>, s array<double>, kin array<long>"


def _both(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack(rows[c].to_list()).astype(float) for c in ("p", "s"))


@dataclass(frozen=True)
class Centers:
    """part, n: integers; p, s: (parts, dims) centers; rp, rs: radii."""

    part: np.ndarray
    p: np.ndarray
    s: np.ndarray
    n: np.ndarray
    rp: np.ndarray
    rs: np.ndarray

    def bounds(self, queries: pd.DataFrame, alpha: float) -> np.ndarray:
        """(queries, parts): the smallest distance that a member of each part can have; queries have length 1, or 0."""
        p, s = _both(queries)
        sound = p @ self.p.T + np.linalg.norm(p, axis=1)[:, None] * self.rp
        meaning = s @ self.s.T + np.linalg.norm(s, axis=1)[:, None] * self.rs
        return 1 - (alpha * sound + (1 - alpha) * meaning)


def _assign(rows: DataFrame, p: np.ndarray, s: np.ndarray) -> DataFrame:
    """rows (refid, langid, p, s) with the nearest center and the distances from it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), QUERY_BLOCK):
                piece = b.iloc[k : k + QUERY_BLOCK]
                x, y = _both(piece)
                apart = ((p**2).sum(1) + (s**2).sum(1)) - 2 * (x @ p.T + y @ s.T)
                best = apart.argmin(1)
                yield piece.assign(part=best, dp=np.linalg.norm(x - p[best], axis=1), ds=np.linalg.norm(y - s[best], axis=1))

    return rows.mapInPandas(work, "refid long, langid long, p array<double>, s array<double>, part int, dp double, ds double")


def _middles(assigned: DataFrame, p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of the parts; a part without members keeps its center. Each task sums what it reads: a row for each part and task is shuffled."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(len(p)), np.zeros((len(p), p.shape[1] + s.shape[1]))
        for b in batches:
            if len(b):
                at = b["part"].to_numpy()
                n += np.bincount(at, minlength=len(p))
                np.add.at(total, at, np.hstack(_both(b)))
        at = np.flatnonzero(n)
        if len(at):  # a table without rows has no arrays, which Spark refuses
            yield pd.DataFrame({"part": at, "n": n[at], "total": total[at].tolist()})

    partial = assigned.select("part", "p", "s").mapInPandas(sums, "part int, n double, total array<double>")
    places = partial.select("part", "n", F.posexplode("total").alias("place", "x")).groupBy("part", "place").agg((F.sum("x") / F.sum("n")).alias("x"))
    means = places.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "x")))["x"].alias("x")).collect()  # MOST_PARTS at most
    p, s = p.copy(), s.copy()
    for r in means:
        p[r["part"]], s[r["part"]] = r["x"][: p.shape[1]], r["x"][p.shape[1] :]
    return p, s


def build(vectors: DataFrame, path: str, rows_per_part: int = ROWS) -> None:
    """Writes the index of vectors (refid, langid, p, s: array<double>, of one length each) to path, in the place of another one.

    The first centers are vectors in the order of a hash of their ids, one for rows_per_part rows,
    MOST_PARTS at most; every row is then in the part of its nearest center. Equal vectors are in one
    part, which may hold any share of the rows: a search deals it into blocks.
    """
    rows = kept(vectors.select("refid", "langid", unit(F.col("p")).alias("p"), unit(F.col("s")).alias("s")))
    parts = min(MOST_PARTS, max(1, -(-rows.count() // rows_per_part)))
    first = rows.orderBy(F.xxhash64("refid"), "refid").limit(parts).toPandas()
    if len(first):
        p, s = _both(first)
        for _ in range(ROUNDS):
            p, s = _middles(_assign(rows, p, s), p, s)
        placed = _assign(rows, p, s)
    else:
        p, s, placed = np.zeros((0, 0)), np.zeros((0, 0)), rows.selectExpr("*", "0 as part", "0d as dp", "0d as ds")
    placed = kept(placed)
    sized = placed.groupBy("part").agg(F.count("*").alias("n"), F.max("dp").alias("rp"), F.max("ds").alias("rs"))
    # a part has a file for each block of its rows
    pieces = placed.join(F.broadcast(sized.select("part", F.ceil(F.col("n") / CORPUS_BLOCK).alias("pieces"))), "part")
    pieces.repartition("part", F.pmod(F.xxhash64("refid"), F.col("pieces"))).select(*placed.columns).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    held = pd.DataFrame({"part": np.arange(len(p)), "p": p.tolist(), "s": s.tolist()})
    places = rows.sparkSession.createDataFrame(held, "part int, p array<double>, s array<double>") if len(held) else rows.sparkSession.createDataFrame([], "part int, p array<double>, s array<double>")
    places.join(sized, "part").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")


class VectorIndex:
    """An index that build has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        held = spark.read.parquet(f"{path}/centers").orderBy("part").toPandas()  # MOST_PARTS at most
        self.path, self.spark = path, spark
        p, s = _both(held) if len(held) else (np.zeros((0, 0)), np.zeros((0, 0)))
        self.centers = Centers(held["part"].to_numpy(), p, s, held["n"].to_numpy(), held["rp"].to_numpy(), held["rs"].to_numpy())
        self.group = self._groups()

    def _groups(self) -> np.ndarray:
        """The group of each part: neighbours along the direction in which the centers spread most, so many rows together that there are MOST_GROUPS at most."""
        n, places = self.centers.n, np.hstack([self.centers.p, self.centers.s])
        out = np.zeros(len(n), int)
        if len(n):
            places = places - places.mean(0)
            order = np.argsort(places @ np.linalg.eigh(places.T @ places)[1][:, -1], kind="stable")
            out[order] = np.unique((np.cumsum(n[order]) - n[order]) // -(-n.sum() // MOST_GROUPS), return_inverse=True)[1]
        return out

    def rows(self, parts: list[int]) -> DataFrame:
        """(refid, langid, p, s, part) of some parts; others' files are not opened."""
        found = self.spark.read.schema("refid long, langid long, p array<double>, s array<double>, part int").parquet(f"{self.path}/rows")
        return found.where(F.col("part").isin(parts))

    def _asked(self, queries: DataFrame, k: int | None, alpha: float, second: bool) -> DataFrame:
        """queries once for each group of parts to be read, as part: those of the first parts, or, given the k-th distance so far (kth), all others with a part that it leaves open."""
        centers, group = self.centers, self.group
        grouped = lambda parts: np.stack([parts[:, group == g].any(1) for g in range(group.max() + 1)], axis=1)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for start in range(0, len(b), QUERY_BLOCK):
                    piece = b.iloc[start : start + QUERY_BLOCK]
                    bounds = centers.bounds(piece, alpha)
                    order = np.argsort(bounds, axis=1, kind="stable")
                    before = np.cumsum(centers.n[order], axis=1) - centers.n[order]
                    first = np.zeros(bounds.shape, bool)
                    np.put_along_axis(first, order, before < (np.inf if k is None else FIRST * k), axis=1)
                    wanted = grouped(first)
                    if second:
                        kth = piece["kth"].to_numpy(float)[:, None]
                        wanted = ~wanted & grouped(np.isnan(kth) | (bounds <= kth + SLACK))
                    i, j = np.nonzero(wanted)
                    for at in range(0, len(i), BATCH):
                        yield piece.iloc[i[at : at + BATCH]].assign(part=j[at : at + BATCH])[["refid", "langid", "p", "s", "kin", "part"]]

        return queries.mapInPandas(work, QUERY + ", part int")

    def _scan(self, asked: DataFrame, k: int | None, alpha: float, exclude_language: bool, penalty: float) -> DataFrame:
        """The k nearest of each group of parts for each query that asks for it. Groups, and the queries of one, are dealt into blocks of bounded size."""
        sizes = asked.groupBy("part").agg(F.count("*").alias("asks")).collect()  # a row for each group
        wanted = {r["part"] for r in sizes}
        places = [(int(p), int(g)) for p, g in zip(self.centers.part, self.group, strict=True) if g in wanted]
        blocks = {int(g): -(-int(n) // CORPUS_BLOCK) for g, n in enumerate(np.bincount(self.group, self.centers.n))}
        dealt = self.spark.createDataFrame([(r["part"], -(-r["asks"] // QUERY_BLOCK), blocks[r["part"]]) for r in sizes], "part int, n_q int, n_c int")
        mine = lambda n: F.pmod(F.xxhash64("refid"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["refid", "langid", "p", "s"]
        left = asked.join(F.broadcast(dealt), "part").select(*columns, "kin", "part", mine("n_q").alias("bq"), each("n_c").alias("bc"))
        rows = self.rows([p for p, _ in places]).join(F.broadcast(self.spark.createDataFrame(places, "part int, g int")), "part").withColumn("part", F.col("g"))
        right = rows.join(F.broadcast(dealt), "part").select(*columns, "part", mine("n_c").alias("bc"), each("n_q").alias("bq"))
        keys = ["part", "bq", "bc"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest_in_blocks(k, alpha, exclude_language, penalty), FOUND)

    def search(self, queries: DataFrame, k: int | None, alpha: float = 0.4, exclude_language: bool = True, penalty: float = 0.0, read: list | None = None) -> DataFrame:
        """(q, refid, langid, dist, rank): what similarity.nearest gives over all rows of the index, ties included.

        penalty is 0 or more. A query that finds fewer than k rows in its first parts (its own
        language may fill them) reads all others too. read: gets the numbers of (query, part) pairs
        that were read, and of all there are.
        """
        if penalty < 0:
            raise ValueError("a penalty below 0 would bring rows nearer than their part's bound")
        if "kin" not in queries.columns:
            queries = queries.withColumn("kin", F.lit(None).cast("array<long>"))
        queries = kept(queries.select("refid", "langid", unit(F.col("p")).alias("p"), unit(F.col("s")).alias("s"), "kin"))
        if not len(self.centers.part):
            return self.spark.createDataFrame([], FOUND + ", rank long")
        asked = kept(self._asked(queries, k, alpha, False))
        found = kept(self._scan(asked, k, alpha, exclude_language, penalty))
        if k is not None:
            order = F.row_number().over(Window.partitionBy("q").orderBy("dist", "refid"))
            kth = found.withColumn("place", order).where(F.col("place") == k).select(F.col("q").alias("refid"), F.col("dist").alias("kth"))
            more = kept(self._asked(queries.join(kth, "refid", "left"), k, alpha, True))
            found = found.unionByName(self._scan(more, k, alpha, exclude_language, penalty))
            if read is not None:
                sizes = self.spark.createDataFrame([(g, int(n)) for g, n in enumerate(np.bincount(self.group))], "part int, parts int")
                both = asked.select("part").union(more.select("part")).join(F.broadcast(sizes), "part")
                read += [both.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0], queries.count() * len(self.centers.part)]
        return ranked(found, k)
