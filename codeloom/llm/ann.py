"""Nearest neighbours by cosine with a hash-prefix forest.

Each tree gives every vector a string of sign bits of random projections and keeps the strings sorted. A query descends
each tree to its longest matching prefix; all trees then ascend together, one bit at a time, so that the ranges that share
a shorter prefix join, until enough candidates are there. Candidates are ranked by exact cosine in double precision.

Rows are dealt by hash into blocks that fit a task, each with a forest of its own, and queries into blocks too: each pair of
blocks is one group, so that neither side has to fit one machine. On directions without structure in many dimensions any
such index has to look at a good part of the rows: the share it looks at is `share`, for every block alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch

TREES, BITS = 48, 32


class Forest:
    """Sorted arrays of `bits`-bit strings, one for each tree, over unit vectors."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        self.unit, self.bits = unit.astype(np.float32), bits
        planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], trees * bits)).astype(np.float32)
        self.planes = planes
        strings = self._strings(self.unit)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def _strings(self, unit: np.ndarray) -> np.ndarray:
        """(trees, rows) of strings as integers, first bit highest."""
        out = np.zeros((self.planes.shape[1] // self.bits, len(unit)), np.uint64)
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        for t in range(len(out)):
            signs = unit @ self.planes[:, t * self.bits : (t + 1) * self.bits] > 0
            out[t] = (signs * weights).sum(axis=1, dtype=np.uint64)
        return out

    def candidates(self, queries: np.ndarray, least: int):
        """For each query the rows of all trees that share its prefix of the longest length with `least` entries in all."""
        strings = self._strings(queries.astype(np.float32))
        trees, n = strings.shape
        low, high = np.zeros((trees, n), np.int64), np.full((trees, n), len(self.unit), np.int64)
        open_ = np.ones(n, bool)
        for length in range(self.bits, -1, -1):  # descend to the longest matches first, then all trees go up together
            rest = np.uint64(self.bits - length)
            at = np.flatnonzero(open_)
            if not len(at):
                break
            for t in range(trees):
                first = strings[t, at] >> rest << rest
                low[t, at] = np.searchsorted(self.strings[t], first, "left")
                high[t, at] = np.searchsorted(self.strings[t], first + (np.uint64(1) << rest) - np.uint64(1), "right")
            open_[at] = (high[:, at] - low[:, at]).sum(axis=0) < least
        for i in range(n):
            mark = np.zeros(len(self.unit), bool)
            for t in range(trees):
                mark[self.order[t, low[t, i] : high[t, i]]] = True
            yield np.flatnonzero(mark)


def nearest_in(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float, **forest) -> list[tuple[int, int, float]]:
    """(query id, id, cosine) of the k best candidates of each query among one block; ties to the smaller id."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors / norms[:, None]
    qn = np.sqrt((queries * queries).sum(axis=1))
    trees = Forest(unit, **forest)
    least = max(20 * len(trees.order), int(np.ceil(share * len(ids) * len(trees.order))))  # some rows a tree at least
    out = []
    for i, found in enumerate(trees.candidates(queries / qn[:, None], least)):
        found = found[ids[found] != query_ids[i]]
        if len(found) > 8 * k + 64:  # single precision first; what could still win stays by a margin
            rough = trees.unit[found] @ (queries[i] / qn[i]).astype(np.float32)
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-4]
        score = (vectors[found] * queries[i]).sum(axis=1) / (norms[found] * qn[i])
        best = np.lexsort((ids[found], -score))[:k]
        out += [(int(query_ids[i]), int(ids[found[b]]), float(score[b])) for b in best]
    return out


def nearest(rows: DataFrame, is_query: Column, scratch: Scratch, k: int = 5, share: float = 0.02, block: int = 50_000, query_block: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row among all other rows (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id, nor vectors
    of another length than the commonest; rows that repeat a vec_id count as one, with the least vector. With fewer than k
    candidates all come; an empty table gives no rows.

    share: the trees ascend until their ranges hold this part of a block's rows on average; as trees overlap little
    until then, about share * trees of a block is looked at. A block of rows is sent once for each block of queries and held once
    by a task (about 70 MB with 64 dimensions), so large query blocks mean few copies.
    """
    number = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = rows.withColumn("v", number).where(good).groupBy("vec_id").agg(F.min("v").alias("v"))
    table = scratch.table(clean.withColumn("dims", F.size("v")), "vectors")
    common = table.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table, n = table.where(F.col("dims") == common["dims"]), common["count"]
    n_queries = table.where(is_query).count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    queries = table.where(is_query).withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    base = table.withColumn("b", deal).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]) if t.num_rows else np.zeros(0)
        return t.column("vec_id").to_numpy(), flat.reshape(t.num_rows, -1)

    def search(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pydict({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, vectors = matrix(left)
        found = nearest_in(ids, vectors, *matrix(right), k, share)
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.Table.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    pairs = base.groupBy("b", "q").cogroup(queries.groupBy("b", "q")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_prefix_forest(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), "embedding")
    return nearest(rows, F.col("vec_id") % 50 == 0, Scratch(spark, "ann"))
