"""Exact vector search of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.runtime import materialise

#: Rows of a product tile, and queries that are ranked at once.
BLOCK, STRIP = 4096, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is null, empty or all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


#: Bytes of query vectors that every task holds at most; more are searched in as many passes over the rows.
HELD = 64 << 20


def block_search(queries: DataFrame, rows: DataFrame, k: int, dim: int, held: int = HELD) -> DataFrame:
    """(query, id, score, rank 1..k): for every query the k rows of largest dot product, ties by id.

    Both inputs have (id long, v array<double>). A pass broadcasts at most `held` bytes of queries and streams
    the rows past them once; a task keeps the k best of its rows for every query, so only those lists are
    shuffled. Queries beyond that are split by hash into more passes. Rows with a null id, null elements or
    another length are left out.
    """
    spark = rows.sparkSession
    good = lambda df: df.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull()) & F.col("id").isNotNull()).select("id", F.col("v").cast("array<double>"))
    left = good(queries)
    passes = max(1, -(-left.count() * dim * 8 // held))
    if passes > 1:
        left, rows = materialise(left, "queries"), materialise(good(rows), "rows")

    def matrix(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([b.column(0).to_numpy() for b in batches] or [np.empty(0, np.int64)])
        flat = [b.column(1).flatten().to_numpy(zero_copy_only=False) for b in batches]
        return ids, np.concatenate(flat or [np.empty(0)]).reshape(-1, dim)

    def search(n: int) -> DataFrame:
        part = left.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == n) if passes > 1 else left
        shared = spark.sparkContext.broadcast(matrix(part.toArrow().to_batches()))  # at most `held` bytes, give or take the hash

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, x = shared.value
            if not len(asked):
                return
            best = np.full((len(asked), k), -np.inf)
            who = np.full((len(asked), k), np.iinfo(np.int64).max)
            for batch in batches:
                ids, y = matrix([batch])
                for at in range(0, len(y), BLOCK):
                    names, z = ids[at : at + BLOCK], y[at : at + BLOCK]
                    for q in range(0, len(asked), STRIP):
                        part = slice(q, q + STRIP)
                        scores = np.concatenate([best[part], np.round(x[part] @ z.T, 12)], axis=1)
                        ahead = np.concatenate([who[part], np.broadcast_to(names, (len(scores), len(names)))], axis=1)
                        order = np.lexsort((ahead, -scores), axis=1)[:, :k]
                        best[part], who[part] = np.take_along_axis(scores, order, 1), np.take_along_axis(ahead, order, 1)
            for q in range(0, len(asked), STRIP):
                row, col = np.nonzero(np.isfinite(best[q : q + STRIP]))
                yield pa.RecordBatch.from_arrays([pa.array(asked[q + row], pa.int64()), pa.array(who[q + row, col], pa.int64()), pa.array(best[q + row, col])], names=["query", "id", "score"])

        return (good(rows) if passes == 1 else rows).mapInArrow(run, "query long, id long, score double")

    found = reduce(DataFrame.unionByName, [search(n) for n in range(passes)])
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unit(v: Column) -> Column:
    """v over its length plus 1e-12."""
    d = v.cast("array<double>")
    size = F.sqrt(dot(d, d)) + 1e-12
    return F.transform(d, lambda x: x / size)
