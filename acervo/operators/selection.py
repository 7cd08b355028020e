"""Greedy selection of context under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(nodes: DataFrame, key: str, budget: int, gap: int, drop: float, least: int, most: int) -> DataFrame:
    """nodes(key, idx, score, size) -> (key, order, idx): per document the nodes by falling score, ties by
    idx, while a node is at least `gap` places from those taken, its score at least `drop` times the one
    taken before (once `least` are taken), the sizes fit the budget and fewer than `most` are taken.

    A fold over all candidates of the document, inside the JVM; they are gathered in one row, so
    a document's candidates must fit a task's memory.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("idx"))
    rows = nodes.withColumn("_r", F.row_number().over(w)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", F.col("idx").cast("int").alias("idx"), F.col("score").cast("double").alias("score"), F.col("size").cast("int").alias("size")))).alias("n"))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).alias("used"), F.lit(None).cast("double").alias("last"))

    def step(s, x):
        far = F.forall(s["taken"], lambda t: F.abs(t - x["idx"]) >= gap)
        strong = s["last"].isNull() | (F.size(s["taken"]) < least) | (x["score"] >= drop * s["last"])
        ok = far & strong & (s["used"] + x["size"] <= budget) & (F.size(s["taken"]) < most)
        return F.when(ok, F.struct(F.concat(s["taken"], F.array(x["idx"])).alias("taken"), (s["used"] + x["size"]).alias("used"), x["score"].alias("last"))).otherwise(s)

    return rows.select(key, F.posexplode(F.aggregate("n", start, step, lambda s: s["taken"])).alias("order", "idx"))
