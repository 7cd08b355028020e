"""Distributed ranks and prefix sums: no group has to pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str = "rank") -> DataFrame:
    """Row number from 1 within each group, in the order of (bucket, order).

    Rows are numbered within their bucket and moved by the number of rows in earlier buckets of
    the group, so the largest task holds one bucket. `bucket` must follow the wanted order and
    `order` must be total; df is read twice, so it must give the same rows each time (a written
    table, not a random one). Null groups and buckets count as values of their own.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    moved = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return numbered.join(moved, same).withColumn(out, F.col("_row") + F.col("_before")).drop("_row", "_before", *[f"_{k}" for k in keys])
