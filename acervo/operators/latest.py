"""Latest-wins resolution of versioned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the row with the largest `order`, ties by the largest `keep` values.

    A max over a struct, so each task reduces its own rows before the shuffle and a key that
    holds a third of all rows arrives as one row per task. Null order sorts below any value;
    rows with a null key are dropped; columns not named are dropped. Empty in, empty out.
    """
    order = [c for c in order if c not in keys]
    keep = [c for c in keep if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(f"`{c}`") for c in order + keep])).alias("_best")
    out = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best)
    return out.select(*[F.col(f"`{k}`") for k in keys], *[F.col("_best")[c].alias(c) for c in order + keep])
