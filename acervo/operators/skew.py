"""Hot keys: found by counting, spread by a salt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.runtime import parallelism


class Salted:
    """A key of `rows` and its values that hold more than a quarter of a task's share of all rows: at most
    four for each task, so their list is small. `salt` is a column for the rows, by `by`; `table` gives
    the other side's rows once per salt."""

    def __init__(self, rows: DataFrame, key: str, by: str, least: int, total: int | None = None) -> None:
        self.key, self.by, self.tasks = key, by, max(parallelism(rows.sparkSession), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        most = max(least, (rows.count() if total is None else total) / (4 * self.tasks))
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        self.keys, self.hot = counts.agg(F.count(F.lit(1)), F.collect_list(F.when(F.col("_n") > most, F.col(key)))).first()  # hot: at most 4 a task

    def salt(self) -> Column:
        return F.when(F.col(self.key).isin(self.hot), F.pmod(F.xxhash64(self.by), F.lit(self.tasks))).otherwise(0).cast("int") if self.hot else F.lit(0)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        if not self.hot:
            return df.withColumn(name, F.lit(0))
        salts = F.when(F.col(self.key).isin(self.hot), F.sequence(F.lit(0), F.lit(self.tasks - 1))).otherwise(F.array(F.lit(0)))
        return df.withColumn(name, F.explode(salts))
