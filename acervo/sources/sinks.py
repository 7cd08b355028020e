"""Writers and table maintenance: upsert, delete, partial update, partitioned and resumable sinks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.operators.latest import latest


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """base with rows of equal key replaced by those of changes; columns missing on a side are null. Of changes
    with one key the one of largest `order` counts, then (and without an order) the largest in its
    columns; null keys are dropped. Rows of base are as given."""
    newest = latest(changes, [key], [order] if order else [], [c for c in changes.columns if c not in (key, order)])
    return base.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def partial_update(base: DataFrame, changes: DataFrame, key: str, actions: dict[str, str]) -> DataFrame:
    """changes(key, field, ...) applied to the fields of actions: `set` replaces, also by null where the
    change row exists; `add` and `remove` change an array field."""
    c = changes.select(key, *[F.col(f).alias(f"_{f}") for f in actions], F.lit(True).alias("_hit"))
    met = base.join(c, key, "left")
    empty = lambda f: F.coalesce(F.col(f), F.array().cast(dict(base.dtypes)[f]))
    for f, how in actions.items():
        if how == "set":
            new = F.when(F.col("_hit"), F.col(f"_{f}")).otherwise(F.col(f))
        elif how == "add":
            new = F.when(F.col(f"_{f}").isNotNull(), F.array_union(empty(f), F.col(f"_{f}"))).otherwise(F.col(f))
        elif how == "remove":
            new = F.when(F.col(f"_{f}").isNotNull(), F.array_except(empty(f), F.col(f"_{f}"))).otherwise(F.col(f))
        else:
            raise ValueError(f"unknown action: {how}")
        met = met.withColumn(f, new)
    return met.select(*base.columns)


def write_parquet(df: DataFrame, path: str, rows_per_file: int | None = None, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_ranked_folders(df: DataFrame, key: str, path: str) -> None:
    """A folder per key, numbered by falling row count (`idx=0` is the largest; ties by key). The keys
    are few enough to be folders."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    idx = sizes.select(key, (F.row_number().over(Window.orderBy(F.desc("_n"), key)) - 1).alias("idx"))
    df.join(F.broadcast(idx), key).write.mode("overwrite").partitionBy("idx", key).parquet(path)  # one row per folder


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("sep", sep).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def annotations_wide(votes: DataFrame, user: str, instance: str, schema: str, label: str, value: str, known: list[tuple[str, str]]) -> DataFrame:
    """One row per user and instance, a column `schema:::label` for each known pair."""
    name = F.concat(F.col(schema), F.lit(":::"), F.col(label))
    return votes.withColumn("_c", name).groupBy(user, instance).pivot("_c", [f"{a}:::{b}" for a, b in known]).agg(F.max(value))


def insert_new(there: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose keys aren't there; null keys are never there."""
    return new.join(there.select(*keys).distinct(), keys, "left_anti")


def fill_pending(rows: DataFrame, results: DataFrame, key: str, value: str, result: str, states: tuple[str, ...]) -> DataFrame:
    """rows whose value is one of the waiting states take the result of their key, if there is one."""
    met = rows.join(results.select(key, F.col(result).alias("_result")), key, "left")
    return met.withColumn(value, F.when(F.col(value).isin(*states) & F.col("_result").isNotNull(), F.col("_result")).otherwise(F.col(value))).drop("_result")


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, name: str, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those whose name is in gone(name), and children without those of these parents."""
    lost = parents.join(gone.select(name), name, "left_semi").select(F.col(key).alias(foreign)).distinct()
    return parents.join(gone.select(name), name, "left_anti"), children.join(lost, foreign, "left_anti")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of work not yet in the ledger; running twice does nothing twice."""
    return work.join(done.select(key), key, "left_anti")


def same_rows(spark: SparkSession, ledger: str, work: DataFrame) -> bool:
    """Whether the ledger at this path is there with as many rows as the work, so that the job may be skipped."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(ledger + "/_SUCCESS")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return there and spark.read.parquet(ledger).count() == work.count()


def run_batch(work: DataFrame, ledger: str, key: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step over what the ledger at this path lacks, appended to it; the whole ledger is returned."""
    spark = work.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(ledger)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    todo = pending(work, spark.read.parquet(ledger), key) if exists else work
    step(todo).write.mode("append").parquet(ledger)
    done = spark.read.parquet(ledger)
    if (missing := pending(work, done, key).count()) != 0:
        raise RuntimeError(f"{missing} rows are missing in {ledger}")
    return done


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
