"""Continuous ingestion: a stream of records into a latest-wins table and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acervo.operators.latest import latest

#: Buckets a table is kept in, by the hash of the key.
BUCKETS = 64


class Buckets:
    """A latest-wins table in a folder per hash bucket of the key. A merge rewrites the buckets its rows fall
    into, each as a new version; the file of versions is written last, so readers see whole merges."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), key, order, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> version, of the newest complete file of versions (before a version, if given)."""
        at = self._path(f"{self.root}/versions")
        done = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        done = sorted(int(n[2:]) for n in done if n.startswith("v=") and self._fs.exists(self._path(f"{self.root}/versions/{n}/_SUCCESS")) and (before is None or int(n[2:]) < before))
        return {r[0]: r[1] for r in self.spark.read.parquet(f"{self.root}/versions/v={done[-1]}").collect()} if done else {}  # a row per bucket

    def read(self) -> DataFrame | None:
        """The table; None before the first merge."""
        versions = self._versions()
        paths = [f"{self.root}/rows/v={v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, version: int) -> None:
        """The newest row per key of the table and the batch; running a version again gives the same table."""
        versions = self._versions(version)
        keep = [c for c in batch.columns if c not in (self.key, self.order)]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        newest = latest(batch, [self.key], [self.order], keep).withColumn("bucket", bucket)
        touched = [r[0] for r in newest.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        old = [f"{self.root}/rows/v={versions[b]}/bucket={b}" for b in touched if b in versions]
        both = newest.drop("bucket") if not old else newest.drop("bucket").unionByName(self.spark.read.schema(newest.drop("bucket").schema).parquet(*old))
        merged = latest(both, [self.key], [self.order], keep).select(*batch.columns).withColumn("bucket", bucket)
        merged.repartition("bucket", F.pmod(F.hash(self.key), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/v={version}")
        versions |= {b: version for b in touched}
        self.spark.createDataFrame(list(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/v={version}")


def ingest(stream: DataFrame, table: Buckets, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is reduced to its newest row per key and merged with the buckets it touches, so late
    and repeated records change nothing; a batch that is run again gives the same table."""
    return stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n, total) per tumbling window; rows later than the watermark are left out."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def run_windows(spark: SparkSession, source: str, out: str, checkpoint: str, late: str = "10 minutes") -> None:
    """What has come into the source folder since the last run, counted by hour in append mode into `out`."""
    rows = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(source)
    counts = windowed_counts(rows, "ts", "event_type", "value", late=late)
    counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
