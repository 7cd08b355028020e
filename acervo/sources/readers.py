"""Readers for the formats records arrive in. All are lazy Spark scans; none collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def json_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A JSON array of records or JSON lines: the first character decides."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    reader = spark.read.option("multiLine", bool(head) and head[0][0].lstrip().startswith("["))
    return (reader.schema(schema) if schema else reader).json(path)


def by_extension(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """.parquet, .json, .jsonl, .csv, .tsv, .orc; anything else is an error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind in ("json", "jsonl"):
        return json_records(spark, path, schema)
    if kind in ("csv", "tsv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",")
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"unknown format: {path}")


def instances(df: DataFrame, key: str, order: str) -> DataFrame:
    """Records by text key, the last of equal keys wins; null keys are dropped."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def line_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, tokens) of lines `id 0 tokens` or `id<tab>0<tab>tokens`; other lines are dropped."""
    p = r"^(\S+)\s+0\s+(.*)$"
    return spark.read.text(path).where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("id"), F.regexp_extract("value", p, 2).alias("tokens"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def equivalences(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of lines `a:b`."""
    parts = F.split("value", ":")
    return spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("source"), F.trim(parts[1]).alias("target"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of all files below, recursively."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def matrix(spark: SparkSession, path: str, pattern: str = "*.np[yz]") -> DataFrame:
    """(path, row, col, x): the cells of npy files (all of them) and of npz files with a compressed sparse row matrix
    (those it holds), a file in a task."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = np.load(io.BytesIO(content))
                if isinstance(held, np.ndarray):
                    rows, cols = np.indices(np.atleast_2d(held).shape).reshape(2, -1)
                    x = np.atleast_2d(held).ravel()
                else:
                    rows, cols, x = np.repeat(np.arange(len(held["indptr"]) - 1), np.diff(held["indptr"])), held["indices"], held["data"]
                for at in range(0, len(x), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x[part])), pa.array(rows[part].astype(np.int64)), pa.array(cols[part].astype(np.int64)), pa.array(x[part].astype(float))], names=["path", "row", "col", "x"])

    return files(spark, path, pattern).select("path", "content").mapInArrow(run, "path string, row long, col long, x double")


def spreadsheet(spark: SparkSession, path: str, rows: int = 30) -> DataFrame:
    """(path, row, col, value): the first rows of the first sheet of xlsx files, as text, a file in a task."""
    import io
    import re
    import zipfile
    from collections.abc import Iterator
    from xml.etree import ElementTree

    import pyarrow as pa

    def cells(content: bytes) -> Iterator[tuple[int, int, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = book.namelist()
            shared = ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
            texts = ["".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")) for item in shared]
            sheet = ElementTree.fromstring(book.read(min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))))
        for cell in (e for e in sheet.iter() if e.tag.endswith("}c")):
            letters, number = re.fullmatch(r"([A-Z]+)(\d+)", cell.attrib["r"]).groups()
            col = 0
            for letter in letters:
                col = 26 * col + ord(letter) - 64
            value = "".join(t.text or "" for t in cell.iter() if t.tag.endswith(("}v", "}t")))
            if int(number) <= rows and value:
                yield int(number) - 1, col - 1, texts[int(value)] if cell.attrib.get("t") == "s" else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(cells(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["path", "row", "col", "value"])

    return files(spark, path, "*.xlsx").select("path", "content").mapInArrow(run, "path string, row long, col long, value string")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with joined names."""

    def walk(schema: T.StructType, at: Column | None, name: str) -> list[Column]:
        out = []
        for f in schema.fields:
            c = F.col(f"`{f.name}`") if at is None else at[f.name]
            full = f"{name}{sep}{f.name}" if name else f.name
            out += walk(f.dataType, c, full) if isinstance(f.dataType, T.StructType) else [c.alias(full)]
        return out

    return df.select(*walk(df.schema, None, ""))
