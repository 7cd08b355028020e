"""Collections, corpora and models as tables below one folder, and the raw query surface."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.procurement import searchable
from acervo.operators.retrieval import keyword, page
from acervo.sources.sinks import upsert

_META = "name string, kind string, fields array<string>, displayed array<string>, searchable array<string>, models array<string>"


class Missing(KeyError):
    """The collection doesn't exist."""


class Exists(ValueError):
    """The collection exists already."""


class Catalog:
    """A table per collection; `_catalog` has a row for each. Rewrites go to a new version folder and
    the row of the catalogue points to it, so readers never see a table half written."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(v[2:]) for v in found if v.startswith("v=") and self._fs.exists(self._path(f"{self.root}/{name}/{v}/_SUCCESS")))

    def _write(self, name: str, df: DataFrame) -> None:
        versions = self._versions(name)
        df.write.parquet(f"{self.root}/{name}/v={(versions or [0])[-1] + 1}")
        for v in versions[:-1]:
            self._fs.delete(self._path(f"{self.root}/{name}/v={v}"), True)

    def _meta(self) -> DataFrame:
        versions = self._versions("_catalog")
        return self.spark.read.schema(_META).parquet(f"{self.root}/_catalog/v={versions[-1]}") if versions else self.spark.createDataFrame([], _META)

    def _row(self, name: str, kind: str, df: DataFrame, displayed=(), fields=(), models=()) -> DataFrame:
        return self.spark.createDataFrame([(name, kind, df.columns, list(displayed), list(fields), list(models))], _META)

    def exists(self, name: str, kind: str | None = None) -> bool:
        rows = self._meta().where(F.col("name") == name)
        return bool((rows.where(F.col("kind") == kind) if kind else rows).limit(1).count())

    def list(self, kind: str | None = None) -> list[str]:
        rows = self._meta()
        return sorted(r[0] for r in (rows.where(F.col("kind") == kind) if kind else rows).select("name").collect())  # names of collections

    def read(self, name: str) -> DataFrame:
        if not (versions := self._versions(name)) or not self.exists(name):
            raise Missing(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v={versions[-1]}")

    def create(self, name: str, df: DataFrame, kind: str = "collection", displayed: tuple[str, ...] = (), searchable_fields: tuple[str, ...] = ()) -> None:
        if self.exists(name):
            raise Exists(name)
        self._write(name, df)
        self._write("_catalog", self._meta().unionByName(self._row(name, kind, df, displayed, searchable_fields)))

    def delete(self, name: str) -> None:
        """Removes a collection; a corpus takes its models with it."""
        rows = self._meta().where(F.col("name") == name).collect()  # one row
        if not rows:
            raise Missing(name)
        gone = [name, *(rows[0]["models"] if rows[0]["kind"] == "corpus" else [])]
        left = self._meta().where(~F.col("name").isin(gone))
        left = left.withColumn("models", F.array_except("models", F.array(*map(F.lit, gone))))
        self._write("_catalog", left)
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)

    # corpora -------------------------------------------------------------------------------

    def index_corpus(self, name: str, df: DataFrame, roles: dict[str, str], displayed: tuple[str, ...], searchable_fields: tuple[str, ...]) -> None:
        """roles maps id, title and date to their columns; a column already called id is kept as
        id_original. The searchable text is the join of the named fields."""
        if roles.get("id", "id") != "id" and "id" in df.columns:
            df = df.withColumnRenamed("id", "id_original")
        df = df.withColumnsRenamed({v: k for k, v in roles.items()})
        self.create(name.lower(), df.withColumn("searchable", searchable(*[F.col(f) for f in searchable_fields])), "corpus", displayed, searchable_fields)

    def upsert(self, name: str, changes: DataFrame, key: str = "id") -> None:
        self._write(name, upsert(self.read(name), changes, key))

    def add_field(self, name: str, field: str, value: Column) -> None:
        self._write(name, self.read(name).withColumn(field, value))

    def drop_field(self, name: str, field: str) -> None:
        self._write(name, self.read(name).drop(field))

    def set_searchable(self, name: str, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> None:
        """Changes the searchable fields and rebuilds the searchable text."""
        if not self.exists(name, "corpus"):
            raise Missing(name)
        old = self.describe(name)["searchable"]
        new = [f for f in dict.fromkeys([*old, *add]) if f not in remove]
        self._write(name, self.read(name).withColumn("searchable", searchable(*[F.col(f) for f in new]) if new else F.lit("")))
        self._write("_catalog", self._meta().withColumn("searchable", F.when(F.col("name") == name, F.array(*map(F.lit, new)).cast("array<string>")).otherwise(F.col("searchable"))))

    def describe(self, name: str) -> dict:
        rows = self._meta().where(F.col("name") == name).collect()  # one row
        if not rows:
            raise Missing(name)
        return rows[0].asDict()

    # models ----------------------------------------------------------------------------------

    def index_model(self, name: str, corpus: str, topics: DataFrame) -> None:
        if not self.exists(corpus, "corpus"):
            raise Missing(corpus)
        self.create(name, topics, "model")
        self._write("_catalog", self._meta().withColumn("models", F.when(F.col("name") == corpus, F.array_union("models", F.array(F.lit(name)))).otherwise(F.col("models"))))

    def granularities(self, corpus: str) -> DataFrame:
        """(cpv, low, high): smallest and largest number of topics of the corpus' models, read from names
        `iteration_cpv_topics_topics`."""
        rows = self._meta().where(F.col("name") == corpus).select(F.explode("models").alias("m"))
        p = r"^[^_]*_(.+)_(\d+)_topics$"
        return rows.where(F.col("m").rlike(p)).groupBy(F.regexp_extract("m", p, 1).alias("cpv")).agg(F.min(F.regexp_extract("m", p, 2).cast("int")).alias("low"), F.max(F.regexp_extract("m", p, 2).cast("int")).alias("high"))

    def query(self, name: str, q: str = "*:*", fq: str | None = None, sort: str | None = None, start: int = 0, rows: int | None = None, fl: str | None = None, op: str = "OR") -> DataFrame:
        return raw_query(self.read(name), q, fq, sort, start, rows, fl, op)


_PIECE = re.compile(r"""\s*(AND\b|OR\b|NOT\b|[()]|[\w.]+:(?:"[^"]*"|[\[{][^\]}]*[\]}]|[^\s()]+)|\*:\*|"[^"]*"|[^\s()]+)""")


def parse(q: str, types: dict[str, str], default: str | None = None, op: str = "OR") -> Column:
    """`field:term`, `field:"a phrase"`, `field:*`, `field:[a TO b}`, `*:*`, AND, OR, NOT and brackets as a
    Column; clauses side by side are joined by op. Unknown fields and open brackets are errors."""
    pieces, at = _PIECE.findall(q), 0

    def clause(text: str) -> Column:
        if text == "*:*":
            return F.lit(True)
        name, colon, value = text.partition(":")
        if not colon or text.startswith('"'):
            name, value = default, text
        if name not in types:
            raise ValueError(f"unknown field: {name}")
        c = F.col(f"`{name}`")
        if value == "*":
            return c.isNotNull()
        if m := re.fullmatch(r"([\[{])\s*(\S+)\s+TO\s+(\S+)\s*([\]}])", value):
            low, high = (None if x == "*" else F.lit(x.strip('"').removesuffix("Z")).cast(types[name]) for x in m.group(2, 3))
            test = F.lit(True) if low is None else (c >= low if m[1] == "[" else c > low)
            return test & (F.lit(True) if high is None else (c <= high if m[4] == "]" else c < high)) & c.isNotNull()
        if types[name].startswith("array"):
            return F.array_contains(c, value.strip('"'))
        return F.coalesce(keyword(c, value) if types[name] == "string" and name != "id" else c == F.lit(value.strip('"')).cast(types[name]), F.lit(False))

    def atom() -> Column:
        nonlocal at
        if at >= len(pieces):
            raise ValueError(f"query ends early: {q!r}")
        piece = pieces[at]
        at += 1
        if piece == "NOT":
            return ~atom()
        if piece == "(":
            inside = either()
            if at >= len(pieces) or pieces[at] != ")":
                raise ValueError(f"open bracket: {q!r}")
            at += 1
            return inside
        return clause(piece)

    def both() -> Column:
        nonlocal at
        found = atom()
        while at < len(pieces) and pieces[at] != ")" and pieces[at] != "OR" and (pieces[at] == "AND" or op == "AND"):
            at += pieces[at] == "AND"
            found = found & atom()
        return found

    def either() -> Column:
        nonlocal at
        found = both()
        while at < len(pieces) and pieces[at] != ")":
            at += pieces[at] == "OR"
            found = found | both()
        return found

    out = either()
    if at < len(pieces):
        raise ValueError(f"unexpected {pieces[at]!r} in {q!r}")
    return out


def raw_query(df: DataFrame, q: str = "*:*", fq: str | None = None, sort: str | None = None, start: int = 0, rows: int | None = None, fl: str | None = None, op: str = "OR") -> DataFrame:
    types = dict(df.dtypes)
    out = df.where(parse(q, types, "searchable", op))
    if fq:
        out = out.where(parse(fq, types, "searchable", op))
    if sort:
        order = []
        for part in sort.split(","):
            name, _, way = part.strip().rpartition(" ")
            if way not in ("asc", "desc") or name not in types:
                raise ValueError(f"wrong sort: {part!r}")
            order.append(F.col(name).asc_nulls_last() if way == "asc" else F.col(name).desc_nulls_last())
        out = page(out, [*order, *([F.col("id").asc()] if "id" in types else [])], start, rows)  # id breaks ties, so pages don't overlap
    elif start or rows is not None:
        out = page(out, [F.col("id")] if "id" in types else [], start, rows)
    return out.select(*[c.strip() for c in fl.split(",") if c.strip() in types]) if fl else out
