"""Text encoders and other models as injected callables, with deterministic defaults.

A callable takes a list of texts and gives a list (or matrix) of as many results; it runs in Arrow
batches in the executors. Results of model calls can be kept in a table and are then not asked for again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.operators.retrieval import tokens

DIM = 64
_TOKEN = re.compile(r"[^\W]+")


def _place(token: Column, dim: int) -> tuple[Column, Column]:
    digest = F.md5(token.cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % dim, F.when(F.substring(digest, 8, 1) >= "8", -1).otherwise(1)


def hashed_cells(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """(keys, i, x): the default encoding as sparse unit vectors: every word token adds its sign to its place,
    both by digest. Texts without tokens have no cells; so have vectors that cancel out."""
    bag = df.select(*keys, F.explode(tokens(F.col(text))).alias("t"))
    at, sign = _place(F.col("t"), dim)
    cells = bag.select(*keys, at.alias("i"), sign.alias("s")).groupBy(*keys, "i").agg(F.sum("s").cast("double").alias("x")).where("x <> 0")
    size = cells.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
    return cells.join(size, keys).select(*keys, "i", (F.col("x") / F.col("_n")).alias("x"))


def hashed_counts(df: DataFrame, keys: list[str], text: str, dim: int = DIM, known: int = 200_000) -> DataFrame:
    """(keys, v): the default encoding before it is scaled to length 1, of every row with a word, as the bytes of `dim`
    whole numbers (int32). A task keeps the places of at most `known` words it has met."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, int] = {}
        for rows in batches:
            codes, sizes = [], []
            for value in rows.column(len(keys)).to_pylist():
                words = _TOKEN.findall((value or "").lower())
                for word in words:
                    if (code := met.get(word)) is None:
                        if len(met) >= known:
                            met.clear()
                        digest = hashlib.md5(word.encode()).hexdigest()
                        code = met[word] = int(digest[:7], 16) % dim * 2 + (digest[7] >= "8")
                    codes.append(code)
                sizes.append(len(words))
            code, at = np.array(codes, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)
            v = np.bincount(at * dim + code // 2, weights=1 - 2.0 * (code % 2), minlength=len(sizes) * dim).astype(np.int32).reshape(-1, dim)
            there = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([*[rows.column(i).take(pa.array(there)) for i in range(len(keys))], pa.array([v[i].tobytes() for i in there], pa.binary())], names=[*keys, "v"])

    return df.select(*keys, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", v binary")


def hashing(texts: Sequence[str], dim: int = DIM) -> np.ndarray:
    """The default encoder as a callable; the same vectors as hashed_cells."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for token in _TOKEN.findall(text.lower()):
            digest = hashlib.md5(token.encode()).hexdigest()
            row[int(digest[:7], 16) % dim] += -1 if digest[7] >= "8" else 1
    size = np.linalg.norm(out, axis=1)
    return out / np.where(size > 0, size, 1)[:, None]


def encode(df: DataFrame, text: str, encoder: Callable[[Sequence[str]], np.ndarray] = hashing, batch: int = 64, unit: bool = False, out: str = "embedding") -> DataFrame:
    """df with the vectors of a text column, `batch` texts a call, scaled to length 1 if wanted. Null texts have
    null vectors."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index(text)).to_pylist()
            there = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for lot in range(0, len(there), batch):
                part = there[lot : lot + batch]
                found = np.asarray(encoder([texts[i] for i in part]), dtype=float)
                if unit:
                    found = found / (np.linalg.norm(found, axis=1)[:, None] + 1e-12)
                for i, v in zip(part, found.tolist()):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*rows.schema.names, out])

    return df.mapInArrow(run, fields)


def embed(df: DataFrame, text: str, words: DataFrame, key: str, encoder: Callable | None = None, out: str = "embedding") -> DataFrame:
    """df(key, text) with a vector: by the encoder if one is given, else from words(word, v): one word has its
    own vector, several have the mean of those known, none known gives null."""
    if encoder is not None:
        return encode(df, text, encoder, out=out)
    bag = df.select(key, F.explode(tokens(F.col(text))).alias("word"))
    cells = bag.join(words, "word").select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    means = cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(out))
    return df.join(means, key, "left")


def complete(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], cache: str | None = None, name: str = "model", batch: int = 16, out: str = "answer") -> DataFrame:
    """df with a model's answer to a prompt column. Equal prompts are asked once; with `cache`, a folder of
    answers by digest of model name and prompt, those there aren't asked again and new ones are added.
    Null prompts have null answers."""
    spark = df.sparkSession
    key = F.md5(F.concat_ws("\x1f", F.lit(name), F.col("_prompt")))
    asked = df.select(F.col(f"`{prompt}`").alias("_prompt")).where("_prompt IS NOT NULL").distinct().withColumn("_key", key)
    known = None
    if cache is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            known = spark.read.schema("_key string, _answer string").parquet(cache)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, answers = rows.column(1).to_pylist(), []
            for lot in range(0, len(texts), batch):
                answers += model(texts[lot : lot + batch])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(answers, pa.string())], names=["_key", "_answer"])

    new = (asked if known is None else asked.join(known, "_key", "left_anti")).select("_key", "_prompt").mapInArrow(run, "_key string, _answer string")
    if cache is not None:
        new.write.mode("append").parquet(cache)
        new = spark.read.schema("_key string, _answer string").parquet(cache)
    answers = asked.join(new, "_key").select("_prompt", F.col("_answer").alias(out))
    return df.join(answers, F.col(f"`{prompt}`") == F.col("_prompt"), "left").drop("_prompt")


def translate(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[str]], most: int = 1536, cache: str | None = None, out: str = "translated") -> DataFrame:
    """df with translated texts: sentences packed into pieces, every distinct piece translated once, joined
    by spaces in order. Null texts stay null."""
    from acervo.functions.objective import sentence_pieces

    parts = df.select(key, F.posexplode(sentence_pieces(F.col(text), most)).alias("_at", "_piece"))
    done = complete(parts, "_piece", model, cache, "translate", out="_done")
    joined = done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_done"))), lambda e: F.trim(e["_done"])), " ").alias(out))
    return df.join(joined, key, "left").withColumn(out, F.when(F.col(text).isNotNull(), F.coalesce(out, F.lit(""))))
