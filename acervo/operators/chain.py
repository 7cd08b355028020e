"""The retrieval chain over the chunks of documents: dense hits of many queries, keyword hits where they are
called for, fusion, reranking, provenance and the selection of a context."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions import objective as O
from acervo.operators import retrieval as R
from acervo.operators.encoders import DIM, hashed_cells, hashed_counts

#: The queries of the retriever and the keywords of the second one.
QUERIES = (
    "objeto del contrato", "objeto del pliego", "tiene por objeto", "descripción del objeto del contrato", "finalidad del contrato",
    "objeto del procedimiento de contratación", "objetivos del contrato", "objeto de la contratación", "objeto del proyecto",
    "definir las obras de", "proyecto de ejecución", "servicio de suministro", "ejecución de obras", "mejora de vías urbanas", "suministro de",
)
KEYWORDS = (
    "objeto", "objecte", "obxecto", "xede", "contrato", "contracte", "plec", "pliego", "prego", "ejecución", "execució", "execución", "exekuzio",
    "proyecto", "projecte", "proxecto", "proiektua", "servicio", "servei", "servizo", "zerbitzu", "suministro", "subministrament", "subministración",
    "hornidura", "obras", "obres", "obrak", "mejora", "millora", "mellora", "hobekuntza", "vías", "vies", "viais", "bideak", "viales", "urbanas",
    "urbanes", "urbanos", "hiritar",
)
#: Confidence and length that call for keywords, most keyword hits, penalty of noisy ones, pool and base scores.
CONFIDENT, LONG, MOST_HITS, PENALTY, POOL, WINDOW_SCORE, POOL_SCORE = 0.35, 120, 5, 0.6, 3, 0.25, 0.3
#: Most chunks of a context.
MOST = 9


def per_query(chunks: Column) -> Column:
    """Hits of a query: at least 3, at most 6 and what a context holds of a document."""
    return F.greatest(F.lit(3), F.least(F.lit(6), F.least(chunks, F.lit(MOST))))


def dense(nodes: DataFrame, queries: Sequence[str] = QUERIES, key: str = "doc_id", dim: int = DIM) -> DataFrame:
    """(key, idx, query, score): the cosine of a chunk and a query where they share a place. nodes(key, idx,
    text). The queries are a fixed list, so their cells are broadcast."""
    spark = nodes.sparkSession
    asked = hashed_cells(spark.createDataFrame(list(enumerate(queries)), "query int, text string"), ["query"], "text", dim).withColumnRenamed("x", "y")
    return hashed_cells(nodes, [key, "idx"], "text", dim).join(F.broadcast(asked), "i").groupBy(key, "idx", "query").agg(F.sum(F.col("x") * F.col("y")).alias("score"))  # at most len(queries) * dim rows


def by_example(nodes: DataFrame, examples: DataFrame, key: str = "doc_id", dim: int = DIM, length: int = 250) -> DataFrame:
    """(key, idx, score): chunks against the first `length` characters of their document's own example(key, text);
    those that share a place. Rows of the same key count as one text. A vector is one row of bytes and moves once."""
    own = hashed_counts(examples.where(F.col(key).isNotNull()).select(key, F.substring("text", 1, length).alias("text")), [key], "text", dim)
    near = hashed_counts(nodes.where(F.col(key).isNotNull()), [key, "idx"], "text", dim).repartition(key)  # for what follows
    met = near.groupBy(key, "idx").agg(F.collect_list("v").alias("a")).join(own.groupBy(key).agg(F.collect_list("v").alias("b")), key)

    def summed(column: pa.Array) -> np.ndarray:
        v = np.frombuffer(b"".join(column.flatten().to_pylist()), dtype=np.int32).reshape(-1, dim).astype(float)
        return np.add.reduceat(v, np.r_[0, np.cumsum(column.value_lengths().to_numpy())[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            a, b = summed(rows.column(2)), summed(rows.column(3))
            there = np.flatnonzero(((a != 0) & (b != 0)).any(axis=1))
            score = (a * b).sum(axis=1)[there] / (np.linalg.norm(a[there], axis=1) * np.linalg.norm(b[there], axis=1))
            yield pa.RecordBatch.from_arrays([*[rows.column(i).take(pa.array(there)) for i in (0, 1)], pa.array(score)], names=[key, "idx", "score"])

    kinds = dict(nodes.dtypes)
    return met.select(key, "idx", "a", "b").mapInArrow(run, f"`{key}` {kinds[key]}, idx {kinds['idx']}, score double")


def ranked(scores: DataFrame, by: list[str], out: str = "rank") -> DataFrame:
    return scores.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "idx")))


def fuse_queries(scores: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, score): of every query the best chunks of a document with a score above 0, of every chunk
    its best score. sizes(key, n)."""
    hits = ranked(scores.where(F.round("score", 9) > 0), [key, "query"]).join(sizes, key).where(F.col("rank") <= per_query(F.col("n")))
    return hits.groupBy(key, "idx").agg(F.max("score").alias("score"))


def keyword_hits(nodes: DataFrame, words: Sequence[str] = KEYWORDS, key: str = "doc_id", most: int = MOST_HITS, penalty: float = PENALTY) -> DataFrame:
    """(key, idx, score): BM25 of the chunks of each document, the document being the collection, for its
    best chunks. Punctuation is blanked before; chunks that look like contents, machinery or leaders
    are then worth `penalty` of it."""
    clean = F.regexp_replace(F.lower("text"), r'[:.,"()\n\-]', " ")
    bag = nodes.select(key, "idx", "text", F.filter(F.split(clean, r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    stats = bag.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("w")).alias("_avg"))
    tf = bag.select(key, "idx", F.size("w").alias("_len"), F.explode(F.filter("w", lambda w: w.isin(*words))).alias("t")).groupBy(key, "idx", "_len", "t").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(key, "t").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("_len") / F.col("_avg")))
    best = ranked(tf.join(df, [key, "t"]).join(stats, key).groupBy(key, "idx").agg(F.sum(part).alias("score")), [key]).where(F.col("rank") <= most)
    noisy = F.col("text").rlike(O.TOC) | F.col("text").rlike(O.MACHINERY) | F.col("text").rlike(O.LEADER)
    met = best.join(nodes.select(key, "idx", "text"), [key, "idx"])
    return met.select(key, "idx", F.when(noisy, F.col("score") * penalty).otherwise(F.col("score")).alias("score"))


def gate(sizes: DataFrame, dense_hits: DataFrame, anchored: DataFrame, key: str = "doc_id", enabled: bool = True, on_anchor: bool = False) -> DataFrame:
    """(key, n, top_dense, found, keywords): whether a document calls for keywords: enabled, no snippet found, and
    the best dense score small or the document long. anchored(key, found)."""
    top = dense_hits.groupBy(key).agg(F.max("score").alias("top_dense"))
    rows = sizes.join(top, key, "left").join(anchored, key, "left").select(key, "n", F.coalesce("top_dense", F.lit(0.0)).alias("top_dense"), F.coalesce("found", F.lit(False)).alias("found"))
    called = F.lit(enabled) & ~F.col("found") & ((F.round("top_dense", 9) < CONFIDENT) | (F.col("n") > LONG))
    return rows.withColumn("keywords", called if not on_anchor else F.lit(enabled) & ((F.round("top_dense", 9) < CONFIDENT) | (F.col("n") > LONG)))


def pool(dense_hits: DataFrame, keywords: DataFrame, gates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, score, dense_rank, keyword_rank): where a document calls for keywords and has such hits, both
    lists fused by reciprocal ranks and cut to POOL contexts; else the dense hits."""
    a = ranked(dense_hits, [key], "dense_rank").select(key, "idx", "dense_rank", F.col("score").alias("_dense"))
    b = ranked(keywords.join(gates.where("keywords").select(key), key, "left_semi"), [key], "keyword_rank").select(key, "idx", "keyword_rank")
    both = a.join(b, [key, "idx"], "full")
    fused = both.withColumn("_any", F.max(F.col("keyword_rank").isNotNull()).over(Window.partitionBy(key)))  # the hits of a document
    part = lambda c: 1 / (R.RRF + F.coalesce(F.col(c), F.lit(R.MISSING)))
    rows = fused.select(key, "idx", F.when(F.col("_any"), part("keyword_rank") + part("dense_rank")).otherwise(F.col("_dense")).alias("score"), "dense_rank", "keyword_rank", "_any")
    rows = ranked(rows, [key]).join(gates.select(key, "n"), key)
    return rows.where(~F.col("_any") | (F.col("rank") <= POOL * F.least("n", F.lit(MOST)))).select(key, "idx", "score", "dense_rank", "keyword_rank", "n")


def rerank(pooled: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pool with the weighted score of what was retrieved, purpose, position and noise."""
    met = pooled.join(nodes.select(key, "idx", "text"), [key, "idx"])
    score = R.rerank(F.col("score"), O.purpose(F.col("text")), O.noise(F.col("text")), F.col("idx"), F.col("n"))
    return met.withColumn("base", F.col("score")).withColumn("score", score)


def provenance(pooled: DataFrame, reranked: DataFrame, dense_hits: DataFrame, gates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, keywords, top_before, top_after, top1_source, rerank_changed, keywords_changed): where the first chunk
    comes from and what reranking and keywords changed. Documents without hits have `none` and nulls."""
    first = lambda df, name: ranked(df, [key]).where("rank = 1").select(key, F.col("idx").alias(name))
    hit = reranked.select(key, F.col("idx").alias("top_after"), F.col("keyword_rank").isNotNull().alias("_k"))
    rows = gates.select(key, "keywords").join(first(pooled, "top_before"), key, "left").join(first(reranked, "top_after"), key, "left").join(first(dense_hits, "_dense"), key, "left").join(hit, [key, "top_after"], "left")
    source = F.when(F.col("top_after").isNull(), "none").when(F.col("_k"), "bm25").otherwise("dense")
    changed = (source == "bm25") & F.col("_dense").isNotNull() & (F.col("top_after") != F.col("_dense"))
    return rows.select(key, "keywords", "top_before", "top_after", source.alias("top1_source"), F.coalesce(F.col("top_before") != F.col("top_after"), F.lit(False)).alias("rerank_changed"), F.coalesce(changed, F.lit(False)).alias("keywords_changed"))


def windows(reranked: DataFrame, nodes: DataFrame, key: str = "doc_id", radius: int = 2, narrow: int = 1) -> DataFrame:
    """(key, idx, score, required): the pool with the chunks around the best one that has an anchor, these worth
    WINDOW_SCORE, of equal chunks the best score; those within `narrow` of it are required."""
    anchored = ranked(reranked.where(O.has_anchor(F.col("text"))), [key]).where("rank = 1").select(key, F.col("idx").alias("_at"))
    near = nodes.select(key, "idx").join(anchored, key).where(F.abs(F.col("idx") - F.col("_at")) <= radius)
    added = near.select(key, "idx", F.lit(WINDOW_SCORE).alias("score"), (F.abs(F.col("idx") - F.col("_at")) <= narrow).alias("required"))
    every = reranked.select(key, "idx", F.coalesce("score", F.lit(POOL_SCORE)).alias("score"), F.lit(False).alias("required")).unionByName(added)
    return every.groupBy(key, "idx").agg(F.max("score").alias("score"), F.max("required").alias("required"))


def choose(
    nodes: list[tuple[int, float, str, bool]], fewest: int = 4, most: int = MOST, budget: int = 3500, longest: int = 1200,
    gap: int = 1, drop: float = 0.6, soft: float = 0.85, spread: float = 0.25, joint: int = 2,
) -> list[tuple[int, str]]:
    """A context from (idx, score, text, required): the required chunks first, whatever they cost; then by
    falling score while the rules hold; then more until `fewest` are there, if they fit.

    Scores are scaled to 0..1 (all equal: a half). Once `fewest` are taken a chunk must reach the threshold
    (the larger of the 60th percentile and the mean less `spread` deviations), stand more than `gap` from
    those taken, fit the budget, and not fall below `drop` of the one before when the budget is used to
    `soft`; chunks next to required ones are spared but for the budget. Blank texts are left out.
    """
    low, high = min((s for _, s, _, _ in nodes), default=0.0), max((s for _, s, _, _ in nodes), default=0.0)
    scaled = sorted(((i, (s - low) / (high - low) if high > low else 0.5, t.strip(), r) for i, s, t, r in nodes), key=lambda n: (-n[1], n[0]))
    values = [s for _, s, _, _ in scaled]
    mean = sum(values) / max(1, len(values))
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) if len(values) > 1 else 0.0
    least = max(values[math.ceil(0.4 * (len(values) - 1))], mean - spread * deviation) if values else 0.0
    spared = {i + d for i, _, _, r in scaled if r for d in range(-gap, gap + 1)}
    taken: list[tuple[int, str]] = []
    used, before = 0, None

    def close(i: int) -> bool:
        return any(abs(i - j) <= gap for j, _ in taken)

    def take(i: int, text: str) -> None:
        nonlocal used
        used += len(text) + (joint if taken else 0)
        taken.append((i, text))

    for i, _, text, required in scaled:
        if required and text and len(taken) < most:
            take(i, text)
    for i, score, text, required in scaled:
        enough = len(taken) >= fewest
        if required or not text:
            continue
        if len(taken) >= most or (enough and score < least and i not in spared):
            break
        if enough and i not in spared and close(i):
            continue
        if enough and before is not None and score < drop * max(before, 1e-6) and used > soft * budget and i not in spared:
            break
        text = clipped(text, longest)
        if enough and used + len(text) + joint > budget:
            break
        take(i, text)
        before = score
    there = {i for i, _ in taken}
    for i, _, text, required in scaled:
        if len(taken) >= min(fewest, most):
            break
        if i in there or required or not text or (close(i) and len(taken) + 1 < fewest):
            continue
        text = clipped(text, longest)
        if used + len(text) + (joint if taken else 0) <= budget:
            take(i, text)
    return taken


def clipped(text: str, limit: int, least: float = 0.6) -> str:
    """As objective.clip."""
    import re

    if len(text) <= limit:
        return text
    head = text[:limit]
    whole = re.match(r"(?s)(.*[.!?]\s+)", head) or re.match(r"(?s)(.*?\n\n)", head)
    return whole[1].strip() if whole and len(whole[1]) > least * limit else head.strip()


def contexts(scored: DataFrame, nodes: DataFrame, key: str = "doc_id", **rules: float) -> DataFrame:
    """(key, place, idx, text): the context of every document from scored(key, idx, score, required). A document's
    candidates, at most its pool and a window, pass through one row."""
    met = scored.join(nodes.select(key, "idx", "text"), [key, "idx"])
    packed = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "score", "text", "required"))).alias("_c"))
    kind = dict(packed.dtypes)[key]

    def run(batches):
        for frame in batches:
            rows = [(k, p, i, t) for k, c in zip(frame[key], frame["_c"]) for p, (i, t) in enumerate(choose([(int(r["idx"]), float(r["score"]), r["text"] or "", bool(r["required"])) for r in c], **rules))]
            yield pd.DataFrame(rows, columns=[key, "place", "idx", "text"])

    return packed.mapInPandas(run, f"`{key}` {kind}, place int, idx int, text string")
