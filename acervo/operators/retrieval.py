"""Keyword search, chunking, BM25, rank fusion, reranking and adaptive selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25 parameters, fusion constant and the rank of a missing hit, rerank weights.
K1, B, RRF, MISSING = 1.5, 0.75, 60, 1_000_000
WEIGHTS = {"base": 0.35, "purpose": 0.45, "position": 0.10, "noise": 0.10}
SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(c: Column) -> Column:
    """Lower-case word tokens; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), SPLIT), lambda t: t != "")


def keyword(c: Column, query: str, any_field: tuple[Column, ...] = ()) -> Column:
    """Match of a query as the index would: `*` matches all, a quoted query is a phrase, else any of
    its words. Null text never matches."""
    if query.strip() == "*":
        return F.lit(True)
    fields = (c, *any_field)
    if query.startswith('"') and query.endswith('"') and len(query) > 1:
        phrase = " " + " ".join(w for w in query.strip('"').lower().split()) + " "
        return F.coalesce(F.greatest(*[F.concat(F.lit(" "), F.array_join(tokens(f), " "), F.lit(" ")).contains(phrase) for f in fields], F.lit(False)), F.lit(False))
    words = F.array(*[F.lit(w) for w in query.lower().split()])
    return F.greatest(*[F.arrays_overlap(tokens(f), words) for f in fields], F.lit(False))


def page(df: DataFrame, order: list[Column], start: int = 0, rows: int | None = None) -> DataFrame:
    """start/rows paging of an ordered result; all rows if not given."""
    out = df.orderBy(*order)
    if start:
        out = out.offset(start)
    return out if rows is None else out.limit(rows)


def parse_sort(spec: str, tie: str = "id") -> list[Column]:
    """`field:order,field:order` as sort columns, the tie breaker last; a wrong order is an error."""
    out = []
    for part in spec.split(","):
        name, _, way = part.partition(":")
        if way not in ("asc", "desc"):
            raise ValueError(f"sort order must be asc or desc: {part!r}")
        out.append(F.col(name.strip()).asc_nulls_last() if way == "asc" else F.col(name.strip()).desc_nulls_last())
    return [*out, F.col(tie).asc()]


def year_range(date: Column, start: int | None, end: int | None) -> Column:
    """Half-open UTC year bounds; one bound alone means that year only, none means all."""
    if start is None and end is None:
        return F.lit(True)
    first, last = (start if start is not None else end), (end if end is not None else start)
    if first > last:
        raise ValueError("start year after end year")
    return (date >= F.lit(f"{first:04d}-01-01 00:00:00").cast("timestamp_ntz")) & (date < F.lit(f"{last + 1:04d}-01-01 00:00:00").cast("timestamp_ntz"))


def chunks(df: DataFrame, key: str, text: str, size: int = 256, overlap: int = 64) -> DataFrame:
    """(key, idx, chunk_id, text): windows of `size` whitespace tokens, each starting size - overlap after
    the one before, until one reaches the end. A stride below 1 becomes half the size."""
    stride = size - overlap if size > overlap else max(1, size // 2)
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    rows = df.select(key, words.alias("_w")).where(F.size("_w") > 0)
    last = F.ceil(F.greatest(F.size("_w") - size, F.lit(0)) / stride).cast("int")
    out = rows.select(key, "_w", F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    return out.select(key, "idx", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("idx").cast("string")), 256).alias("chunk_id"), F.array_join(F.slice("_w", F.col("idx") * stride + 1, size), " ").alias("text"))


def bm25(docs: DataFrame, query: list[str], key: str = "id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of documents with a query term. Counts per document stay in its row (a query has few
    terms), so the corpus isn't exploded; document frequencies are one aggregate."""
    terms = sorted({t.lower() for t in query})

    def times(term: str) -> Column:
        return F.size(F.filter("_w", lambda w: w == F.lit(term)))

    rows = docs.select(key, tokens(F.col(text)).alias("_w")).select(key, F.size("_w").alias("_n"), *[times(t).alias(f"_t{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count(F.lit(1)).alias("N"), F.avg("_n").alias("avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    met = rows.where(" OR ".join(f"_t{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = sum(F.log(1 + (F.col("N") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)) * F.col(f"_t{i}") * (k1 + 1) / (F.col(f"_t{i}") + k1 * (1 - b + b * F.col("_n") / F.col("avg"))) for i in range(len(terms)))
    return met.select(key, score.alias("score"))


def fuse(left: DataFrame, right: DataFrame, key: str = "id", constant: int = RRF) -> DataFrame:
    """(key, score) of two rankings (key, rank) by reciprocal rank; a missing hit has rank MISSING."""
    both = left.select(key, F.col("rank").alias("a")).join(right.select(key, F.col("rank").alias("b")), key, "full")
    part = lambda c: 1 / (constant + F.coalesce(F.col(c), F.lit(MISSING)))
    return both.select(key, (part("a") + part("b")).alias("score"))


def minmax(c: str, group: list[str]) -> Column:
    """Scaled to 0..1 within the group; 0.5 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (F.col(c) - low) / (high - low)).when(F.col(c).isNotNull(), 0.5)


def rerank(base: Column, purpose: Column, noise: Column, idx: Column, total: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    position = F.greatest(F.lit(0.0), 1 - idx / F.greatest(F.lit(1), total - 1))
    return weights["base"] * base + weights["purpose"] * purpose + weights["position"] * position - weights["noise"] * noise


def adaptive_threshold(df: DataFrame, group: str, score: str) -> DataFrame:
    """(group, threshold): the larger of the 60th percentile, taken at place ceil(0.4 (n - 1)) of the
    falling scores, and the mean less a quarter of the sample deviation (0 for one score)."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    ranked = df.select(group, score, (F.row_number().over(w.orderBy(F.desc(score))) - 1).alias("_at"), n.alias("_n"))
    return ranked.groupBy(group).agg(F.greatest(F.max(F.when(F.col("_at") == F.ceil(0.4 * (F.col("_n") - 1)), F.col(score))), F.avg(score) - 0.25 * F.coalesce(F.stddev_samp(score), F.lit(0.0))).alias("threshold"))


def neighbours(chunked: DataFrame, hits: DataFrame, key: str, radius: int = 1) -> DataFrame:
    """Chunks within radius of a hit of the same document: the hit explodes to its window, an equi-join."""
    near = hits.select(key, F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius)).alias("idx")).distinct()
    return chunked.join(near, [key, "idx"], "left_semi")
