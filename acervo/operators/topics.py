"""Topic-model algebra on long tables: thetas(doc_id, topic, w), betas(topic, term, w), alphas(topic, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.operators.skew import Salted
from acervo.runtime import materialise

#: Weights of a document sum to MAX_SUM; similarity scores are scaled by 100 / SCALE.
MAX_SUM, SCALE, THRESHOLD = 1000, 1002, 3e-3


def sparsify(thetas: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Weights from the threshold up, summing to one per document again. Null weights are dropped."""
    kept = thetas.where(F.col("w") >= threshold)
    return kept.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("doc_id")))


def to_integers(thetas: DataFrame, total: int = MAX_SUM) -> DataFrame:
    """(doc_id, topic, n): whole weights summing to total by largest remainders, ties by topic."""
    doc = Window.partitionBy("doc_id")
    scaled = thetas.withColumn("x", F.round(F.col("w") * total, 9)).withColumn("n", F.floor("x"))
    short = F.lit(total) - F.sum("n").over(doc)
    rank = F.row_number().over(doc.orderBy(F.desc(F.round(F.col("x") - F.col("n"), 9)), F.asc("topic")))
    return scaled.withColumn("n", F.col("n") + F.when(rank <= short, 1).otherwise(0)).select("doc_id", "topic", F.col("n").cast("long").alias("n"))


def encode(weights: DataFrame) -> DataFrame:
    """(doc_id, thetas): `t0|43 t3|957`, zero weights left out, topics in order."""
    entries = F.array_sort(F.collect_list(F.struct("topic", "n")))
    return weights.where("n > 0").groupBy("doc_id").agg(F.array_join(F.transform(entries, lambda e: F.concat(F.lit("t"), e["topic"].cast("string"), F.lit("|"), e["n"].cast("string"))), " ").alias("thetas"))


def decode(thetas: Column) -> Column:
    """Map of topic name to whole weight."""
    return F.transform_values(F.str_to_map(thetas, F.lit(" "), F.lit(r"\|")), lambda _, v: v.try_cast("int"))


def bhattacharyya(thetas: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, score): sum over topics of sqrt(p q), scaled, for one query (topic, q). One row per topic
    in the query, so the join broadcasts and documents are reduced where they are."""
    met = thetas.join(F.broadcast(query.select("topic", "q")), "topic")  # at most one row per topic
    return met.groupBy("doc_id").agg((F.sum(F.sqrt(F.col("w") * F.col("q"))) * 100 / SCALE).alias("score"))


def alphas(thetas: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(topic, alpha, ndocs_active): column means over all documents and documents with a weight."""
    n = F.lit(n_docs) if n_docs else F.lit(thetas.select("doc_id").distinct().count())
    return thetas.groupBy("topic").agg((F.sum("w") / n).alias("alpha"), F.count_if(F.col("w") != 0).alias("ndocs_active"))


def betas(counts: DataFrame) -> DataFrame:
    """(topic, term, w) from (topic, term, n): shares within the topic."""
    totals = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "topic").select("topic", "term", (F.col("n") / F.col("total")).alias("w"))  # one row per topic


def downscore(b: DataFrame, k: int, eps: float = 1e-12) -> DataFrame:
    """betas * (ln beta - mean over topics of ln beta), absent terms counting as eps."""
    by_term = b.groupBy("term").agg(F.sum(F.log(F.col("w") + eps)).alias("s"), F.count(F.lit(1)).alias("m"))
    mean = (F.col("s") + (k - F.col("m")) * F.log(F.lit(eps))) / k
    return b.join(by_term, "term").select("topic", "term", (F.col("w") * (F.log(F.col("w") + eps) - mean)).alias("score"))


def entropy(b: DataFrame, vocabulary: int) -> DataFrame:
    """(topic, entropy): normalised by the logarithm of the vocabulary size."""
    return b.where("w > 0").groupBy("topic").agg((-F.sum(F.col("w") * F.log("w")) / F.log(F.lit(float(vocabulary)))).alias("entropy"))


def top_terms(b: DataFrame, n: int = 15, by: str = "w") -> DataFrame:
    """(topic, rank, term, by): the n best terms of every topic, ties by term."""
    order = Window.partitionBy("topic").orderBy(F.desc(F.round(by, 12)), F.asc("term"))
    return b.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def describe(top: DataFrame) -> DataFrame:
    """(topic, description): the top terms joined in order."""
    return top.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda e: e["term"]), ", ").alias("description"))


def relative_weights(top: DataFrame) -> DataFrame:
    """(topic, rank, term, relative): the first of a topic is 100, three decimals."""
    first = F.first("w").over(Window.partitionBy("topic").orderBy("rank"))
    return top.select("topic", "rank", "term", F.round(100 * F.col("w") / first, 3).alias("relative"))


#: Terms whose betas are broadcast at most (8 k bytes each, so some 100 MB for 64 topics).
SMALL = 200_000


def s3(tokens: DataFrame, b: DataFrame, k: int, small: int = SMALL) -> DataFrame:
    """(doc_id, topic, score): sum of betas over a document's tokens, repeated ones counting each time,
    unknown ones not; topics a document has no term of are left out.

    Tokens are counted per document first and meet one row per term, an array over the k topics. Those
    rows are broadcast up to `small` terms, counted first; beyond that terms that are in a large part of the
    documents are spread by a salt.
    """
    counts = tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    cells = F.map_from_entries(F.collect_list(F.struct("topic", "w")))  # at most k
    rows = b.groupBy("term").agg(cells.alias("m")).select("term", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: F.try_element_at("m", t)).alias("v"))
    rows = materialise(rows, "betas")
    if rows.count() <= small:
        met = counts.join(F.broadcast(rows), "term")
    else:
        counts = materialise(counts, "counts")
        hot = Salted(counts, "term", "doc_id", 100_000)
        met = counts.withColumn("_s", hot.salt()).join(hot.table(rows, "_s"), ["term", "_s"])
    sums = met.groupBy("doc_id").agg(F.array(*[F.sum(F.col("n") * F.col("v")[t]) for t in range(k)]).alias("s"))
    return sums.select("doc_id", F.posexplode("s").alias("topic", "score")).where("score IS NOT NULL")


def top_docs(scores: DataFrame, n: int = 3, by: str = "score") -> DataFrame:
    order = Window.partitionBy("topic").orderBy(F.desc(F.round(by, 9)), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def reorder(a: DataFrame) -> DataFrame:
    """(topic, new_topic): topics by falling alpha, from 0."""
    return a.select("topic", (F.row_number().over(Window.orderBy(F.desc(F.round("alpha", 12)), F.asc("topic"))) - 1).alias("new_topic"))  # one row per topic


def drop_topics(thetas: DataFrame, gone: list[int]) -> DataFrame:
    kept = thetas.where(~F.col("topic").isin(gone))
    total = F.sum("w").over(Window.partitionBy("doc_id"))
    return kept.withColumn("w", F.when(total > 0, F.col("w") / total))


def fuse(thetas: DataFrame, into: dict[int, int]) -> DataFrame:
    """Weights of fused topics added up."""
    target = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in into.items() for x in kv]), F.col("topic")), F.col("topic"))
    return thetas.withColumn("topic", target).groupBy("doc_id", "topic").agg(F.sum("w").alias("w"))


def fuse_betas(b: DataFrame, a: DataFrame, into: dict[int, int]) -> DataFrame:
    """Alpha-weighted means of the fused topics' betas."""
    target = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in into.items() for x in kv]), F.col("topic")), F.col("topic"))
    weighed = b.join(F.broadcast(a.select("topic", "alpha")), "topic").withColumn("to", target)  # one row per topic
    totals = a.withColumn("to", target).groupBy("to").agg(F.sum("alpha").alias("total"))
    return weighed.groupBy("to", "term").agg(F.sum(F.col("w") * F.col("alpha")).alias("s")).join(F.broadcast(totals), "to").select(F.col("to").alias("topic"), "term", (F.col("s") / F.col("total")).alias("w"))


def correlation(thetas: DataFrame, n_docs: int) -> DataFrame:
    """(i, j, r), i < j: Pearson correlation of topic columns, absent weights counting as zero. A document
    has few topics, so the pairs within it are bounded by the square of the number of topics."""
    moments = thetas.groupBy("topic").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("ss"))
    rows = thetas.groupBy("doc_id").agg(F.collect_list(F.struct("topic", "w")).alias("ws"))
    left = rows.select("ws", F.explode("ws").alias("a")).select("a", F.explode("ws").alias("b")).where("a.topic < b.topic")
    co = left.groupBy(F.col("a.topic").alias("i"), F.col("b.topic").alias("j")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("sxy"))
    m = lambda x, s: moments.select(F.col("topic").alias(x), F.col("s").alias(f"{s}"), F.col("ss").alias(f"{s}{s}"))
    met = co.join(F.broadcast(m("i", "x")), "i").join(F.broadcast(m("j", "y")), "j")  # one row per topic
    spread = F.sqrt((F.col("xx") - F.col("x") ** 2 / n_docs) * (F.col("yy") - F.col("y") ** 2 / n_docs))
    return met.select("i", "j", ((F.col("sxy") - F.col("x") * F.col("y") / n_docs) / spread).alias("r"))


def jensen_shannon(b: DataFrame, above: float = 1e-6) -> DataFrame:
    """(i, j, similarity), i < j: one minus the square root of the Jensen-Shannon divergence of topic rows,
    over terms whose largest beta exceeds `above`, rows summing to one again. Joined by term: a term
    has at most one row per topic."""
    used = b.groupBy("term").agg(F.max("w").alias("m")).where(F.col("m") > above).select("term")
    kept = b.join(used, "term")
    kept = kept.join(F.broadcast(kept.groupBy("topic").agg(F.sum("w").alias("t"))), "topic").select("topic", "term", (F.col("w") / F.col("t")).alias("p"))
    x, y = kept.select(F.col("topic").alias("i"), "term", "p"), kept.select(F.col("topic").alias("j"), "term", F.col("p").alias("q"))
    half = (F.col("p") + F.col("q")) / 2
    both = x.join(y, "term").where("i < j").groupBy("i", "j").agg((F.sum(F.col("p") * F.log(F.col("p") / half) + F.col("q") * F.log(F.col("q") / half)) / 2).alias("d"), F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    topics = kept.select("topic").distinct()
    pairs = topics.select(F.col("topic").alias("i")).join(topics.select(F.col("topic").alias("j")), F.col("i") < F.col("j"))  # topics only
    far = F.coalesce("d", F.lit(0.0)) + F.log(F.lit(2.0)) / 2 * (2 - F.coalesce("sp", F.lit(0.0)) - F.coalesce("sq", F.lit(0.0)))
    return pairs.join(both, ["i", "j"], "left").select("i", "j", (1 - F.sqrt(F.greatest(far, F.lit(0.0)))).alias("similarity"))


def reindex(df: DataFrame, order: DataFrame) -> DataFrame:
    """A table with a topic column under the topics' new numbers. order(topic, new_topic) has a row per topic."""
    return df.join(F.broadcast(order), "topic").withColumn("topic", F.col("new_topic")).drop("new_topic")


def largest(pairs: DataFrame, n: int) -> DataFrame:
    """(i, j, similarity), i < j: of the n largest cells of the whole symmetric matrix (ones on the diagonal), ties
    by i and j, those above the diagonal. pairs(i, j, similarity), i < j."""
    topics = pairs.select("i").union(pairs.select("j")).distinct()
    whole = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "similarity")).unionByName(topics.select("i", F.col("i").alias("j"), F.lit(1.0).alias("similarity")))
    return whole.orderBy(F.desc("similarity"), "i", "j").limit(n).where("i < j")


def model_rows(a: DataFrame, b: DataFrame, vocabulary: int, digits: int = 6) -> DataFrame:
    """A row per topic as it is exported: id, size, documents, entropy, label (the three best terms), description,
    relative and plain weights of the best terms, and the number of its terms."""
    top = top_terms(b)
    relative = F.round(100 * F.col("w") / F.max("w").over(Window.partitionBy("topic")), 3)
    entries = F.array_sort(F.collect_list(F.struct("rank", "term", "relative", "w")))
    join = lambda f, sep: F.array_join(F.transform("_e", f), sep)
    words = top.withColumn("relative", relative).groupBy("topic").agg(entries.alias("_e")).select(
        "topic", F.array_join(F.transform(F.slice("_e", 1, 3), lambda e: e["term"]), ", ").alias("tpc_labels"), join(lambda e: e["term"], ", ").alias("tpc_descriptions"),
        join(lambda e: F.concat(e["term"], F.lit("|"), F.format_string("%.3f", e["relative"])), " ").alias("top_words_betas"), join(lambda e: F.concat(e["term"], F.lit("|"), F.format_string("%.6f", e["w"])), " ").alias("betas"),
    )
    sizes = b.groupBy("topic").agg(F.count(F.lit(1)).alias("vocab"))
    rows = a.join(entropy(b, vocabulary), "topic", "left").join(words, "topic", "left").join(sizes, "topic", "left")
    return rows.select(F.concat(F.lit("t"), F.col("topic").cast("string")).alias("id"), F.round("alpha", digits).alias("alphas"), "ndocs_active", F.round("entropy", digits).alias("topic_entropy"), "tpc_labels", "tpc_descriptions", "top_words_betas", "betas", "vocab")


def set_labels(topics: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """topics with the labels of a table of as many rows, trimmed; another number of labels is an error."""
    if (n := labels.count()) != (m := topics.count()):
        raise ValueError(f"{n} labels for {m} topics")
    return topics.drop(label).join(labels.select(key, F.trim(label).alias(label)), key, "left")


def save(path: str, **parts: DataFrame) -> str:
    """The tables of a model below a folder. The first time a part is saved it is also kept as the original."""
    for name, df in parts.items():
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/original/{name}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        new = f"{path}/next/{name}"
        df.write.mode("overwrite").parquet(new)
        if not fs.exists(at):
            spark.read.parquet(new).write.parquet(f"{path}/original/{name}")
        now = jvm.org.apache.hadoop.fs.Path(f"{path}/now/{name}")
        fs.mkdirs(now.getParent())
        fs.delete(now, True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(new), now)
    return path


def load(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{path}/now/{part}")


def reset(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The original of a part, put back as what it is now."""
    save(path, **{part: spark.read.parquet(f"{path}/original/{part}")})
    return load(spark, path, part)
