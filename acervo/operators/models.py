"""Topic models, word vectors and coherence on pyspark.ml, with results as long tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def train_lda(docs: DataFrame, k: int, iterations: int = 50, min_df: float = 5, vocabulary: int = 1 << 18, seed: int = 42) -> tuple[CountVectorizerModel, LDAModel]:
    """docs(doc_id, tokens). A model has at most `vocabulary` words, those in most documents: a topic is a dense row
    of them, so this bounds the model and is a parameter. Online variational inference, so results differ in number from a Gibbs sampler's. Every iteration draws as many documents as there are,
    with replacement: `iterations` passes on average, and none is missed but by a chance of exp(-iterations)."""
    counter = CountVectorizer(inputCol="tokens", outputCol="features", minDF=min_df, vocabSize=vocabulary).fit(docs)
    return counter, LDA(k=k, maxIter=iterations, subsamplingRate=1.0, seed=seed, featuresCol="features").fit(counter.transform(docs))


def infer(docs: DataFrame, counter: CountVectorizerModel, model: LDAModel, threshold: float = 3e-3) -> DataFrame:
    """(doc_id, topic, w): folded-in weights from the threshold up, summing to one."""
    mixed = model.transform(counter.transform(docs)).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "w"))
    kept = mixed.where(F.col("w") >= threshold)
    return kept.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("doc_id")))


def topic_terms(counter: CountVectorizerModel, model: LDAModel, n: int = 15) -> DataFrame:
    """(topic, rank, term, w) of the n best terms of every topic."""
    rows = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    words = rows.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "i int, term string")
    return rows.join(words, F.col("t.termIndices") == F.col("i")).select("topic", (F.col("rank") + 1).alias("rank"), "term", F.col("t.termWeights").alias("w"))


def coherence(tokens: DataFrame, top: DataFrame, measure: str = "npmi", eps: float = 1e-12) -> DataFrame:
    """(topic, coherence): mean over pairs of a topic's top terms of npmi or u_mass, from document
    co-occurrence. tokens(doc_id, term); only top terms take part, a bounded set, so a document's
    pairs are bounded too."""
    used = top.select("term").distinct()
    sets = tokens.join(F.broadcast(used), "term").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("t"))  # topics x top terms
    n = tokens.select("doc_id").distinct().count()
    single = sets.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    pairs = sets.select("t", F.explode("t").alias("a")).select("a", F.explode("t").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    x, y = top.select("topic", F.col("term").alias("u"), F.col("rank").alias("ru")), top.select("topic", F.col("term").alias("v"), F.col("rank").alias("rv"))
    wanted = x.join(y, "topic").where("ru < rv").select("topic", "u", "v", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    met = wanted.join(pairs, ["a", "b"], "left").join(single.select(F.col("term").alias("u"), F.col("df").alias("du")), "u", "left").join(single.select(F.col("term").alias("v"), F.col("df").alias("dv")), "v", "left")
    both, du, dv = (F.coalesce(c, F.lit(0)) for c in ("both", "du", "dv"))
    if measure == "u_mass":
        score = F.when(du > 0, F.log((both + 1) / du)).otherwise(0.0)
    else:
        p = both / n + eps
        score = F.when((du > 0) & (dv > 0), F.log(p / (du / n * dv / n)) / -F.log(p)).otherwise(0.0)
    return met.groupBy("topic").agg(F.avg(score).alias("coherence"))


def window_coherence(docs: DataFrame, top: DataFrame, measure: str = "c_v", window: int | None = None, eps: float = 1e-12) -> DataFrame:
    """(topic, coherence) from sliding windows over docs(doc_id, tokens): c_v (window 110: every word's vector of
    npmi with the topic's words against their sum, mean cosine), c_npmi or c_uci (window 10: mean over
    pairs). A document shorter than the window is one window.

    Windows that hold a word, and those that hold two, are counted in every document from the places of the top
    terms alone, a bounded set; only counts are shuffled.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    size = window or (110 if measure == "c_v" else 10)
    topics: dict[int, list[str]] = {}
    for r in top.orderBy("topic", "rank").collect():  # topics x top terms
        topics.setdefault(r["topic"], []).append(r["term"])
    used = {w for words in topics.values() for w in words}
    wanted = {(a, b) for words in topics.values() for a in words for b in words if a < b}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = {}
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                n = max(1, len(tokens) - size + 1)
                sums["", ""] = sums.get(("", ""), 0) + n
                held: dict[str, np.ndarray] = {}
                for i, w in enumerate(tokens):
                    if w in used:
                        marks = held.setdefault(w, np.zeros(n, dtype=bool))
                        marks[max(0, i - size + 1) : min(n, i + 1)] = True
                for w, marks in held.items():
                    sums[w, w] = sums.get((w, w), 0) + int(marks.sum())
                for a, b in wanted:
                    if a in held and b in held:
                        sums[a, b] = sums.get((a, b), 0) + int((held[a] & held[b]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["a", "b", "n"])

    found = {(r["a"], r["b"]): r["n"] for r in docs.select("tokens").where("tokens IS NOT NULL").mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}  # pairs of top terms
    total = max(1, found.get(("", ""), 0))
    share = lambda a, b: found.get((min(a, b), max(a, b)), 0) / total

    def pmi(a: str, b: str) -> float:
        pa_, pb = share(a, a), share(b, b)
        return float(np.log((share(a, b) + eps) / (pa_ * pb))) if pa_ and pb else 0.0

    def npmi(a: str, b: str) -> float:
        return pmi(a, b) / -float(np.log(share(a, b) + eps)) if share(a, a) and share(b, b) else 0.0

    def score(words: list[str]) -> float:
        if measure == "c_v":
            grid = np.array([[npmi(a, b) for b in words] for a in words])
            whole = grid.sum(axis=0)
            sizes = np.linalg.norm(grid, axis=1) * np.linalg.norm(whole)
            return float(np.mean(np.divide(grid @ whole, sizes, out=np.zeros(len(words)), where=sizes > 0)))
        pairs = [(npmi if measure == "c_npmi" else pmi)(a, b) for i, a in enumerate(words) for b in words[:i]]
        return float(np.mean(pairs)) if pairs else 0.0

    return docs.sparkSession.createDataFrame([(t, score(words)) for t, words in topics.items()], "topic int, coherence double")


def sweep(docs: DataFrame, sizes: list[int], iterations: int = 20, top: int = 10) -> DataFrame:
    """(k, coherence): mean npmi of models of each size; the caller takes the best."""
    tokens = docs.select("doc_id", F.explode("tokens").alias("term"))
    parts = []
    for k in sizes:
        counter, model = train_lda(docs, k, iterations)
        parts.append(coherence(tokens, topic_terms(counter, model, top)).agg(F.lit(k).alias("k"), F.avg("coherence").alias("coherence")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coordinates(similarity: DataFrame, k: int) -> DataFrame:
    """(topic, x, y): classical scaling of topic distances. similarity(i, j, similarity), i < j, has
    k (k - 1) / 2 rows, so the eigenvectors are found on the driver."""
    if (n := similarity.count()) > k * (k - 1) // 2:
        raise ValueError(f"{n} similarities of {k} topics")
    rows = similarity.select("i", "j", "similarity").collect()
    far = np.zeros((k, k))
    for r in rows:
        far[r[0], r[1]] = far[r[1], r[0]] = 1 - r[2]
    centre = np.eye(k) - 1 / k
    values, vectors = np.linalg.eigh(-0.5 * centre @ far**2 @ centre)
    order = np.argsort(-values)[:2]
    points = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    points *= np.where(points[np.abs(points).argmax(axis=0), range(2)] < 0, -1, 1)
    return similarity.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "topic int, x double, y double")


def word_vectors(docs: DataFrame, size: int = 200, window: int = 5, min_count: int = 10, seed: int = 42, iterations: int = 1) -> DataFrame:
    """(word, v) by skip-gram. docs(tokens)."""
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, maxIter=iterations, inputCol="tokens", outputCol="v").fit(docs)
    return model.getVectors().select("word", vector_to_array("vector").alias("v"))


def sentence_vectors(docs: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(doc_id, v): mean of the known words' vectors, repeated words counting each time; zeros if none."""
    words = docs.select("doc_id", F.explode("tokens").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    met = words.join(vectors, "word")
    sums = met.groupBy("doc_id").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i] * F.col("n")).alias(f"_{i}") for i in range(size)])
    mean = sums.select("doc_id", F.array(*[F.col(f"_{i}") / F.col("n") for i in range(size)]).alias("v"))
    return docs.select("doc_id").distinct().join(mean, "doc_id", "left").select("doc_id", F.coalesce("v", F.array_repeat(F.lit(0.0), size)).alias("v"))
