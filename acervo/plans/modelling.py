"""Topic models trained on the tenders' lemmas, inference, coherence, coordinates and word vectors. The statements
of these are tests against plain loops, as their numbers come from iterations."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.operators import models as M
from acervo.operators import topics as T
from acervo.operators.latest import latest
from acervo.operators.retrieval import tokens
from acervo.plans.registry import query
from acervo.runtime import materialise, table

K, PASSES = 8, 5
TEXT = "limpieza de los edificios municipales y gestión de los residuos urbanos"


def docs(spark, d):
    """(doc_id, tokens) of the newest lemmas of every tender."""
    rows = latest(table(spark, d, "corpus"), ["place_id"], ["indexed_at"], ["lemmas"])
    words = F.filter(F.split(F.lower("lemmas"), r"\s+"), lambda w: w != "")
    return materialise(rows.where("lemmas IS NOT NULL").select(F.col("place_id").alias("doc_id"), words.alias("tokens")), "docs")


def _fitted(spark, d):
    rows = docs(spark, d)
    return rows, *M.train_lda(rows, K, PASSES)


@query("t26_trained_topics")
def t26(spark, d):
    """The best terms of every topic."""
    _, counter, model = _fitted(spark, d)
    return M.topic_terms(counter, model)


@query("t27_number_of_topics")
def t27(spark, d):
    """Coherence of models of several sizes, the best first."""
    return M.sweep(docs(spark, d), [4, 8], PASSES).orderBy(F.desc("coherence"), "k")


@query("t32_inferred_weights")
def t32(spark, d):
    """Whole weights of every tender, folded in."""
    rows, counter, model = _fitted(spark, d)
    return T.encode(T.to_integers(M.infer(rows, counter, model)))


def _asked(spark):
    return spark.createDataFrame([("text", TEXT)], "doc_id string, t string").select("doc_id", tokens(F.col("t")).alias("tokens"))


@query("q14_similar_to_free_text")
def q14(spark, d):
    """A free text's topics are inferred, and the tenders are scored against them."""
    rows, counter, model = _fitted(spark, d)
    asked = M.infer(_asked(spark), counter, model).select("topic", F.col("w").alias("q"))
    return T.bhattacharyya(M.infer(rows, counter, model), asked).orderBy(F.desc("score"), "doc_id")


@query("q5_similar_to_doc_inferred")
def q5(spark, d):
    """As for a document without stored weights: they are inferred from its lemmas. The document itself stays in."""
    rows, counter, model = _fitted(spark, d)
    one = rows.where(F.col("doc_id") == rows.agg(F.min("doc_id")).first()[0])
    asked = M.infer(one, counter, model).select("topic", F.col("w").alias("q"))
    return T.bhattacharyya(M.infer(rows, counter, model), asked).orderBy(F.desc("score"), "doc_id")


@query("q22_inferred_topic_info")
def q22(spark, d):
    """Topic, weight, label and description of a free text."""
    _, counter, model = _fitted(spark, d)
    info = T.describe(M.topic_terms(counter, model))
    weights = T.to_integers(M.infer(_asked(spark), counter, model)).where("n > 0")
    return weights.join(info, "topic").select(F.concat(F.lit("t"), F.col("topic").cast("string")).alias("id"), F.substring_index("description", ", ", 3).alias("label"), "description", F.col("n").alias("weight"))


@query("t15_coherence")
def t15(spark, d):
    """All four measures of every topic."""
    rows, counter, model = _fitted(spark, d)
    top = materialise(M.topic_terms(counter, model), "top")
    words = rows.select("doc_id", F.explode("tokens").alias("term"))
    parts = [M.window_coherence(rows, top, m) for m in ("c_v", "c_npmi", "c_uci")] + [M.coherence(words, top, "u_mass")]
    named = [p.select(F.lit(m).alias("measure"), "topic", "coherence") for m, p in zip(("c_v", "c_npmi", "c_uci", "u_mass"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query("t29_topic_coordinates")
def t29(spark, d):
    _, counter, model = _fitted(spark, d)
    b = M.topic_terms(counter, model, 200).select("topic", "term", "w")
    return M.coordinates(T.jensen_shannon(b, 0.0), K)


@query("v9_word_vectors")
def v9(spark, d):
    return M.word_vectors(docs(spark, d), size=32).select("word", F.size("v").alias("size"))


@query("v8_sentence_vectors")
def v8(spark, d):
    rows = docs(spark, d)
    return M.sentence_vectors(rows, M.word_vectors(rows, size=32), 32).select("doc_id", F.size("v").alias("size"))
