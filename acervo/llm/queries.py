"""pN_ queries over the test tables, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.burst import term_frequencies
from acervo.llm.consensus import consensus, krippendorff, reliability
from acervo.llm.knn import mutual, nearest, newest_vectors
from acervo.llm.language import fit_profiles, languages, mislabelled
from acervo.llm.mixing import mix, quotas, shares, sized
from acervo.llm.packing import pack
from acervo.llm.paired import rank_items, win_counts
from acervo.llm.quality import judge
from acervo.llm.votes import systems, valid_votes
from acervo.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "corpus"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).withColumn("cosine", F.round("cosine", 6))


def _nearest(spark: SparkSession, d: str, least: float = -2.0) -> DataFrame:
    return nearest(newest_vectors(table(spark, d, "corpus"), "place_id", "indexed_at", "embeddings", 96), least=least)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mutual(_nearest(spark, d, 0.85), 0.85).select(F.col("id_1").alias("place_id_1"), F.col("id_2").alias("place_id_2"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return valid_votes(table(spark, d, "annotations"), table(spark, d, "pair_comparisons"))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank_items(win_counts(_votes(spark, d), systems(table(spark, d, "pair_comparisons"), table(spark, d, "model_alias"))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_ranking(spark, d).where("rank <= 5").select(F.col("task").alias("task_type"), "model")


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages(table(spark, d, "pliegos"), fit_profiles(table(spark, d, "documents")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mislabelled(p5_languages(spark, d))


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus(_votes(spark, d))


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    return reliability(_votes(spark, d))


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    return krippendorff(_votes(spark, d)).withColumn("alpha", F.round("alpha", 9))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_consensus(spark, d).where("n >= 3").select("instance_id", F.col("label").alias("selected_model"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = p7_packing(spark, d).where("container IS NOT NULL")
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("piece_tokens").alias("tokens")).withColumn("slack", 2048 - F.col("tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing(spark, d).where("piece = 0 AND doc_tokens > piece_tokens").select("doc_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = sized(table(spark, d, "documents"))
    quota = quotas(sizes, table(spark, d, "source_targets"))
    return sizes, quota, mix(sizes, quota)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[2]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(*_mix(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).where("outcome IS NOT NULL").select("source", "outcome")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return judge(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_statistics(spark, d).where("NOT prose").select("doc_id")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}
