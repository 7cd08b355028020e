"""Votes on comparisons, read in one way by every statistic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.clean import squeeze
from acervo.operators.annotation import LABELS, vote_label  # noqa: F401
from acervo.operators.latest import latest


def valid_votes(annotations: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(instance_id, annotator, label 0..2): of each annotator's valid votes on one comparison the latest.

    Valid is a vote with one of the three labels, bare or as the only key of an object, whatever its
    case and spacing, on a comparison that exists. Votes without annotator are dropped; votes without
    time come before all others; of votes at the same time the larger id counts.
    """
    rows = annotations.select("annotator", "instance_id", "annotated_at", "annotation_id", vote_label(F.col("selected_model")).alias("label"))
    newest = latest(rows.where("label >= 0"), ["instance_id", "annotator"], ["annotated_at", "annotation_id"], ["label"])
    return newest.select("instance_id", "annotator", "label").join(comparisons.select(F.col("id").alias("instance_id")), "instance_id", "left_semi")


def systems(comparisons: DataFrame, alias: DataFrame) -> DataFrame:
    """(instance_id, task, place_id, a, b): one row per comparison, proper names of both systems, null where
    missing or unknown; task in lower case without outer spaces. place_id is null where there is none."""
    names = alias.select(F.lower(squeeze(F.col("alias"))).alias("name"), "model").unionByName(alias.select(F.lower(squeeze(F.col("model"))).alias("name"), "model"))
    names = names.where("name IS NOT NULL AND model IS NOT NULL").groupBy("name").agg(F.min("model").alias("model"))
    place = F.col("place_id") if "place_id" in comparisons.columns else F.lit(None).cast("string")
    one = latest(comparisons.withColumn("_place", place), ["id"], [], ["task_type", "item_a_model", "item_b_model", "_place"])
    out = one.select(
        F.col("id").alias("instance_id"), F.lower(squeeze(F.col("task_type"))).alias("task"), F.col("_place").alias("place_id"),
        F.lower(squeeze(F.col("item_a_model"))).alias("_a"), F.lower(squeeze(F.col("item_b_model"))).alias("_b"),
    )
    for side in "ab":
        out = out.join(names.select(F.col("name").alias(f"_{side}"), F.col("model").alias(side)), f"_{side}", "left")
    return out.select("instance_id", "task", "place_id", "a", "b")
