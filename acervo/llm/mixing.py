"""Mixing sources to target weights by systematic sampling.

Each source's records have the same expected number of copies, what its target needs but at most
its cap. The expected copies are summed up along the source, one random offset is added, and a
record is emitted once per integer boundary it crosses: the number of copies of a source is exact
to one. Records of a source are walked in order of size, so the emitted tokens are close as well.
The running sums come from bucketed ranks; no source passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.clean import squeeze
from acervo.llm.packing import BUCKET
from acervo.llm.tokens import VOCABULARY, token_counts
from acervo.operators.ranking import bucket_rank
from acervo.runtime import materialise


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens), written. Source in lower case without outer spaces, inner spaces and
    hyphens as underscores; blank is null."""
    rows = token_counts(df, text, (key, source), path)
    name = F.regexp_replace(F.lower(squeeze(F.col(source))), r"[\s_-]+", "_")
    return materialise(rows.select(key, F.when(name != "", name).alias("source"), "n_tokens"), "sized")


def quotas(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, target, copies, outcome) per source of targets.

    target is the share of all tokens, those of rows without source included. copies are the expected
    copies of each record. outcome: `cut` if there are more tokens than the target, `repeated` if
    fewer but max_repeats reaches it, `short` if it can't, null if they are equal. A null share is 0,
    null or smaller max_repeats are 1; a source named twice counts with its largest share.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"))
    both = want.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("target", F.col("target_share") * total)
    outcome = F.when(F.col("available") > F.col("target"), "cut").when(F.col("available") * F.col("max_repeats") < F.col("target"), "short").when(F.col("available") < F.col("target"), "repeated")
    copies = F.when(F.col("available") > 0, F.least(F.col("target") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.select("source", "target_share", "max_repeats", "available", "target", copies.alias("copies"), outcome.alias("outcome"))


def mix(sizes: DataFrame, quota: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """(key, source, n_tokens, copy): a row per emitted copy, copy from 1. Rows without a source of the
    targets are never emitted; the offset of each source follows from seed and its name."""
    offset = (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1_000_003)) / 1_000_003).alias("offset")
    plan = quota.where("copies > 0").select("source", "copies", offset)
    most = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    parts = max(1, -(-most // BUCKET))
    rows = sizes.where("source IS NOT NULL").withColumn("hash", F.xxhash64(F.lit(seed), key))
    band = F.floor(F.log2(F.col("n_tokens") + 1) * 8) * parts + F.pmod("hash", F.lit(parts))
    ranked = bucket_rank(rows.withColumn("band", band), ["source"], "band", [F.col("n_tokens"), F.col("hash"), F.col(key)])
    met = ranked.join(plan, "source")
    crossed = F.floor(F.col("copies") * F.col("rank") + F.col("offset")) - F.floor(F.col("copies") * (F.col("rank") - 1) + F.col("offset"))
    return met.withColumn("n", crossed).where("n > 0").select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))


def shares(sizes: DataFrame, quota: DataFrame, mixed: DataFrame) -> DataFrame:
    """quota with `used` tokens, actual_share of the mix and the most copies of one record."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.max("copy").alias("most_copies"))
    total = mixed.agg(F.sum("n_tokens")).first()[0] or 1
    return quota.join(used, "source", "left").select("source", "target_share", "max_repeats", "available", "target", F.coalesce("used", F.lit(0)).alias("used"), (F.coalesce("used", F.lit(0)) / total).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "outcome")
