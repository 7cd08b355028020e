"""State of annotation projects: votes, assignment, removal, reordering, markup and times."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.clean import squeeze
from acervo.operators.latest import latest
from acervo.operators.ranking import bucket_rank
from acervo.runtime import materialise

#: The three labels as they are spelled in the tables.
LABELS = ("A es mejor", "B es mejor", "Ambos son malos")
SPANS = "text string, spans array<struct<start: int, stop: int, label: string>>"
_OPEN, _CLOSE = re.compile(r'<span\b[^>]*?schema_label="([^"]*)"[^>]*>|<span\b[^>]*>'), "</span>"


def vote_label(c: Column) -> Column:
    """Place 0..2 in LABELS of a vote, bare or as the only key of an object, whatever its case and
    spacing; -1 for anything else, null for null."""
    label = F.regexp_extract(F.lower(squeeze(c)), r"""^(?:\{ ?["'] ?)?(a es mejor|b es mejor|ambos son malos)(?: ?["'] ?:[^:]*\})?$""", 1)
    return (F.array_position(F.array(*[F.lit(x.lower()) for x in LABELS]), label) - 1).cast("int")


def current(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Votes as they stand: the newest value per key; an empty one deletes."""
    return latest(events, keys, [order], [value]).where(F.col(value).isNotNull() & (F.col(value) != "")).drop(order)


def drawn(seed: int, *columns: str) -> Column:
    """A text that orders rows at random, the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def assign(instances: DataFrame, user: str, n: int, seed: int = 42) -> DataFrame:
    """n instances with quota left: most quota first, then drawn by user and instance. instances(id,
    quota) -> (id, user)."""
    rows = instances.where("quota > 0").withColumn("user", F.lit(user))
    return rows.orderBy(F.desc("quota"), drawn(seed, "user", "id"), "id").limit(n).select("id", "user")


def take_quota(instances: DataFrame, assigned: DataFrame) -> DataFrame:
    used = assigned.groupBy("id").agg(F.count(F.lit(1)).alias("_u"))
    return instances.join(used, "id", "left").withColumn("quota", F.col("quota") - F.coalesce("_u", F.lit(0))).drop("_u")


def remove_users(votes: DataFrame, instances: DataFrame, users: list[str], user: str = "user") -> tuple[DataFrame, DataFrame]:
    """Votes without these users, and instances with the quota they had taken given back."""
    gone = votes.where(F.col(user).isin(users)).groupBy("id").agg(F.countDistinct(user).alias("_g"))
    return votes.where(~F.col(user).isin(users)), instances.join(gone, "id", "left").withColumn("quota", F.col("quota") + F.coalesce("_g", F.lit(0))).drop("_g")


def interleave(scored: DataFrame, every: int = 2, seed: int = 42) -> DataFrame:
    """scored(id, confidence) -> (id, place): each `every`-th place is drawn, the others take the least certain
    first; nothing comes twice. Two ranks over buckets and arithmetic on the two counts: no task holds a list."""
    at = F.conv(F.substring(drawn(seed, "id"), 1, 7), 16, 10).cast("long") % every == 0
    rows = scored.select("id", "confidence", at.alias("_p"), drawn(seed + 1, "id").alias("_h"))
    bucket = F.when(F.col("_p"), F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")).otherwise(F.floor(F.coalesce("confidence", F.lit(-1.0)) * 4096))
    held = materialise(rows.withColumn("_b", bucket), "scored")
    order = [F.when(F.col("_p"), F.col("_h")), F.when(~F.col("_p"), F.col("confidence")), F.asc("id")]
    ranked = bucket_rank(held, ["_p"], "_b", order, "_r")
    sizes = held.agg(F.count_if("_p").alias("_np"), F.count_if(~F.col("_p")).alias("_no"))
    others = F.least("_no", F.col("_r") * (every - 1))
    picks = F.least("_np", F.floor((F.col("_r") - 1) / max(1, every - 1)))
    return ranked.crossJoin(F.broadcast(sizes)).select("id", (F.col("_r") + F.when(F.col("_p"), others).otherwise(picks)).cast("long").alias("place"))  # one row


def pipeline(vectoriser: str, classifier: str, text: str, label: str, options: dict | None = None):
    """An estimator of pyspark.ml from the dotted names of a vectoriser of tokens and a classifier; the predicted
    label is in `predicted`, its probabilities in `probability`. Rows with a null label aren't fitted."""
    from importlib import import_module

    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, RegexTokenizer, SQLTransformer, StringIndexer

    def made(name: str, **arguments):
        module, _, cls = name.rpartition(".")
        return getattr(import_module(module), cls)(**arguments)

    class Named:
        def fit(self, rows: DataFrame):
            known = rows.where(F.col(label).isNotNull())
            names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(known)
            words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}_]+")
            stages = [words, made(vectoriser, inputCol="_w", outputCol="_x", **(options or {})), made(classifier, featuresCol="_x", labelCol="_y")]
            fitted = Pipeline(stages=stages).fit(names.transform(known))
            back = IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels)
            return Pipeline(stages=[*fitted.stages, back, SQLTransformer(statement="SELECT * FROM __THIS__")]).fit(known)

    return Named()


def confidence(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(id, confidence): the largest probability a classifier fitted on the labelled rows gives each row."""
    from pyspark.ml.functions import vector_to_array

    model = pipeline("pyspark.ml.feature.HashingTF", "pyspark.ml.classification.LogisticRegression", text, label, {"numFeatures": 1024}).fit(rows)
    return model.transform(rows).select("id", F.array_max(vector_to_array("probability")).alias("confidence"))


def parse_spans(c: Column) -> Column:
    """Inline `<span schema_label="x">…</span>` markup -> text and spans. Markup nests, so it takes a scan."""

    def scan(markup: str | None):
        if markup is None:
            return None
        text, stack, spans, at = "", [], [], 0
        while at < len(markup):
            if m := _OPEN.match(markup, at):
                stack.append((len(text), m[1] or ""))
                at = m.end()
            elif markup.startswith(_CLOSE, at) and stack:
                start, label = stack.pop()
                spans.append({"start": start, "stop": len(text), "label": label})
                at += len(_CLOSE)
            else:
                text += markup[at]
                at += 1
        return {"text": text, "spans": sorted(spans, key=lambda s: (s["start"], -s["stop"]))}

    def run(s: pd.Series) -> pd.DataFrame:
        found = [scan(x) or {"text": None, "spans": None} for x in s]
        return pd.DataFrame(found, columns=["text", "spans"])

    return F.pandas_udf(run, SPANS)(c)


def seconds(c: Column) -> Column:
    """Seconds of `Time spent: 1d 2h 3m 4s`; days don't count, missing parts are zero."""
    part = lambda unit: F.coalesce(F.regexp_extract(c, rf"(\d+)\s*{unit}", 1).try_cast("long"), F.lit(0))
    return part("h") * 3600 + part("m") * 60 + part("s")
