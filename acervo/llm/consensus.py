"""Consensus from several annotators' labels.

Mean-field variational confusion model: every annotator has a row of label probabilities per true
class with a Dirichlet prior, the classes have one too. Votes stay long; each iteration sums
expected log probabilities by item and responsibilities by annotator, both as partial sums in
every task. Votes meet the table of items by item and salt: an item with more than its share of the
votes, and there are few such, is spread over many tasks. The table of annotators is broadcast up to
SMALL rows, counted first; beyond that votes meet it by annotator and salt in the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.votes import LABELS
from acervo.operators.skew import Salted
from acervo.runtime import cut, discard, materialise

K = len(LABELS)
SWEEPS = 3
#: Annotators whose table (some 150 bytes each) is broadcast at most.
SMALL = 100_000
#: Votes a key may have before it is looked at as hot, whatever the number of tasks.
LEAST_HOT = 20_000


def digamma(x: str) -> str:
    """Of a positive SQL expression: six steps of the recurrence, then the asymptotic series."""
    y = f"({x} + 6)"
    steps = "".join(f" - 1D / ({x} + {i})" for i in range(6))
    return f"(ln{y} - 1D / (2 * {y}) - 1D / (12 * pow{y[:-1]}, 2)) + 1D / (120 * pow{y[:-1]}, 4)) - 1D / (252 * pow{y[:-1]}, 6)){steps})"


def fit(
    votes: DataFrame, right: float = 2.0, wrong: float = 1.0, classes: float = 1.0, tolerance: float = 1e-3, rounds: int = 40, small: int = SMALL, least_hot: int = LEAST_HOT
) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """votes(instance_id, annotator, label) -> the written votes, the posterior (instance_id, n, q0..), the
    annotators' pseudo-counts (annotator, votes, c0_0..c2_2), prior included: `right` for the
    true label, `wrong` for another; and whether no posterior moved by `tolerance` in the last of at
    most `rounds` rounds of SWEEPS sweeps. The prior of the classes is taken anew every round."""
    spark = votes.sparkSession
    votes = materialise(votes.select("instance_id", "annotator", "label"), "given")
    total = votes.count()
    items, people = Salted(votes, "instance_id", "annotator", least_hot, total), Salted(votes, "annotator", "instance_id", least_hot, total)
    few = people.keys <= small
    if items.hot or (people.hot and not few):
        votes = materialise(votes.select("*", items.salt().alias("_i"), people.salt().alias("_a")), "votes")
    else:
        votes = votes.select("*", F.lit(0).alias("_i"), F.lit(0).alias("_a"))
    first = votes.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == k).alias(f"s{k}") for k in range(K)])
    post = cut(first.select("instance_id", "n", *[((F.col(f"s{k}") + 0.1) / (F.col("n") + 0.1 * K)).alias(f"q{k}") for k in range(K)]))

    pairs = [(k, j) for k in range(K) for j in range(K)]
    row = lambda k: "(" + " + ".join(f"c{k}_{i}" for i in range(K)) + ")"
    cells = [F.expr(f"sum(if(label = {j}, q{k}, 0D)) AS n{k}_{j}") for k, j in pairs]
    counts = [f"n{k}_{j} + {right if j == k else wrong}D AS c{k}_{j}" for k, j in pairs]
    logs = [f"{digamma(f'c{k}_{j}')} - {digamma(row(k))} AS l{k}_{j}" for k, j in pairs]
    said = [f"CASE label {' '.join(f'WHEN {j} THEN l{k}_{j}' for j in range(K))} END AS e{k}" for k in range(K)]
    sums_of = [F.expr("count(1) AS n"), *[F.expr(f"sum(e{k}) AS e{k}") for k in range(K)]]
    weights = [f"exp(e{k} - greatest({', '.join(f'e{i}' for i in range(K))})) AS w{k}" for k in range(K)]
    shares = [f"w{k} / ({' + '.join(f'w{i}' for i in range(K))}) AS q{k}" for k in range(K)]

    def confusion(post: DataFrame) -> DataFrame:
        held = votes.join(items.table(post, "_i"), ["instance_id", "_i"])
        return held.groupBy("annotator").agg(F.expr("count(1) AS votes"), *cells).selectExpr("annotator", "votes", *counts)

    def expected(tables: DataFrame) -> DataFrame:
        """(instance_id, n, e0..): the sums of the votes' expected log probabilities under every class."""
        logged = tables.selectExpr("annotator", *logs)
        met = votes.join(F.broadcast(logged), "annotator") if few else votes.join(people.table(logged, "_a"), ["annotator", "_a"])
        return met.selectExpr("instance_id", *said).groupBy("instance_id").agg(*sums_of)

    converged = False
    for _ in range(rounds):
        now = post
        held = now.agg(*[F.sum(f"q{k}") for k in range(K)]).first()
        prior = spark.createDataFrame([tuple((x or 0.0) + classes for x in held)], ", ".join(f"a{k} double" for k in range(K)))
        prior = F.broadcast(prior.selectExpr(*[f"{digamma(f'a{k}')} AS d{k}" for k in range(K)]))  # one row; a table, so that the code stays the same
        for _ in range(SWEEPS):
            sums = expected(confusion(now)).crossJoin(prior).selectExpr("instance_id", "n", *[f"e{k} + d{k} AS e{k}" for k in range(K)])
            now = sums.selectExpr("instance_id", "n", *weights).selectExpr("instance_id", "n", *shares)
        new = cut(now)
        old = post.selectExpr("instance_id", *[f"q{k} AS o{k}" for k in range(K)])
        moved = new.join(old, "instance_id").agg(F.expr(f"max(greatest({', '.join(f'abs(q{k} - o{k})' for k in range(K))}))")).first()[0]
        discard(post)
        post = new
        if converged := moved is None or moved < tolerance:
            break
    return votes, post, cut(confusion(post)), converged


def consensus(votes: DataFrame, **options: float) -> DataFrame:
    """(instance_id, n, label, confidence, agreement, converged): the label to be believed, its probability, the
    share of the annotators' pairs that agree (null for one annotator) and whether the fit came to rest.
    Labels of equal probability: the earlier in LABELS. Every item with a vote has a row; no votes, no rows."""
    votes, post, _, converged = fit(votes, **options)
    same = votes.groupBy("instance_id", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("instance_id").agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"))
    best = F.greatest(*[F.col(f"q{k}") for k in range(K)])
    label = F.coalesce(*[F.when(F.col(f"q{k}") == best, F.lit(LABELS[k])) for k in range(K)])
    agreement = F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1)))
    return post.join(same, "instance_id").select("instance_id", "n", label.alias("label"), best.alias("confidence"), agreement.alias("agreement"), F.lit(converged).alias("converged"))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 200) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    from math import lgamma

    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    y = np.clip(y, 1e-300, 1 - 1e-16)
    gamma = np.vectorize(lgamma)
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, terms):
        for part in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + part * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + part / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return np.where(flip, 1 - front * h, front * h)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(a, dtype=float), np.ones_like(a, dtype=float)
    for _ in range(60):
        mid = (low + high) / 2
        below = beta_cdf(mid, a, b) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def reliability(votes: DataFrame, level: float = 0.95, **options: float) -> DataFrame:
    """(annotator, votes, reliability, low, high, converged): the mean probability of the true label over the
    classes, and its posterior interval: the quantiles of the Beta distribution of the same mean and
    variance, these from the Dirichlet rows."""
    _, _, tables, converged = fit(votes, **options)
    total = [sum(F.col(f"c{k}_{i}") for i in range(K)) for k in range(K)]
    mean = sum(F.col(f"c{k}_{k}") / total[k] for k in range(K)) / K
    var = sum(F.col(f"c{k}_{k}") * (total[k] - F.col(f"c{k}_{k}")) / (total[k] ** 2 * (total[k] + 1)) for k in range(K)) / K**2

    def bound(p: float):
        def at(m: pd.Series, v: pd.Series) -> pd.Series:
            size = m * (1 - m) / v - 1
            return pd.Series(beta_quantile(p, (m * size).to_numpy(), ((1 - m) * size).to_numpy()))

        return F.pandas_udf(at, "double")

    out = tables.select("annotator", "votes", mean.alias("reliability"), var.alias("_v"))
    ends = [bound((1 - level) / 2)("reliability", "_v").alias("low"), bound((1 + level) / 2)("reliability", "_v").alias("high")]
    return out.select("annotator", "votes", "reliability", *ends, F.lit(converged).alias("converged"))


def krippendorff(votes: DataFrame) -> DataFrame:
    """(items, votes, alpha): nominal agreement over items with two votes or more, from the coincidence
    sums. One row; alpha is null where no item has two votes, 1 where only one label occurs."""
    per = votes.groupBy("instance_id", "label").agg(F.count(F.lit(1)).alias("m"))
    units = per.groupBy("instance_id").agg(F.sum("m").alias("n"), *[F.sum(F.when(F.col("label") == k, F.col("m")).otherwise(0)).alias(f"m{k}") for k in range(K)]).where("n > 1")
    apart = sum(F.col(f"m{k}") * (F.col("n") - F.col(f"m{k}")) for k in range(K)) / (F.col("n") - 1)
    total = units.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("votes"), F.sum(apart).alias("observed"), *[F.sum(f"m{k}").alias(f"t{k}") for k in range(K)])
    expected = sum(F.col(f"t{k}") * (F.col("votes") - F.col(f"t{k}")) for k in range(K)) / (F.col("votes") - 1)
    return total.select("items", "votes", F.when(expected > 0, 1 - F.col("observed") / expected).when(F.col("votes") > 0, 1.0).alias("alpha"))
