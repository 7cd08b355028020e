"""Agreement, overlap and rank statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.operators.retrieval import tokens


#: Words of the domain that say nothing of an objective.
DOMAIN = ("objeto", "contrato", "contratación", "objetivo", "pliego", "licitación")


def content(c: Column) -> Column:
    """Word tokens without those of the domain."""
    return F.filter(tokens(c), lambda w: ~w.isin(*DOMAIN))


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two token arrays as sets; both empty 1, one empty 0."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    same = F.size(F.array_intersect(x, y)).cast("double")
    none, one = (F.size(x) == 0) & (F.size(y) == 0), (F.size(x) == 0) | (F.size(y) == 0)
    part = lambda v: F.when(none, 1.0).when(one, 0.0).otherwise(v)
    p, r = part(same / F.greatest(F.size(x), F.lit(1))), part(same / F.greatest(F.size(y), F.lit(1)))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def ngrams(a: Column, n: int) -> Column:
    last = F.size(a) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(a, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(a: Column, b: Column, n: int) -> Column:
    """F1 of clipped n-gram counts of two token arrays (no stemming): both sides' n-grams are sorted together
    and the runs of equal ones counted in one pass."""
    x, y = ngrams(a, n), ngrams(b, n)
    both = F.array_sort(F.concat(F.transform(x, lambda g: F.struct(g.alias("g"), F.lit(0).alias("s"))), F.transform(y, lambda g: F.struct(g.alias("g"), F.lit(1).alias("s")))))
    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("hits"))

    def step(s: Column, e: Column) -> Column:
        same = s["g"] == e["g"]
        left, right = F.when(same, s["l"]).otherwise(0) + (1 - e["s"]), F.when(same, s["r"]).otherwise(0) + e["s"]
        hits = s["hits"] + F.when(same, 0).otherwise(F.least(s["l"], s["r"]))
        return F.struct(e["g"].alias("g"), left.alias("l"), right.alias("r"), hits.alias("hits"))

    hits = F.aggregate(both, start, step, lambda s: s["hits"] + F.least(s["l"], s["r"]))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * hits / total).otherwise(0.0)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two label columns; rows with a null label are left out."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("m"))
    total = rows.agg(F.sum("m").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("m")).otherwise(0)).alias("same"))
    left, right = rows.groupBy(F.col(a).alias("l")).agg(F.sum("m").alias("x")), rows.groupBy(F.col(b).alias("l")).agg(F.sum("m").alias("y"))
    chance = left.join(right, "l").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    p, e = F.col("same") / F.col("n"), F.coalesce("c", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", p.alias("agreement"), F.when(e < 1, (p - e) / (1 - e)).when(F.col("n") > 0, 1.0).alias("kappa"))  # one row each


def pair_kappa(pairs: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, agreement, kappa) of pairs(group, a, b, m), m ordered pairs of label a and b, each pair of
    raters in both orders; n counts a pair once. Few labels, so a group's margins are few. No pairs, no rows."""
    cells = pairs.groupBy(*group, "a", "b").agg(F.sum("m").alias("m"))
    margin = cells.groupBy(*group, "a").agg(F.sum("m").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0)).alias("same"))
    out = margin.groupBy(*group).agg(F.sum("t").alias("n2"), F.sum("same").alias("same"), F.sum(F.col("t").cast("double") * F.col("t")).alias("c")).where("n2 > 0")
    p, e = F.col("same") / F.col("n2"), F.col("c") / (F.col("n2").cast("double") * F.col("n2"))
    return out.select(*group, (F.col("n2") / 2).cast("long").alias("n"), p.alias("agreement"), F.when(e < 1, (p - e) / (1 - e)).otherwise(1.0).alias("kappa"))


def friedman(df: DataFrame, block: str, item: str, value: str, items: int) -> DataFrame:
    """(blocks, chi2): Friedman's statistic with tie correction over blocks that have all items."""
    w = Window.partitionBy(block)
    full = df.where(F.col(value).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == items)
    ties = F.count(F.lit(1)).over(Window.partitionBy(block, value))
    ranked = full.select(item, block, (F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0).alias("r"), (ties * ties - 1.0).alias("t"))
    sums = ranked.groupBy(item).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    out = sums.agg(F.max("n").alias("blocks"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("t").alias("t"))
    k, n = items, F.col("blocks")
    return out.select("blocks", ((12 * F.col("ss") / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - F.col("t") / (n * k * (k * k - 1)))).alias("chi2"))


#: Items of a ranking that is compared in one task; a longer one is refused.
MAX_RANKED = 5_000_000


def discordant(x: np.ndarray) -> int:
    """Pairs i < j with x[i] > x[j], by merging."""
    total, width, x = 0, 1, x.copy()
    while width < len(x):
        for at in range(0, len(x), 2 * width):
            left, right = x[at : at + width], x[at + width : at + 2 * width]
            total += len(left) * len(right) - int(np.searchsorted(left, right, side="right").sum())
            x[at : at + 2 * width] = np.sort(x[at : at + 2 * width], kind="stable")
        width *= 2
    return total


def tau_b(a: np.ndarray, b: np.ndarray) -> float | None:
    """Kendall's tau-b; null where one side has no two different values."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    same = lambda *c: sum(n * (n - 1) // 2 for n in np.unique(np.stack(c), axis=1, return_counts=True)[1].tolist())
    n = len(a) * (len(a) - 1) // 2
    ta, tb, tab = (same(a), same(b), same(a, b)) if len(a) else (0, 0, 0)
    if n in (ta, tb):
        return None
    return (n - ta - tb + tab - 2 * discordant(b)) / math.sqrt((n - ta) * (n - tb))


def kendall(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(tau): Kendall's tau-b over the rows of a ranking table (a row per ranked item, at most MAX_RANKED;
    more are an error), by merging in one task. Rows with a null value are left out."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    rows = rows.select(F.assert_true(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) <= MAX_RANKED, F.lit("ranking too long")).alias("ok"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(1).to_numpy(), x.column(2).to_numpy()) for x in batches]
        x, y = (np.concatenate([p[i] for p in parts] or [np.empty(0)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([tau_b(x, y)], pa.float64())], names=["tau"])

    return rows.coalesce(1).mapInArrow(run, "tau double")


def rank_agreement(ranks: DataFrame, group: list[str]) -> DataFrame:
    """ranks(group, x, y), distinct ranks from 1 -> (group, models, tau, same_top). The ranks of a group
    are gathered in one row, so they must be few (systems an annotator voted on)."""
    rows = ranks.groupBy(*group).agg(F.count(F.lit(1)).alias("models"), F.transform(F.array_sort(F.collect_list(F.struct("x", "y"))), lambda e: e["y"]).alias("l"))
    apart = F.aggregate(F.transform("l", lambda v, i: F.size(F.filter(F.slice("l", i + 2, F.size("l")), lambda z: z < v))), F.lit(0), lambda s, n: s + n)
    n = F.col("models") * (F.col("models") - 1) / 2
    return rows.select(*group, "models", F.when(F.col("models") >= 3, 1 - 2 * apart / n).alias("tau"), (F.col("l")[0] == 1).alias("same_top"))


def binomial_p(wins: int, n: int) -> float:
    """Two-sided exact test of one half: twice the smaller tail, at most 1."""
    if n == 0:
        return 1.0
    k = min(wins, n - wins)
    mass = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    tail = 0.0
    while k >= 0 and mass > tail * 1e-18:
        tail += mass
        mass *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * tail)


def quantile(df: DataFrame, group: list[str], value: str, q: float, buckets: int = 1024) -> DataFrame:
    """(group, quantile) exact, interpolated between neighbours; nulls are left out, and so are groups without
    values; without a group there is always one row. Equal values are counted
    together in every task; the value range of a group is cut into buckets whose counts find the two
    places, and only the values of their buckets are ordered, so no task holds a group."""
    counts = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v")).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    bounds = counts.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    on = [F.col(g).eqNullSafe(F.col(f"_b_{g}")) for g in group]
    bounds = bounds.select(*[F.col(g).alias(f"_b_{g}") for g in group], "_lo", "_hi", "_n")
    met = counts.join(bounds, on) if group else counts.crossJoin(F.broadcast(bounds))  # one row
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)).otherwise(F.lit(0).cast("long"))
    met = met.select(*group, "_v", "_c", "_n", at.alias("_k"))
    sizes = met.groupBy(*group, "_k").agg(F.sum("_c").alias("_s"), F.max("_n").alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # at most buckets + 1 rows
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_s").over(ahead), F.lit(0)))
    place = (F.col("_n") - 1) * F.lit(float(q))
    holds = lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_s"))
    needed = sizes.where(holds(F.floor(place)) | holds(F.ceil(place))).select(*[F.col(g).alias(f"_b_{g}") for g in group], F.col("_k").alias("_bk"), "_before")
    inner = met.join(needed, [*on, F.col("_k") == F.col("_bk")])
    upto = Window.partitionBy(*group, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
    pick = lambda p: F.min(F.when((F.col("_end") > p) & (F.col("_end") - F.col("_c") <= p), F.col("_v")))
    found = inner.groupBy(*group).agg(pick(F.floor(place)).alias("_x"), pick(F.ceil(place)).alias("_y"), F.max(place - F.floor(place)).alias("_f"))
    return found.select(*group, (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_f")).alias("quantile"))


def nominal_alpha(votes: DataFrame, unit: str, label: str) -> DataFrame:
    """(alpha): Krippendorff's alpha over units with two votes or more, from counts per unit and label."""
    m = votes.groupBy(unit, label).agg(F.count(F.lit(1)).alias("m"))
    u = m.groupBy(unit).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm")).where("n > 1")
    t = m.join(u.select(unit), unit, "left_semi").groupBy(label).agg(F.sum("m").cast("double").alias("t"))
    apart = u.agg(F.sum((F.col("n") * F.col("n") - F.col("mm")) / (F.col("n") - 1)).alias("d"))
    total = t.agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t")).alias("ss"))
    expected = (F.col("n") * F.col("n") - F.col("ss")) / F.nullif(F.col("n") - 1, F.lit(0.0))
    return apart.crossJoin(total).select(F.when(expected > 0, 1 - F.col("d") / expected).when(F.col("n") > 0, 1.0).alias("alpha"))  # one row each


def interval_alpha(votes: DataFrame, unit: str, value: str) -> DataFrame:
    """(alpha) with squared differences of a number, from sums per unit."""
    y = F.col(value).cast("double")
    u = votes.where(y.isNotNull()).groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss")).where("n > 1")
    t = u.agg(F.sum(2 * (F.col("n") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("n") - 1)).alias("d"), F.sum("n").cast("double").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    expected = 2 * (F.col("n") * F.col("ss") - F.col("s") * F.col("s")) / F.nullif(F.col("n") - 1, F.lit(0.0))
    return t.select(F.when(expected > 0, 1 - F.col("d") / expected).when(F.col("n") > 0, 1.0).alias("alpha"))


def bootstrap_rate(df: DataFrame, won: str, samples: int = 5000, seed: int = 123) -> DataFrame:
    """(rate, low, high): the share of true rows (null left out) and its 95 % bootstrap interval. A
    resample of yes/no rows is a binomial draw from their counts, so the rows are read once."""
    n, wins = df.where(F.col(won).isNotNull()).agg(F.count(F.lit(1)), F.count_if(F.col(won))).first()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.random.default_rng([seed, i]).binomial(n, wins / n) / n for i in batch.column(0).to_pylist()] if n else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], names=["x"])

    draws = df.sparkSession.range(samples).mapInArrow(draw, "x double")
    return draws.agg(F.lit(wins / n if n else None).cast("double").alias("rate"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def holm(df: DataFrame, p: str, group: list[str], tie: list[str]) -> DataFrame:
    """Adds p_holm: step-down adjusted p-values within the group, at most 1."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    order = w.orderBy(p, *tie)
    scaled = F.least(F.lit(1.0), F.col(p) * (F.count(F.lit(1)).over(w) - F.row_number().over(order) + 1))
    return df.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def league(df: DataFrame, a: str, b: str, label: str, group: list[str], count: str | None = None) -> DataFrame:
    """(group, model, points): 3 for a win, 1 for both sides where neither is good; a row stands for
    `count` votes, for one if not given."""
    n = F.col(count) if count else F.lit(1)
    part = lambda win: (F.when(F.col(label) == win, 3).when(F.col(label) == 2, 1).otherwise(0) * n).alias("points")
    sides = F.array(F.struct(F.col(a).alias("model"), part(0)), F.struct(F.col(b).alias("model"), part(1)))
    return df.select(*group, F.inline(sides)).where("model IS NOT NULL").groupBy(*group, "model").agg(F.sum("points").alias("points"))


_ROUGE = "p1 double, r1 double, f1 double, p2 double, r2 double, f2 double, pl double, rl double, fl double"


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit rows: one pass of big whole numbers per token."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        met = row & at.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def rouge(df: DataFrame, a: str, b: str, stem: bool = True) -> DataFrame:
    """df with precision, recall and F1 of ROUGE-1, -2 and -L of text b against text a. Tokens are runs of
    a-z and 0-9 in lower case, stemmed from four letters on if wanted. Null texts count as empty."""
    import re
    from collections import Counter

    from acervo.functions.stemming import stem as stemmed

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + _ROUGE
    token = re.compile("[a-z0-9]+")

    def words(text: str | None) -> list[str]:
        found = token.findall((text or "").lower())
        return [stemmed(w) if len(w) > 3 else w for w in found] if stem else found

    def scores(hits: int, said: int, wanted: int) -> tuple[float, float, float]:
        p, r = hits / max(1, said), hits / max(1, wanted)
        return p, r, 2 * p * r / (p + r) if p + r else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = (batch.schema.get_field_index(c) for c in (a, b))
            rows = []
            for x, y in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist()):
                u, v, row = words(x), words(y), []
                for n in (1, 2):
                    want, said = (Counter(zip(*[t[k:] for k in range(n)])) for t in (u, v))
                    row += scores((want & said).total(), said.total(), want.total())
                rows.append(row + list(scores(common_length(u, v), len(v), len(u))))
            cells = [pa.array([r[k] for r in rows], pa.float64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*batch.schema.names, *[f.split()[0] for f in _ROUGE.split(", ")]])

    return df.mapInArrow(run, fields)


def greedy_match(df: DataFrame, a: str, b: str, encoder, out: str = "bert") -> DataFrame:
    """df with precision, recall and F1 of text b against text a by token vectors: every token of one side takes
    its best cosine on the other. The encoder gives unit vectors for a list of tokens; a model's can be
    injected. Texts without tokens score 0."""
    import re

    token = re.compile(r"[^\W]+")
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {out}_p double, {out}_r double, {out}_f1 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = (batch.schema.get_field_index(c) for c in (a, b))
            rows = []
            for x, y in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist()):
                u, v = (token.findall((t or "").lower()) for t in (x, y))
                if not u or not v:
                    rows.append((0.0, 0.0, 0.0))
                    continue
                cos = np.asarray(encoder(v)) @ np.asarray(encoder(u)).T
                p, r = float(cos.max(axis=1).mean()), float(cos.max(axis=0).mean())
                rows.append((p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]], names=[*batch.schema.names, f"{out}_p", f"{out}_r", f"{out}_f1"])

    return df.mapInArrow(run, fields)


def promoters(df: DataFrame, group: list[str], rating: str) -> DataFrame:
    """(group, n, mean, score): number and mean of the ratings, and the percentage of 9 and 10 less that of 0
    to 6. Nulls are left out."""
    rows = df.where(F.col(rating).isNotNull())
    share = 100.0 * (F.count_if(F.col(rating) >= 9) - F.count_if(F.col(rating) <= 6)) / F.count(F.lit(1))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(rating).alias("mean"), share.alias("score"))
