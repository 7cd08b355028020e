"""Global ranking from pairwise comparisons.

Regularised logistic paired-comparison strengths, fitted by minorisation-maximisation on win
counts aggregated per (group, item, opponent): every sweep joins the counts with the strengths of
both sides and sums by item. The strengths are broadcast up to SMALL items, counted first, and joined
beyond. Every sweep's result is written; from the steps of two the next ones start by squared
extrapolation, as sweeps alone creep. `prior` wins and losses against an opponent of strength 1 keep
undefeated items finite and join separate components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.operators.ranking import bucket_rank
from acervo.runtime import cut, discard, materialise

#: Items whose strengths (some 100 bytes each) are broadcast at most; items of a group whose information
#: matrix is inverted in one piece, which takes one task and 8 WHOLE^2 bytes; items on a side of the blocks beyond.
SMALL, WHOLE, SIDE = 100_000, 1500, 512
_BLOCKS = "task string, i int, j int, items int, m binary"


def win_counts(votes: DataFrame, compared: DataFrame) -> DataFrame:
    """(task, winner, loser, n) of votes that name a winner, on comparisons of two different, known
    systems. Votes are counted per comparison before the join, so a hot comparison is one row."""
    counts = votes.groupBy("instance_id").agg(F.count_if(F.col("label") == 0).alias("wa"), F.count_if(F.col("label") == 1).alias("wb")).where("wa + wb > 0")
    met = counts.join(compared.where("task IS NOT NULL AND a <> b"), "instance_id")
    sides = F.array(F.struct(F.col("a").alias("winner"), F.col("b").alias("loser"), F.col("wa").alias("n")), F.struct(F.col("b").alias("winner"), F.col("a").alias("loser"), F.col("wb").alias("n")))
    return met.select("task", F.inline(sides)).where("n > 0").groupBy("task", "winner", "loser").agg(F.sum("n").alias("n"))


def components(pairs: DataFrame) -> DataFrame:
    """(task, item, component): the smallest item reachable by comparisons, by label spreading with
    pointer jumping; every round is durable."""
    at = cut(pairs.groupBy("task", "item").agg(F.least("item", F.min("other")).alias("component")))
    while True:
        near = pairs.join(at.select("task", F.col("item").alias("other"), F.col("component").alias("c")), ["task", "other"]).groupBy("task", "item").agg(F.min("c").alias("near"))
        spread = at.select("task", "item", "component").join(near, ["task", "item"]).select("task", "item", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = spread.select("task", F.col("item").alias("component"), F.col("component").alias("further"))
        after = cut(spread.join(jump, ["task", "component"]).select("task", "item", F.least("component", "further").alias("component"), "was"), old=at)
        changed = after.where("component <> was").limit(1).count()
        at = after
        if not changed:
            return at.select("task", "item", "component")


def inverse_diagonal(cells: DataFrame, size: int = SIDE) -> DataFrame:
    """cells(task, item, other, w) of symmetric positive definite matrices -> (task, item, v): the diagonal of their
    inverses, of any size: square blocks of `size` items are swept in turn, the blocks above the diagonal alone
    are kept, and a task holds three of them. Every sweep's blocks are written; a finished matrix stays as it is."""
    names = cells.groupBy("task", "item").agg(F.lit(1).alias("one"))
    at = materialise(names.select("task", "item", (F.row_number().over(Window.partitionBy("task").orderBy("item")) - 1).alias("at")), "places")
    counts = at.groupBy("task").agg(F.count(F.lit(1)).cast("int").alias("items"))
    turns = -(-(counts.agg(F.max("items")).first()[0] or 0) // size)
    placed = cells.join(at.withColumnRenamed("at", "r"), ["task", "item"]).join(at.select("task", F.col("item").alias("other"), F.col("at").alias("c")), ["task", "other"])
    placed = placed.select("task", F.floor(F.col("r") / size).cast("int").alias("i"), F.floor(F.col("c") / size).cast("int").alias("j"), (F.col("r") % size).cast("int").alias("r"), (F.col("c") % size).cast("int").alias("c"), "w").where("i <= j")
    last = F.floor((F.col("items") - 1) / size).cast("int")
    every = counts.select("task", F.explode(F.sequence(F.lit(0), last)).alias("i"), last.alias("last")).select("task", "i", F.explode(F.sequence(F.col("i"), F.col("last"))).alias("j"))
    zero = F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("w")  # sweeps fill blocks without cells
    rows = placed.unionByName(every.select("task", "i", "j", *zero)).join(counts, "task")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        m = np.zeros([min(size, head["items"] - size * head[x]) for x in "ij"])
        np.add.at(m, (frame["r"].to_numpy(), frame["c"].to_numpy()), frame["w"].to_numpy())
        return pd.DataFrame({"task": [head["task"]], "i": [head["i"]], "j": [head["j"]], "items": [head["items"]], "m": [m.tobytes()]})

    def block(cell: bytes, rows: int, cols: int, items: int) -> np.ndarray:
        return np.frombuffer(cell).reshape(min(size, items - size * rows), min(size, items - size * cols))

    state = cut(rows.groupBy("task", "i", "j").applyInPandas(build, _BLOCKS), "matrix")
    for k in range(turns):

        def side(frame: pd.DataFrame) -> pd.DataFrame:
            """The block of a row with the pivot's column, and its product with the pivot's inverse."""
            x = frame.iloc[0]
            a = block(x["m"], x["i"], x["j"], x["items"])
            a = a if x["j"] == k else a.T
            return pd.DataFrame({"task": [x["task"]], "at": [x["i"] if x["j"] == k else x["j"]], "a": [a.tobytes()], "b": [np.dot(a, np.linalg.inv(block(x["pivot"], k, k, x["items"]))).tobytes()]})

        def swept(frame: pd.DataFrame) -> pd.DataFrame:
            x = frame.iloc[0]
            m, items = block(x["m"], x["i"], x["j"], x["items"]), x["items"]
            if x["i"] == k == x["j"]:
                m = -np.linalg.inv(m)
            elif k == x["j"]:
                m = block(x["b"], x["i"], k, items)
            elif k == x["i"]:
                m = block(x["b"], x["j"], k, items).T
            else:
                m = m - block(x["b"], x["i"], k, items) @ block(x["a"], x["j"], k, items).T
            return pd.DataFrame({**{n: [x[n]] for n in ("task", "i", "j", "items")}, "m": [m.tobytes()]})

        open_, here = state.where(F.col("items") > k * size), (F.col("i") == k) | (F.col("j") == k)
        pivot = open_.where((F.col("i") == k) & (F.col("j") == k)).select("task", F.col("m").alias("pivot"))
        sides = cut(open_.where(here & (F.col("i") != F.col("j"))).join(pivot, "task").groupBy("task", "i", "j").applyInPandas(side, "task string, at int, a binary, b binary"), "sides")
        left = open_.withColumn("at", F.when(F.col("i") == k, F.col("j")).otherwise(F.col("i")))  # of a block in the pivot's row the other side
        met = left.join(sides.select("task", "at", "b"), ["task", "at"], "left").drop("at").join(sides.select("task", F.col("at").alias("j"), "a"), ["task", "j"], "left")
        done = met.groupBy("task", "i", "j").applyInPandas(swept, _BLOCKS).unionByName(state.where(F.col("items") <= k * size))
        state = cut(done, "matrix", old=state)
        discard(sides)

    def diagonal(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.iloc[0]
        v = -np.diag(block(x["m"], x["i"], x["i"], x["items"]))
        return pd.DataFrame({"task": x["task"], "at": x["i"] * size + np.arange(len(v)), "v": v})

    values = state.where("i = j").groupBy("task", "i").applyInPandas(diagonal, "task string, at int, v double")
    return at.join(values, ["task", "at"]).select("task", "item", "v")


def spread(pairs: DataFrame, prior: float, dense: int | None = None, whole: int = WHOLE) -> DataFrame:
    """pairs(task, item, other, n, p, q) -> (task, item, se, se_exact): the standard error of the log
    strength from the curvature at the fit, the root of the diagonal of the inverted information matrix.
    Groups of at most `whole` items are inverted in one piece, larger ones in blocks, to the same result.
    A caller who names `dense` has the root of the inverted diagonal for groups of more items, which leaves
    out what the others' errors add, and se_exact false."""
    bend = pairs.withColumn("w", F.col("n") * F.col("p") * F.col("q") / (F.col("p") + F.col("q")) ** 2)
    own = bend.groupBy("task", "item").agg((F.sum("w") + F.max(2 * prior * F.col("p") / (F.col("p") + 1) ** 2)).alias("d"))
    sizes = own.groupBy("task").agg(F.count(F.lit(1)).alias("items"))
    most = sizes.agg(F.max("items")).first()[0] or 0
    rough = F.lit(False) if dense is None else F.col("items") > dense
    cells = bend.select("task", "item", "other", (-F.col("w")).alias("w")).unionByName(own.select("task", "item", F.col("item").alias("other"), F.col("d").alias("w")))

    def invert(frame: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([frame["item"], frame["other"]]).astype(object), return_inverse=True)
        info = np.zeros((len(names), len(names)))
        np.add.at(info, (at[: len(frame)], at[len(frame) :]), frame["w"].to_numpy())
        return pd.DataFrame({"task": frame["task"].iloc[0], "item": names, "se": np.sqrt(np.diag(np.linalg.inv(info))), "se_exact": True})

    of = lambda which: cells.join(sizes.where(which).select("task"), "task")
    out = of(~rough & (F.col("items") <= whole)).groupBy("task").applyInPandas(invert, "task string, item string, se double, se_exact boolean")
    if most > whole:
        large = inverse_diagonal(of(~rough & (F.col("items") > whole)), SIDE)
        out = out.unionByName(large.select("task", "item", F.sqrt("v").alias("se"), F.lit(True).alias("se_exact")))
    if dense is not None:
        out = out.unionByName(own.join(sizes.where(rough), "task").select("task", "item", (1 / F.sqrt("d")).alias("se"), F.lit(False).alias("se_exact")))
    return out


def rank_items(wins: DataFrame, prior: float = 0.5, tolerance: float = 1e-6, sweeps: int = 400, small: int = SMALL, dense: int | None = None, whole: int = WHOLE) -> DataFrame:
    """(task, model, strength, se, se_exact, wins, losses, opponents, component, converged, rank) for every item.

    strength is the logarithm, se its standard error (see `spread`); items of equal strength rank by
    name. The fit ends when no strength moves by `tolerance` in a sweep; converged says whether it did
    within `sweeps`. Without wins there are no rows.
    """
    both = wins.select("task", F.col("winner").alias("item"), F.col("loser").alias("other"), F.col("n").alias("won"), F.lit(0).cast("long").alias("lost"))
    both = both.unionByName(wins.select("task", F.col("loser").alias("item"), F.col("winner").alias("other"), F.lit(0).cast("long").alias("won"), F.col("n").alias("lost")))
    pairs = materialise(both.groupBy("task", "item", "other").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost")), "pairs")
    met = pairs.select("task", "item", "other", (F.col("won") + F.col("lost")).cast("double").alias("n"))
    first = pairs.groupBy("task", "item").agg(F.sum("won").alias("wins"), F.sum("lost").alias("losses"), F.count(F.lit(1)).alias("opponents"))
    items = materialise(first.join(components(pairs), ["task", "item"]), "items")
    one = F.broadcast if items.count() <= small else (lambda df: df)
    fixed = items.select("task", "item", "component", (F.col("wins") + prior).alias("gain"))

    def sides(now: DataFrame) -> DataFrame:
        return met.join(one(now.select("task", "item", "p")), ["task", "item"]).join(one(now.select("task", F.col("item").alias("other"), F.col("p").alias("q"))), ["task", "other"])

    def sweep(now: DataFrame) -> DataFrame:
        """p after a sweep, was before it; p0 is kept. A written state, as it stands in the plan of the next
        sweep more than once."""
        more = [c for c in now.columns if c == "p0"]
        rates = met.join(one(now.select("task", "item", "p", *more)), ["task", "item"]).join(one(now.select("task", F.col("item").alias("other"), F.col("p").alias("q"))), ["task", "other"])
        sums = rates.groupBy("task", "item").agg(F.sum(F.col("n") / (F.col("p") + F.col("q"))).alias("s"), F.max("p").alias("was"), *[F.max(c).alias(c) for c in more])
        rows = sums.join(one(fixed), ["task", "item"])
        return cut(rows.select("task", "item", "component", (F.col("gain") / (F.col("s") + 2 * prior / (F.col("was") + 1))).alias("p"), "was", *more))

    def levelled(now: DataFrame) -> DataFrame:
        """The common level of a component hangs on the prior alone, so sweeps move it slowly: a Newton
        step puts the mean win probability against strength 1 at a half."""
        s = F.col("p") / (F.col("p") + 1)
        step = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.count(F.lit(1)) / 2 - F.sum(s)) / F.sum(s * (1 - s))))
        shift = now.groupBy("task", "component").agg(F.exp(step).alias("shift"))
        return now.join(one(shift), ["task", "component"]).withColumn("p", F.col("p") * F.col("shift")).drop("shift")

    start = items.select("task", "item", "component", F.lit(1.0).alias("p"))
    state, converged, best = None, False, float("inf")
    for _ in range(0, sweeps, 2):
        level = cut(levelled(start), old=state)
        once = sweep(level)
        state = sweep(once.withColumnRenamed("was", "p0"))
        discard(level), discard(once)
        r, v = F.log(F.col("was") / F.col("p0")), F.log(F.col("p") / F.col("was")) - F.log(F.col("was") / F.col("p0"))
        moved, step, bend = state.agg(F.max(F.abs(F.log(F.col("p") / F.col("was")))), F.sum(r * r), F.sum(v * v)).first()
        if converged := moved is None or moved < tolerance:
            break
        reach = min(max((step / bend) ** 0.5, 1.0), 256.0) if bend and moved < 2 * best else 1.0  # 1 is the plain second sweep
        best = min(best, moved)
        far = F.col("reach")  # a cell, not a literal, so that every cycle runs the same compiled code
        ahead = state.crossJoin(F.broadcast(wins.sparkSession.createDataFrame([(float(reach),)], "reach double")))  # one row
        start = ahead.select("task", "item", "component", (F.col("p0") * F.exp(2 * far * r + far * far * v)).alias("p"))
    fit = items.join(state.select("task", "item", "p"), ["task", "item"]).join(spread(sides(state), prior, dense, whole), ["task", "item"])
    fit = fit.select("task", F.col("item").alias("model"), F.log("p").alias("strength"), "se", "se_exact", "wins", "losses", "opponents", "component", F.lit(converged).alias("converged"))
    fit = cut(fit.withColumn("band", F.floor(F.col("strength") * -64)))
    return bucket_rank(fit, ["task"], "band", [F.desc("strength"), F.asc("model")]).drop("band")
