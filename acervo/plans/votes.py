"""Statistics of votes: agreement, points, ranks and tests over every valid vote and the systems' proper names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from acervo.operators import evaluation as E
from acervo.operators.annotation import LABELS
from acervo.operators.retrieval import tokens
from acervo.operators.votes import systems, valid_votes
from acervo.plans.registry import query
from acervo.runtime import table
from acervo.sources import sinks

# The statements read a vote by its letters alone, another way than the operators' pattern.
_V = r"""said AS (SELECT annotation_id, annotator, instance_id, annotated_at, trim(regexp_replace(lower(selected_model), '[^a-z]+', ' ', 'g')) AS s
  FROM annotations WHERE annotator IS NOT NULL AND instance_id IN (SELECT id FROM pair_comparisons)),
lab AS (SELECT *, CASE WHEN s IN ('a es mejor', 'a es mejor true', 'a es mejor a es mejor') THEN 'A es mejor' WHEN s IN ('b es mejor', 'b es mejor true', 'b es mejor b es mejor') THEN 'B es mejor'
  WHEN s IN ('ambos son malos', 'ambos son malos true', 'ambos son malos ambos son malos') THEN 'Ambos son malos' END AS selected_model FROM said),
v AS (SELECT instance_id, annotator, selected_model FROM lab WHERE selected_model IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY instance_id, annotator ORDER BY annotated_at DESC NULLS LAST, annotation_id DESC) = 1)"""
_N = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))".format
_PC = f"""nm AS (SELECT {_N("alias")} AS k, min(model) AS m FROM (SELECT alias, model FROM model_alias UNION ALL SELECT model, model FROM model_alias) GROUP BY 1),
pc AS (SELECT DISTINCT id, {_N("task_type")} AS task, place_id, x.m AS a, y.m AS b FROM pair_comparisons
  LEFT JOIN nm x ON x.k = {_N("item_a_model")} LEFT JOIN nm y ON y.k = {_N("item_b_model")})"""
_TWO = "two AS (SELECT x.instance_id, x.selected_model AS a, y.selected_model AS b FROM v x JOIN v y ON x.instance_id = y.instance_id AND x.annotator <> y.annotator)"
_PTS = f"""{_V}, {_PC}, pt AS (
  SELECT task, place_id, annotator, a AS model, CASE selected_model WHEN 'A es mejor' THEN 3 WHEN 'Ambos son malos' THEN 1 ELSE 0 END AS points FROM v JOIN pc ON pc.id = v.instance_id WHERE a IS NOT NULL
  UNION ALL SELECT task, place_id, annotator, b, CASE selected_model WHEN 'B es mejor' THEN 3 WHEN 'Ambos son malos' THEN 1 ELSE 0 END FROM v JOIN pc ON pc.id = v.instance_id WHERE b IS NOT NULL)"""


def votes(spark, d):
    return valid_votes(table(spark, d, "annotations"), table(spark, d, "pair_comparisons"))


def compared(spark, d):
    return systems(table(spark, d, "pair_comparisons"), table(spark, d, "model_alias"))


def named(rows):
    return rows.withColumn("selected_model", F.array(*[F.lit(x) for x in LABELS])[F.col("label")])


def label_pairs(rows):
    """(instance_id, a, b, m): how often an annotator said a where another said b, over all ordered pairs of
    a comparison's annotators, from its counts of labels."""
    m = named(rows).groupBy("instance_id", "selected_model").agg(F.count(F.lit(1)).alias("m"))
    x, y = m.withColumnsRenamed({"selected_model": "a", "m": "x"}), m.withColumnsRenamed({"selected_model": "b", "m": "y"})
    apart = F.col("x") * (F.col("y") - F.when(F.col("a") == F.col("b"), 1).otherwise(0))
    return x.join(y, "instance_id").select("instance_id", "a", "b", apart.alias("m")).where("m > 0")


def points(spark, d, by):
    """Points by the groups in `by` and model. Votes are counted per comparison, by label and annotator
    where that is asked for, before they meet the names."""
    keys = ["instance_id", "label", *(["annotator"] if "annotator" in by else [])]
    counts = votes(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(compared(spark, d), "instance_id")
    return E.league(counts, "a", "b", "label", by, "n")


@query("e8_cohen_kappa", f"WITH {_V}, {_TWO}, n AS (SELECT count(*)::DOUBLE AS n, count_if(a = b) / count(*)::DOUBLE AS p FROM two), e AS (SELECT sum(m * m) AS c FROM (SELECT a, count(*) AS m FROM two GROUP BY 1)) SELECT (n / 2)::BIGINT AS n, round(p, 6) AS agreement, round((p - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n, e")
def e8(spark, d):
    """Over all pairs of annotators of a comparison, n pairs; an annotator is as often first as second."""
    return E.pair_kappa(label_pairs(votes(spark, d)), []).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("e8_kappa_by_task", f"WITH {_V}, {_PC}, {_TWO}, t AS (SELECT task, two.a, two.b FROM two JOIN pc ON pc.id = instance_id), n AS (SELECT task, count(*)::DOUBLE AS n, count_if(a = b) / count(*)::DOUBLE AS p FROM t GROUP BY 1), e AS (SELECT task, sum(m * m) AS c FROM (SELECT task, a, count(*) AS m FROM t GROUP BY 1, 2) GROUP BY 1) SELECT task, (n / 2)::BIGINT AS n, round(p, 6) AS agreement, round((p - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n JOIN e USING (task) WHERE n >= 20")
def e8b(spark, d):
    """As e8_cohen_kappa for every task with ten pairs or more."""
    rows = label_pairs(votes(spark, d)).join(compared(spark, d).select("instance_id", "task"), "instance_id").select("task", "a", "b", "m")
    return E.pair_kappa(rows, ["task"]).where("n >= 10").select("task", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("e7_binomial_holm", f"""WITH {_V}, {_PC}, w AS (SELECT least(a, b) AS x, greatest(a, b) AS y, (a < b) = (selected_model = 'A es mejor') AS won FROM v JOIN pc ON pc.id = instance_id WHERE selected_model <> 'Ambos son malos' AND a <> b),
c AS (SELECT x AS a, y AS b, count(*) AS n, count_if(won) AS wins FROM w GROUP BY 1, 2 HAVING count(*) >= 10),
k AS (SELECT a, b, n, wins, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) AS m, exp(lgamma(n + 1) - lgamma(wins + 1) - lgamma(n - wins + 1) - n * ln(2)) AS seen FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM c)),
p AS (SELECT a, b, n, wins, least(1, sum(CASE WHEN m <= seen * 1.0000001 THEN m ELSE 0 END)) AS p FROM k GROUP BY a, b, n, wins),
s AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY round(p, 12), a, b) + 1)) AS s FROM p)
SELECT a, b, n, wins, round(p, 8) AS p, round(max(s) OVER (ORDER BY round(p, 12), a, b ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s""")
def e7(spark, d):
    """Exact two-sided test of wins of A against B per pair of systems with ten votes or more; Holm's
    adjustment over the pairs. The p-value is a pandas function of the two counts."""
    import pandas as pd

    counts = votes(spark, d).where("label < 2").groupBy("instance_id", "label").agg(F.count(F.lit(1)).alias("m"))
    met = counts.join(compared(spark, d), "instance_id").where("a <> b")
    won = F.when((F.col("a") < F.col("b")) == (F.col("label") == 0), F.col("m")).otherwise(0)
    pairs = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("m").alias("n"), F.sum(won).alias("wins")).where("n >= 10")
    test = F.pandas_udf(lambda w, n: pd.Series([E.binomial_p(int(x), int(y)) for x, y in zip(w, n)], dtype=float), "double")
    out = E.holm(pairs.withColumn("p", F.round(test("wins", "n"), 12)), "p", [], ["a", "b"])
    return out.select("a", "b", "n", "wins", F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"))


@query("e9_pairwise_winners", f"WITH {_V}, {_TWO} SELECT a, b, count(*) AS n FROM two GROUP BY ALL")
def e9(spark, d):
    """Labels of all ordered pairs of annotators of a comparison."""
    return label_pairs(votes(spark, d)).groupBy("a", "b").agg(F.sum("m").alias("n"))


@query("e9_winner_agreement", f"WITH {_V}, {_PC}, {_TWO}, t AS (SELECT task, (two.a = two.b OR coalesce(pc.a = pc.b, false))::INT AS same FROM two JOIN pc ON pc.id = instance_id WHERE two.a <> 'Ambos son malos' AND two.b <> 'Ambos son malos'), g AS (SELECT task, count(*) AS m, sum(same) AS s FROM t GROUP BY 1) SELECT task, (m // 2)::BIGINT AS n, round(s / m, 6) AS same_winner FROM g WHERE m >= 40 UNION ALL SELECT NULL, (sum(m) // 2)::BIGINT, round(sum(s) / sum(m), 6) FROM g HAVING sum(m) > 0")
def e9b(spark, d):
    """(task, n, same_winner): the share of annotator pairs that chose the same side, over comparisons where
    both chose A or B; task null is all tasks. Tasks of fewer than 20 pairs are left out, as in the reference."""
    names = compared(spark, d).select("instance_id", "task", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("one"))
    rows = label_pairs(votes(spark, d)).where("a <> 'Ambos son malos' AND b <> 'Ambos son malos'").join(names, "instance_id")
    by = rows.groupBy("task").agg(F.sum("m").alias("m"), F.sum(F.when((F.col("a") == F.col("b")) | F.col("one"), F.col("m")).otherwise(0)).alias("s"))
    total = by.agg(F.lit(None).cast("string").alias("task"), F.sum("m").alias("m"), F.sum("s").alias("s")).where("m > 0")
    return by.where("m >= 40").unionByName(total).select("task", (F.col("m") / 2).cast("long").alias("n"), F.round(F.col("s") / F.col("m"), 6).alias("same_winner"))


@query("e9_rank_agreement", f"""WITH {_PTS}, own AS (SELECT task, annotator, model, sum(points) AS p FROM pt GROUP BY ALL), al AS (SELECT task, model, sum(points) AS t FROM pt GROUP BY ALL),
r AS (SELECT task, annotator, model, row_number() OVER (PARTITION BY task, annotator ORDER BY p DESC, model) AS x, row_number() OVER (PARTITION BY task, annotator ORDER BY t - p DESC, model) AS y FROM own JOIN al USING (task, model)),
k AS (SELECT a.task, a.annotator, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) AS n FROM r a JOIN r b ON a.task = b.task AND a.annotator = b.annotator AND a.model < b.model GROUP BY 1, 2),
m AS (SELECT task, annotator, count(*) AS models, bool_or(x = 1 AND y = 1) AS same_top FROM r GROUP BY 1, 2)
SELECT task, annotator, models, round(CASE WHEN models >= 3 THEN s / n END, 6) AS tau, same_top FROM m LEFT JOIN k USING (task, annotator)""")
def e9c(spark, d):
    """(task, annotator, models, tau, same_top): an annotator's ranking of the systems by points against the
    one by all other votes, over the systems they voted on: Kendall's tau (null below three systems)
    and whether the first is the same. Ties by name, so ranks are distinct."""
    own = points(spark, d, ["task", "annotator"])
    both = own.join(own.groupBy("task", "model").agg(F.sum("points").alias("t")), ["task", "model"])
    w = Window.partitionBy("task", "annotator")
    r = both.select("task", "annotator", F.row_number().over(w.orderBy(F.desc("points"), "model")).alias("x"), F.row_number().over(w.orderBy(F.desc(F.col("t") - F.col("points")), "model")).alias("y"))
    return E.rank_agreement(r, ["task", "annotator"]).select("task", "annotator", "models", F.round("tau", 6).alias("tau"), "same_top")


@query("a12_league_points", f"WITH {_PTS} SELECT task, model, sum(points)::BIGINT AS points FROM pt GROUP BY ALL")
def a12(spark, d):
    return points(spark, d, ["task"]).select("task", "model", F.col("points").cast("long").alias("points"))


@query("e12_rank_distribution", f"WITH {_PTS}, s AS (SELECT task, model, sum(points) AS points FROM pt GROUP BY ALL) SELECT task, model, row_number() OVER (PARTITION BY task ORDER BY points DESC, model) AS rank FROM s")
def e12(spark, d):
    return points(spark, d, ["task"]).select("task", "model", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("points"), "model")).cast("long").alias("rank"))


@query("e12_place_ranks", f"WITH {_PTS}, s AS (SELECT task, place_id, model, sum(points) AS points FROM pt GROUP BY ALL), r AS (SELECT task, model, row_number() OVER (PARTITION BY task, place_id ORDER BY points DESC, model) AS rank FROM s) SELECT task, model, rank, count(*) AS n FROM r GROUP BY ALL")
def e12b(spark, d):
    """(task, model, rank, n): at how many places a model has this rank by points, ties by name."""
    rank = F.row_number().over(Window.partitionBy("task", "place_id").orderBy(F.desc("points"), "model")).cast("long")
    return points(spark, d, ["task", "place_id"]).withColumn("rank", rank).groupBy("task", "model", "rank").agg(F.count(F.lit(1)).alias("n"))


_AL = """m AS (SELECT instance_id, selected_model, count(*) AS m FROM v GROUP BY ALL), u AS (SELECT instance_id, sum(m) AS n FROM m GROUP BY 1 HAVING sum(m) > 1)"""


@query("e13_krippendorff", f"WITH {_V}, {_AL}, o AS (SELECT sum(m * (n - m) / (n - 1)::DOUBLE) AS d FROM m JOIN u USING (instance_id)), t AS (SELECT selected_model, sum(m)::DOUBLE AS t FROM m SEMI JOIN u USING (instance_id) GROUP BY 1), a AS (SELECT sum(t) AS n FROM t) SELECT round(1 - d / (SELECT sum(t * (n - t)) / (any_value(n) - 1) FROM t, a), 6) AS alpha FROM o")
def e13(spark, d):
    return E.nominal_alpha(votes(spark, d), "instance_id", "label").select(F.round("alpha", 6).alias("alpha"))


@query("e13_interval_alpha", f"""WITH {_V}, x AS (SELECT instance_id, CASE selected_model WHEN 'A es mejor' THEN 1.0 WHEN 'B es mejor' THEN -1.0 ELSE 0.0 END AS y FROM v),
u AS (SELECT instance_id, count(*) AS n FROM x GROUP BY 1 HAVING count(*) > 1), p AS (SELECT a.instance_id, sum((a.y - b.y) * (a.y - b.y)) AS d FROM x a JOIN x b USING (instance_id) GROUP BY 1),
o AS (SELECT sum(d / (n - 1)) AS d, sum(n) AS n FROM p JOIN u USING (instance_id)), c AS (SELECT y, count(*)::DOUBLE AS m FROM x SEMI JOIN u USING (instance_id) GROUP BY 1), e AS (SELECT sum(a.m * b.m * (a.y - b.y) * (a.y - b.y)) AS e FROM c a, c b)
SELECT round(1 - (d / n) / (e / (n * (n - 1))), 6) AS alpha FROM o, e""")
def e13b(spark, d):
    """Votes as places on a scale: A 1, neither 0, B -1."""
    scale = F.array(F.lit(1.0), F.lit(-1.0), F.lit(0.0))[F.col("label")]
    return E.interval_alpha(votes(spark, d).withColumn("y", scale), "instance_id", "y").select(F.round("alpha", 6).alias("alpha"))


@query("a12_comparison_table", f"WITH {_PTS}, s AS (SELECT task, model, sum(points) AS points, median(points) AS med FROM pt GROUP BY ALL) SELECT task, model, points::BIGINT AS points, med, rank() OVER (PARTITION BY task ORDER BY points DESC) AS place FROM s")
def e14(spark, d):
    """A vote gives 0, 1 or 3 points, so the median takes three counts."""
    counts = votes(spark, d).groupBy("instance_id", "label").agg(F.count(F.lit(1)).alias("n")).join(compared(spark, d), "instance_id")
    part = lambda win: F.when(F.col("label") == win, 3).when(F.col("label") == 2, 1).otherwise(0)
    sides = F.array(F.struct(F.col("a").alias("model"), part(0).alias("p"), "n"), F.struct(F.col("b").alias("model"), part(1).alias("p"), "n"))
    cells = counts.select("task", F.inline(sides)).where("model IS NOT NULL").groupBy("task", "model").agg(*[F.sum(F.when(F.col("p") == p, F.col("n")).otherwise(0)).alias(f"n{p}") for p in (0, 1, 3)])
    n = F.col("n0") + F.col("n1") + F.col("n3")
    at = lambda i: F.when(F.col("n0") > i, 0.0).when(F.col("n0") + F.col("n1") > i, 1.0).otherwise(3.0)
    s = cells.select("task", "model", (F.col("n1") + 3 * F.col("n3")).alias("points"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("med"))
    return s.withColumn("place", F.rank().over(Window.partitionBy("task").orderBy(F.desc("points"))).cast("long"))


_TK = r"list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''))".format
_F1 = """CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END""".format
_MET = f"tx AS (SELECT DISTINCT id, {_TK('text_option_a')} AS ta, {_TK('text_option_b')} AS tb, {_TK('reference_text')} AS tr FROM pair_comparisons), mt AS (SELECT id, {_F1('ta', 'tr')} AS fa, {_F1('tb', 'tr')} AS fb FROM tx)"


def metric(spark, d):
    """(instance_id, fa, fb): token F1 of both options of a comparison against its reference text."""
    rows = table(spark, d, "pair_comparisons").select(F.col("id").alias("instance_id"), "text_option_a", "text_option_b", "reference_text").distinct()
    f1 = lambda c: E.overlap(tokens(F.col(c)), tokens(F.col("reference_text")))[2]
    return rows.select("instance_id", f1("text_option_a").alias("fa"), f1("text_option_b").alias("fb"))


@query("e11_metric_sign", f"WITH {_V}, {_PC}, {_MET}, r AS (SELECT task, sign(round(fa - fb, 9)) AS p, CASE selected_model WHEN 'A es mejor' THEN 1 WHEN 'B es mejor' THEN -1 ELSE 0 END AS y FROM v JOIN pc ON pc.id = instance_id JOIN mt ON mt.id = instance_id) SELECT task, count(*) AS n, count_if(y <> 0) AS decided, count_if(y <> 0 AND p = y) AS correct, round(count_if(y <> 0 AND p = y) / nullif(count_if(y <> 0), 0), 6) AS accuracy FROM r GROUP BY task")
def e11(spark, d):
    """(task, n, decided, correct, accuracy): how often the sign of the metric's difference is the choice
    of a vote; votes for neither are counted in n only."""
    counts = votes(spark, d).groupBy("instance_id", "label").agg(F.count(F.lit(1)).alias("m"))
    rows = counts.join(compared(spark, d), "instance_id").join(metric(spark, d), "instance_id")
    said, sign = F.array(F.lit(1), F.lit(-1), F.lit(0))[F.col("label")], F.signum(F.round(F.col("fa") - F.col("fb"), 9))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("m"))), F.lit(0))
    by = rows.groupBy("task").agg(F.sum("m").alias("n"), count(said != 0).alias("decided"), count((said != 0) & (sign == said)).alias("correct"))
    return by.select("task", "n", "decided", "correct", F.round(F.col("correct") / F.nullif("decided", F.lit(0)), 6).alias("accuracy"))


@query("e14_comparison", f"""WITH {_PTS}, {_MET}, {_TWO}, s AS (SELECT task, model, sum(points)::BIGINT AS points FROM pt GROUP BY ALL),
o AS (SELECT task, a AS model, round(fa, 6) AS f FROM pc JOIN mt USING (id) WHERE a IS NOT NULL UNION ALL SELECT task, b, round(fb, 6) FROM pc JOIN mt USING (id) WHERE b IS NOT NULL), md AS (SELECT task, model, round(median(f), 8) AS median_metric FROM o GROUP BY ALL),
t AS (SELECT task, two.a, two.b FROM two JOIN pc ON pc.id = instance_id), n AS (SELECT task, count(*)::DOUBLE AS n, count_if(a = b) / count(*)::DOUBLE AS p FROM t GROUP BY 1), e AS (SELECT task, sum(m * m) AS c FROM (SELECT task, a, count(*) AS m FROM t GROUP BY 1, 2) GROUP BY 1), k AS (SELECT task, round(p, 6) AS agreement, round((p - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n JOIN e USING (task)),
j AS (SELECT coalesce(s.task, md.task) AS task, coalesce(s.model, md.model) AS model, coalesce(points, 0) AS points, median_metric FROM s FULL JOIN md ON s.task = md.task AND s.model = md.model)
SELECT task, model, points, row_number() OVER (PARTITION BY task ORDER BY points DESC, model) AS rank_points, median_metric, CASE WHEN median_metric IS NOT NULL THEN row_number() OVER (PARTITION BY task ORDER BY median_metric DESC NULLS LAST, model) END AS rank_metric, agreement, kappa FROM j LEFT JOIN k USING (task)""")
def e14b(spark, d):
    """Per task and model: points and rank of all votes, median and rank of the metric, and the annotators'
    agreement in the task. Models without votes have 0 points."""
    names = compared(spark, d)
    sides = F.array(F.struct(F.col("a").alias("model"), F.round("fa", 6).alias("f")), F.struct(F.col("b").alias("model"), F.round("fb", 6).alias("f")))
    scored = metric(spark, d).join(names, "instance_id").select("task", F.inline(sides)).where("model IS NOT NULL")
    medians = E.quantile(scored, ["task", "model"], "f", 0.5).select("task", "model", F.round("quantile", 8).alias("median_metric"))
    pairs = label_pairs(votes(spark, d)).join(names.select("instance_id", "task"), "instance_id").select("task", "a", "b", "m")
    agree = E.pair_kappa(pairs, ["task"]).select("task", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))
    rows = points(spark, d, ["task"]).join(medians, ["task", "model"], "full").withColumn("points", F.coalesce("points", F.lit(0)).cast("long"))
    w = Window.partitionBy("task")  # models of a task
    rows = rows.withColumn("rank_points", F.row_number().over(w.orderBy(F.desc("points"), "model")).cast("long"))
    rank = F.row_number().over(w.orderBy(F.col("median_metric").desc_nulls_last(), "model")).cast("long")
    return rows.withColumn("rank_metric", F.when(F.col("median_metric").isNotNull(), rank)).join(agree, "task", "left")


@query("e14_annotator_ranks", f"WITH {_PTS}, s AS (SELECT task, annotator, model, sum(points)::BIGINT AS points FROM pt GROUP BY ALL) SELECT task, annotator, model, points, row_number() OVER (PARTITION BY task, annotator ORDER BY points DESC, model) AS rank FROM s")
def e14c(spark, d):
    """Points and rank of every system by every annotator's votes alone."""
    rank = F.row_number().over(Window.partitionBy("task", "annotator").orderBy(F.desc("points"), "model")).cast("long")  # systems
    return points(spark, d, ["task", "annotator"]).select("task", "annotator", "model", F.col("points").cast("long").alias("points")).withColumn("rank", rank)


@query("k7_annotations_wide", f"WITH {_V} SELECT annotator, instance_id, max(CASE WHEN selected_model = 'A es mejor' THEN '1' END) AS a, max(CASE WHEN selected_model = 'B es mejor' THEN '1' END) AS b FROM v WHERE selected_model <> 'Ambos son malos' GROUP BY ALL")
def k7(spark, d):
    """The votes as they stand, a row per annotator and comparison, a column per choice."""
    said = named(votes(spark, d).where("label < 2"))
    rows = said.select("annotator", "instance_id", F.lit("best").alias("schema"), F.col("selected_model").alias("label"), F.lit("1").alias("value"))
    wide = sinks.annotations_wide(rows, "annotator", "instance_id", "schema", "label", "value", [("best", "A es mejor"), ("best", "B es mejor")])
    return wide.withColumnsRenamed({"best:::A es mejor": "a", "best:::B es mejor": "b"})
