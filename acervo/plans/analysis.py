"""Evaluation statistics, quarterly indicators and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from acervo.functions import objective as O
from acervo.functions import procurement as P
from acervo.operators import evaluation as E
from acervo.operators.retrieval import tokens
from acervo.plans.registry import query
from acervo.operators.ranking import bucket_rank
from acervo.plans.relational import NEWEST, newest, years_to_now
from acervo.runtime import materialise, table

_TOKENS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')".format

# -- indicators: quarters of orders, origin by market segment, lots as order lines ------------------

_Q = "o AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, c_mktsegment AS origin, o_totalprice AS budget, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def _orders(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("origin"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q"), "origin", F.col("o_totalprice").alias("budget"))


@query("i1_total_procurement", f"WITH {_Q} SELECT y, q, coalesce(origin, 'total') AS origin, count(*) AS n, round(sum(budget) / 1e3, 3) AS budget FROM o GROUP BY GROUPING SETS ((y, q, origin), (y, q))")
def i1(spark, d):
    by = _orders(spark, d).groupBy("y", "q", "origin").agg(F.count(F.lit(1)).alias("n"), F.sum("budget").alias("b"))
    total = by.groupBy("y", "q").agg(F.lit("total").alias("origin"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    return by.unionByName(total).select("y", "q", "origin", "n", F.round(F.col("b") / 1e3, 3).alias("budget"))


@query("i2_single_bidder", f"WITH {_Q}, l AS (SELECT l_orderkey, count(*) AS bidders FROM lineitem GROUP BY 1), j AS (SELECT o.*, bidders FROM o LEFT JOIN l ON l_orderkey = o_orderkey) SELECT y, q, origin, round(100.0 * count_if(bidders = 1) / nullif(count(bidders), 0), 4) AS pct_count, round(100.0 * sum(CASE WHEN bidders = 1 THEN budget ELSE 0 END) / sum(CASE WHEN bidders IS NOT NULL THEN budget END), 4) AS pct_budget, round(100.0 * count(bidders) / count(*), 4) AS coverage FROM j GROUP BY y, q, origin")
def i2(spark, d):
    bidders = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("bidders"))
    rows = _orders(spark, d).join(bidders, "o_orderkey", "left")
    single = F.col("bidders") == 1
    return rows.groupBy("y", "q", "origin").agg(
        F.round(100.0 * F.count_if(single) / F.nullif(F.count("bidders"), F.lit(0)), 4).alias("pct_count"),
        F.round(100.0 * F.sum(F.when(single, F.col("budget")).otherwise(0)) / F.sum(F.when(F.col("bidders").isNotNull(), F.col("budget"))), 4).alias("pct_budget"),
        F.round(100.0 * F.count("bidders") / F.count(F.lit(1)), 4).alias("coverage"),
    )


_ORIGIN = "lower(trim(origin))"
_LOT = lambda name: f"nullif(regexp_extract(lotes, '[''\"]{name}[''\"]: ?[''\"]?([^''\",}}]*)', 1), '')"
_AMOUNT = f"TRY_CAST({_LOT('TaxExclusiveAmount')} AS DOUBLE)"


@query("i3_published_share", f"WITH x AS (SELECT year(pub_date) AS y, quarter(pub_date) AS q, {_ORIGIN} AS origin, url IS NOT NULL AS p, CASE WHEN lotes IS NOT NULL THEN {_AMOUNT} END AS a FROM corpus WHERE {_ORIGIN} IN ('insiders', 'outsiders')) SELECT y, q, origin, round(100.0 * count_if(p) / count(*), 4) AS pct, round(100.0 * sum(CASE WHEN p THEN a END) / nullif(sum(a), 0), 4) AS pct_budget FROM x GROUP BY ALL")
def i3(spark, d):
    """Tenders published with an address, as a share of their number and of their lots' amounts."""
    rows = table(spark, d, "corpus").select("pub_date", F.lower(F.trim("origin")).alias("origin"), F.col("url").isNotNull().alias("p"), F.get(P.lots(F.col("lotes")), F.lit(0))["TaxExclusiveAmount"].try_cast("double").alias("a"))
    rows = rows.where(F.col("origin").isin("insiders", "outsiders"))
    budget = F.round(100.0 * F.sum(F.when(F.col("p"), F.col("a"))) / F.nullif(F.sum("a"), F.lit(0.0)), 4)
    return rows.groupBy(F.year("pub_date").cast("long").alias("y"), F.quarter("pub_date").cast("long").alias("q"), "origin").agg(F.round(100.0 * F.count_if("p") / F.count(F.lit(1)), 4).alias("pct"), budget.alias("pct_budget"))


@query("i4_decision_speed", f"WITH x AS (SELECT year(award_date) AS y, quarter(award_date) AS q, {_ORIGIN} AS origin, date_diff('day', pub_date::DATE, award_date::DATE) AS days FROM corpus WHERE award_date IS NOT NULL AND pub_date IS NOT NULL) SELECT y, q, CASE WHEN grouping(origin) = 0 THEN coalesce(origin, 'unknown') ELSE 'total' END AS origin, round(avg(days), 4) AS mean_days, count(*) AS n FROM x WHERE days >= 0 GROUP BY GROUPING SETS ((y, q, origin), (y, q), (y))")
def i4(spark, d):
    """Mean days from publication to award: by quarter and origin, in all of a quarter, and of a year (q null),
    which is the mean over its rows."""
    rows = table(spark, d, "corpus").where("award_date IS NOT NULL AND pub_date IS NOT NULL")
    days = rows.select(F.year("award_date").cast("long").alias("y"), F.quarter("award_date").cast("long").alias("q"), F.coalesce(F.lower(F.trim("origin")), F.lit("unknown")).alias("origin"), F.datediff("award_date", "pub_date").alias("days")).where("days >= 0")
    by = days.groupBy("y", "q", "origin").agg(F.sum("days").alias("s"), F.count(F.lit(1)).alias("n"))
    total = lambda df, q: df.select("y", q.alias("q"), F.lit("total").alias("origin"), "s", "n")
    quarters = by.groupBy("y", "q").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    years = quarters.groupBy("y").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    every = by.unionByName(total(quarters, F.col("q"))).unionByName(total(years, F.lit(None).cast("long")))
    return every.select("y", "q", "origin", F.round(F.col("s") / F.col("n"), 4).alias("mean_days"), "n")


@query("i5_rate_buckets", "SELECT least(floor(l_discount * 100 / 2), 4)::BIGINT AS bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 4) AS pct FROM lineitem GROUP BY 1")
def i5(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.least(F.floor(F.col("l_discount") * 100 / 2), F.lit(4)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("pct"))  # one row


# -- evaluation -----------------------------------------------------------------------------------------

_CONTENT = lambda c: f"list_filter({_TOKENS(c)}, lambda x: x NOT IN ('objeto', 'contrato', 'contratación', 'objetivo', 'pliego', 'licitación'))"
_SETS = f"s AS (SELECT id, list_distinct({_CONTENT('text_option_a')}) AS a, list_distinct({_CONTENT('text_option_b')}) AS b FROM (SELECT DISTINCT id, text_option_a, text_option_b FROM pair_comparisons))"


def _options(spark, d):
    return table(spark, d, "pair_comparisons").select("id", "text_option_a", "text_option_b").distinct()


@query("e1_token_overlap", f"WITH {_SETS}, m AS (SELECT id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b))::DOUBLE AS h FROM s), pr AS (SELECT id, CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE h / na END AS p, CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE h / nb END AS r FROM m) SELECT id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr")
def e1(spark, d):
    p, r, f1 = E.overlap(E.content(F.col("text_option_a")), E.content(F.col("text_option_b")))
    return _options(spark, d).select("id", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1, 6).alias("f1"))


@query("e2_rouge_1", f"WITH t AS (SELECT id, {_TOKENS('text_option_a')} AS a, {_TOKENS('text_option_b')} AS b FROM (SELECT DISTINCT id, text_option_a, text_option_b FROM pair_comparisons)) SELECT id, round(CASE WHEN len(a) + len(b) > 0 THEN 2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda g: least(len(list_filter(a, lambda x: x = g)), len(list_filter(b, lambda x: x = g))))), 0) / (len(a) + len(b)) ELSE 0 END, 6) AS rouge1 FROM t")
def e2(spark, d):
    return _options(spark, d).select("id", F.round(E.rouge_n(tokens(F.col("text_option_a")), tokens(F.col("text_option_b")), 1), 6).alias("rouge1"))


_GR2 = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])".format


@query("e2_rouge_2", f"WITH t AS (SELECT id, {_TOKENS('text_option_a')} AS a, {_TOKENS('text_option_b')} AS b FROM (SELECT DISTINCT id, text_option_a, text_option_b FROM pair_comparisons)), g AS (SELECT id, CASE WHEN len(a) > 1 THEN {_GR2('a')} ELSE [] END AS a, CASE WHEN len(b) > 1 THEN {_GR2('b')} ELSE [] END AS b FROM t) SELECT id, round(CASE WHEN len(a) + len(b) > 0 THEN 2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda g: least(len(list_filter(a, lambda x: x = g)), len(list_filter(b, lambda x: x = g))))), 0) / (len(a) + len(b)) ELSE 0 END, 6) AS rouge2 FROM g")
def e2b(spark, d):
    return _options(spark, d).select("id", F.round(E.rouge_n(tokens(F.col("text_option_a")), tokens(F.col("text_option_b")), 2), 6).alias("rouge2"))


@query("e2_rouge_stemmed")
def e2c(spark, d):
    """ROUGE-1, -2 and -L of both options against the reference text, stemmed; tested against plain loops."""
    rows = table(spark, d, "pair_comparisons").select("id", "reference_text", "text_option_a").distinct()
    scored = E.rouge(rows, "reference_text", "text_option_a")
    return scored.select("id", *[F.round(c, 6).alias(c) for c in ("p1", "r1", "f1", "p2", "r2", "f2", "pl", "rl", "fl")])


@query("e3_token_matches")
def e3(spark, d):
    """Token vectors matched greedily (the default encoder; a model's can be injected)."""
    from acervo.operators.encoders import hashing

    rows = table(spark, d, "pair_comparisons").select("id", "reference_text", "text_option_a").distinct()
    return E.greedy_match(rows, "reference_text", "text_option_a", hashing).select("id", *[F.round(f"bert_{c}", 6).alias(c) for c in ("p", "r", "f1")])


@query("e15_ablation", f"WITH t AS (SELECT id, {_TOKENS('reference_text')} AS r, {_TOKENS('text_option_a')} AS a, {_TOKENS('text_option_b')} AS b FROM (SELECT DISTINCT id, reference_text, text_option_a, text_option_b FROM pair_comparisons)), g AS (SELECT * FROM (VALUES (0, false), (0, true), (1, false), (1, true)) g(side, distinct_only)), s AS (SELECT id, side, distinct_only, CASE WHEN distinct_only THEN list_distinct(CASE side WHEN 0 THEN a ELSE b END) ELSE CASE side WHEN 0 THEN a ELSE b END END AS x, r FROM t, g) SELECT side, distinct_only, count(*) AS n, round(avg(CASE WHEN len(x) > 0 THEN len(list_filter(x, lambda w: list_contains(r, w))) / len(x) ELSE 0 END), 6) AS precision FROM s GROUP BY ALL")
def e15(spark, d):
    """A grid of settings crossed with all rows, one metric each: which option, and repeated words or not."""
    grid = spark.createDataFrame([(s, u) for s in (0, 1) for u in (False, True)], "side int, distinct_only boolean")
    rows = table(spark, d, "pair_comparisons").select("id", "reference_text", "text_option_a", "text_option_b").distinct()
    x = F.when(F.col("side") == 0, tokens(F.col("text_option_a"))).otherwise(tokens(F.col("text_option_b")))
    met = rows.crossJoin(F.broadcast(grid)).select("side", "distinct_only", F.when(F.col("distinct_only"), F.array_distinct(x)).otherwise(x).alias("x"), F.array_distinct(tokens(F.col("reference_text"))).alias("r"))  # four settings
    share = F.when(F.size("x") > 0, F.size(F.filter("x", lambda w: F.array_contains("r", w))) / F.size("x")).otherwise(0.0)
    return met.groupBy("side", "distinct_only").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(share), 6).alias("precision"))


@query("e16_ratings", "SELECT l_returnflag, count(*) AS n, round(avg(1 + l_quantity::INT % 10), 6) AS mean, round(100.0 * (count_if(1 + l_quantity::INT % 10 >= 9) - count_if(1 + l_quantity::INT % 10 <= 6)) / count(*), 6) AS score FROM lineitem GROUP BY 1")
def e16(spark, d):
    """Ratings from 1 to 10: mean and net score of promoters."""
    rows = table(spark, d, "lineitem").select("l_returnflag", (1 + F.col("l_quantity").cast("int") % 10).alias("rating"))
    return E.promoters(rows, ["l_returnflag"], "rating").select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("score", 6).alias("score"))


_FR = "x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), r AS (SELECT vec_id, i, rank() OVER w + (count(*) OVER (PARTITION BY vec_id, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY vec_id, v) AS t FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY v))"


@query("e5_friedman", f"WITH {_FR}, s AS (SELECT i, sum(r) AS s, count(*) AS n, sum(t * t - 1)::DOUBLE AS t FROM r GROUP BY 1) SELECT max(n) AS blocks, round((12 * sum(s * s) / (max(n) * 64 * 65) - 3 * max(n) * 65) / (1 - sum(t) / (max(n) * 64 * 4095)), 4) AS chi2 FROM s")
def e5(spark, d):
    """Every vector ranks its 64 components."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return E.friedman(rows, "vec_id", "i", "v", 64).select("blocks", F.round("chi2", 4).alias("chi2"))


@query("e6_kendall_tau", "WITH t AS (SELECT p_brand, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY 1), p AS (SELECT sign(x.a - y.a) AS p, sign(x.b - y.b) AS q FROM t x JOIN t y ON x.p_brand < y.p_brand) SELECT round(sum(p * q) / sqrt(sum(abs(p)) * sum(abs(q))), 6) AS tau FROM p")
def e6(spark, d):
    t = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    return E.kendall(t, "a", "b", "p_brand").select(F.round("tau", 6).alias("tau"))


@query("e6_spearman", "WITH t AS (SELECT p_brand, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY a, p_brand) AS x, row_number() OVER (ORDER BY b, p_brand) AS y FROM t) SELECT round(corr(x, y), 6) AS rho FROM r")
def e6b(spark, d):
    t = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    t = materialise(t, "means")
    ranked = bucket_rank(bucket_rank(t.withColumn("k", F.floor("a")), [], "k", [F.asc("a"), F.asc("p_brand")], "x").withColumn("k", F.floor("b")), [], "k", [F.asc("b"), F.asc("p_brand")], "y")
    return ranked.agg(F.round(F.corr("x", "y"), 6).alias("rho"))


@query("e10_paired_bootstrap")
def e10(spark, d):
    """How often option A is the longer text, and the bootstrap interval of that rate."""
    pairs = _options(spark, d).select((F.length("text_option_a") > F.length("text_option_b")).alias("won"))
    return E.bootstrap_rate(pairs, "won").select(*[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


@query("e4_paired_pivot", "SELECT o_custkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END)::BIGINT AS urgent, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END)::BIGINT AS low FROM orders GROUP BY o_custkey HAVING urgent IS NOT NULL AND low IS NOT NULL")
def e4(spark, d):
    wide = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return wide.na.drop("any").withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


# -- text functions -------------------------------------------------------------------------------------


@query("f8_equivalences_stopwords", f"WITH t AS (SELECT doc_id, {_TOKENS('text')} AS t FROM documents), e AS (SELECT doc_id, list_transform(t, lambda x: CASE x WHEN 'licitador' THEN 'empresa' WHEN 'adjudicatario' THEN 'empresa' ELSE x END) AS t FROM t) SELECT doc_id, array_to_string(list_filter(t, lambda x: x NOT IN ('el', 'la', 'los', 'las', 'de', 'del', 'y')), ' ') AS text FROM e")
def f8(spark, d):
    """Equivalents first, so that one that leads to a stop word goes as well."""
    same = F.create_map(*[F.lit(x) for x in ("licitador", "empresa", "adjudicatario", "empresa")])
    words = F.transform(tokens(F.col("text")), lambda x: F.coalesce(F.try_element_at(same, x), x))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(words, lambda x: ~x.isin("el", "la", "los", "las", "de", "del", "y")), " ").alias("text"))


_VOC = f"f9 AS (SELECT term FROM (SELECT DISTINCT doc_id, unnest({_TOKENS('text')}) AS term FROM documents) GROUP BY term HAVING count(*) >= 20)"


@query("f9_vocabulary_projection", f"WITH {_VOC}, t AS (SELECT DISTINCT doc_id, text, {_TOKENS('text')} AS w FROM documents), u AS (SELECT doc_id, text, unnest(w) AS term, unnest(range(0, len(w))) AS i FROM t) SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS words FROM u SEMI JOIN f9 USING (term) GROUP BY doc_id, text")
def f9(spark, d):
    """The words of every text that are in the vocabulary, in order, repeated ones too."""
    docs = table(spark, d, "documents").select("doc_id", "text").distinct().where("text IS NOT NULL")
    known = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.countDistinct("doc_id").alias("df")).where("df >= 20").select("term")
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(tokens(F.col("text"))).alias("i", "term")).join(known, "term", "left_semi")
    held = words.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("i", "term"))).alias("w"))
    return held.select("doc_id", F.array_join(F.transform("w", lambda e: e["term"]), " ").alias("words"))


@query("f11_xml_safe", r"SELECT doc_id, length(regexp_replace(text, '[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g')) AS n FROM documents")
def f11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(P.xml_safe(F.col("text"))).cast("long").alias("n"))


@query("f12_iso_dates", "SELECT place_id, indexed_at, strftime(pub_date, '%Y-%m-%dT%H:%M:%SZ') AS date, left(strftime(pub_date, '%Y-%m-%dT%H:%M:%SZ'), 4)::INTEGER AS year FROM corpus")
def f12(spark, d):
    iso = P.iso_z(F.col("pub_date"))
    return table(spark, d, "corpus").select("place_id", "indexed_at", iso.alias("date"), F.substring(iso, 1, 4).cast("int").alias("year"))


@query("f16_lots", f"WITH t AS (SELECT place_id, indexed_at, {_LOT('ItemClassificationCode')} AS code, TRY_CAST({_LOT('TaxExclusiveAmount')} AS DOUBLE) AS amount, TRY_CAST({_LOT('numLotes')} AS INTEGER) AS lots FROM corpus WHERE starts_with(ltrim(lotes), '{{')) SELECT * FROM t WHERE code IS NOT NULL OR amount IS NOT NULL OR lots IS NOT NULL")
def f16(spark, d):
    """Lots as JSON or as a Python literal, flat or in a list `lotes`; kept with one field at least."""
    rows = table(spark, d, "corpus").select("place_id", "indexed_at", F.explode(P.lots(F.col("lotes"))).alias("l"))
    return rows.select("place_id", "indexed_at", F.col("l.ItemClassificationCode").alias("code"), F.col("l.TaxExclusiveAmount").try_cast("double").alias("amount"), F.col("l.numLotes").try_cast("int").alias("lots"))


@query("f24_context_window", "SELECT doc_id, CASE WHEN position('plazo' IN text) > 0 THEN substring(text, greatest(1, position('plazo' IN text) - 300), position('plazo' IN text) - greatest(1, position('plazo' IN text) - 300) + 505) END AS around FROM documents")
def f24(spark, d):
    return table(spark, d, "documents").select("doc_id", O.window(F.col("text"), F.lit("plazo")).alias("around"))


@query("f27_garbage", r"SELECT doc_id, length(text) < 20 OR length(regexp_replace(text, '[^\p{L} ]', '', 'g')) / length(text)::DOUBLE < 0.5 AS garbage FROM documents WHERE text <> ''")
def f27(spark, d):
    return table(spark, d, "documents").where("text <> ''").select("doc_id", P.garbage(F.col("text")).alias("garbage"))


@query("f34_cpv5_repair", "WITH x AS (SELECT id, left(regexp_replace(metadata_value, '[^0-9]', '', 'g'), 5) AS d FROM metadatos WHERE metadata_value IS NOT NULL) SELECT id, CASE WHEN length(d) = 5 THEN d WHEN length(d) = 4 THEN d || '0' END AS cpv5 FROM x")
def f34(spark, d):
    return table(spark, d, "metadatos").where("metadata_value IS NOT NULL").select("id", P.cpv5(F.col("metadata_value")).alias("cpv5"))


@query("f36_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS p, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def f36(spark, d):
    from acervo.operators.search import dot

    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-v[0].cast("double"))), 6).alias("p"), F.round(F.sqrt(dot(v, v)), 6).alias("norm"))


@query("f37_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def f37(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")).cast("int") - 1).alias("best"))


@query("f41_length_metrics", r"SELECT doc_id, length(text) AS chars, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL")
def f41(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("chars"), P.word_count(F.col("text")).cast("long").alias("words"))


@query("bow_of_lemmas", r"WITH t AS (SELECT row_number() OVER () AS r, place_id, indexed_at, list_filter(string_split_regex(coalesce(lemmas, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM corpus), c AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM t) GROUP BY ALL), g AS (SELECT r, string_agg(w || '|' || n, ' ' ORDER BY w) AS bow FROM c GROUP BY 1) SELECT place_id, indexed_at, coalesce(bow, '') AS bow FROM t LEFT JOIN g USING (r)")
def bow(spark, d):
    return table(spark, d, "corpus").select("place_id", "indexed_at", P.bag(F.col("lemmas")).alias("bow"))


@query("q32_augmented_by_year", f"WITH {NEWEST} SELECT place_id AS id, title, origin, array_to_string(list_filter(list_transform(string_split(coalesce(cpv, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS cpv, coalesce(left(trim(string_split(coalesce(cpv, ''), ',')[1]), 2), '') AS two_cpv FROM newest WHERE pub_date >= TIMESTAMP '2023-01-01' AND pub_date < TIMESTAMP '2025-01-01' AND list_has_any(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}_]+'), ['limpieza', 'obras'])")
def q32(spark, d):
    from acervo.operators.retrieval import keyword, year_range

    rows = newest(spark, d, "pub_date").where(year_range(F.col("pub_date"), 2023, 2024) & keyword(F.col("title"), "limpieza obras"))
    return rows.select(F.col("place_id").alias("id"), "title", "origin", F.array_join(P.comma_list(F.col("cpv")), "|").alias("cpv"), F.coalesce(F.substring(F.trim(F.split("cpv", ",")[0]), 1, 2), F.lit("")).alias("two_cpv")).orderBy("id")


@query("q31_all_years", f"WITH {NEWEST} SELECT y AS year, count(place_id) AS count FROM range(2000, year(current_date) + 1) t(y) LEFT JOIN newest ON year(pub_date) = y AND pub_date < current_timestamp::TIMESTAMP GROUP BY y")
def q31(spark, d):
    past = newest(spark, d, "pub_date").where(F.col("pub_date") < F.current_timestamp().cast("timestamp_ntz"))
    counts = past.groupBy(F.year("pub_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return years_to_now(spark, 2000).join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("count"))


_NINE = ("title", "cpv", "origin", "link", "generated_objective", "two_cpv", "pub_date", "contracting_party_id")
_FULL = "full_rows AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY indexed_at DESC, title DESC NULLS LAST, cpv DESC NULLS LAST, origin DESC NULLS LAST, link DESC NULLS LAST, generated_objective DESC NULLS LAST, two_cpv DESC NULLS LAST, pub_date DESC NULLS LAST, contracting_party_id DESC NULLS LAST) = 1)"


@query("q30_docs_by_year", f"WITH {_FULL} SELECT place_id AS id, title, cpv, origin, link, generated_objective, two_cpv, pub_date, contracting_party_id FROM full_rows WHERE pub_date >= TIMESTAMP '2024-01-01' AND pub_date < TIMESTAMP '2025-01-01'")
def q30(spark, d):
    """The nine fields that are displayed, of the newest rows."""
    from acervo.operators.latest import latest
    from acervo.operators.retrieval import year_range

    rows = latest(table(spark, d, "corpus"), ["place_id"], ["indexed_at"], list(_NINE))
    return rows.where(year_range(F.col("pub_date"), 2024, None)).select(F.col("place_id").alias("id"), *_NINE)


@query("q15_lemmas_by_id", "SELECT lemmas FROM corpus WHERE place_id = (SELECT max(place_id) FROM corpus) AND indexed_at = (SELECT max(indexed_at) FROM corpus WHERE place_id = (SELECT max(place_id) FROM corpus)) LIMIT 1")
def q15(spark, d):
    rows = table(spark, d, "corpus")
    last = rows.agg(F.max("place_id").alias("m"))
    one = rows.join(F.broadcast(last), F.col("place_id") == F.col("m"), "left_semi")  # one row
    return one.agg(F.max_by("lemmas", "indexed_at").alias("lemmas"))
