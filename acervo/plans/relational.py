"""Scans, projections, joins, aggregates and set operations over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.functions.procurement import comma_list, cpv_depth, cpv_list, cpv_prefixes, finite, iso, null_like, searchable, to_record, unwrapped, word_count
from acervo.operators.annotation import drawn
from acervo.operators.evaluation import quantile
from acervo.operators.latest import latest
from acervo.operators.retrieval import keyword, year_range
from acervo.plans.catalog import raw_query
from acervo.plans.registry import query
from acervo.runtime import table

NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY indexed_at DESC, title DESC NULLS LAST, cpv DESC NULLS LAST, origin DESC NULLS LAST) AS rn FROM corpus) WHERE rn = 1)"


def newest(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """The newest row of every tender, by the same tie order as NEWEST."""
    fixed = ["title", "cpv", "origin"]
    return latest(table(spark, d, "corpus"), ["place_id"], ["indexed_at"], fixed + [c for c in keep if c not in fixed])


def years_to_now(spark, first):
    """(year) from the first to the present one."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("long"), F.year(F.current_date()).cast("long"))).alias("year"))


@query("a1_count_corpus", "SELECT count(*) AS ndocs FROM corpus")
def a1(spark, d):
    return table(spark, d, "corpus").agg(F.count(F.lit(1)).alias("ndocs"))


@query("a2_year_facet", "SELECT y AS year, count(o_orderkey) AS n FROM range(1992, year(current_date) + 1) t(y) LEFT JOIN orders ON year(o_orderdate) = y AND o_orderdate < current_timestamp::TIMESTAMP GROUP BY y")
def a2(spark, d):
    years = years_to_now(spark, 1992)
    counts = table(spark, d, "orders").where(F.col("o_orderdate") < F.current_timestamp().cast("timestamp_ntz")).groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


@query("a3_group_count", "SELECT two_cpv, count(*) AS n FROM corpus WHERE two_cpv IS NOT NULL GROUP BY two_cpv")
def a3(spark, d):
    return table(spark, d, "corpus").where("two_cpv IS NOT NULL").groupBy("two_cpv").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "two_cpv")


@query("a4_exploded_counts", "SELECT code, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(cpv, ','), lambda x: trim(x)), lambda x: x <> '')) AS code FROM corpus) GROUP BY code")
def a4(spark, d):
    return table(spark, d, "corpus").select(F.explode(comma_list(F.col("cpv"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("a5_counts_over_labels", "SELECT label, count(d.doc_id) AS n FROM (VALUES ('es'), ('ca'), ('pt')) t(label) LEFT JOIN documents d ON d.lang = label GROUP BY label")
def a5(spark, d):
    labels = spark.createDataFrame([("es",), ("ca",), ("pt",)], "label string")
    counts = table(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query("a6_multi_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY ALL")
def a6(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate < TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("a7_quantile", "SELECT round(quantile_cont(o_totalprice, 0.05), 4) AS p5 FROM orders")
def a7(spark, d):
    return quantile(table(spark, d, "orders"), [], "o_totalprice", 0.05).select(F.round("quantile", 4).alias("p5"))


@query("a10_describe", "SELECT count(seconds_spent) AS n, round(avg(seconds_spent), 4) AS mean, round(stddev_samp(seconds_spent), 4) AS sd, round(min(seconds_spent), 4) AS low, round(max(seconds_spent), 4) AS high FROM annotations WHERE isfinite(seconds_spent)")
def a10(spark, d):
    c = F.col("seconds_spent")
    rows = table(spark, d, "annotations").where(~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("sd"), F.round(F.min(c), 4).alias("low"), F.round(F.max(c), 4).alias("high"))


@query("a11_median_by_group", "SELECT c_mktsegment AS segment, round(median(c_acctbal), 4) AS median_balance FROM customer GROUP BY c_mktsegment")
def a11(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return quantile(rows, ["segment"], "c_acctbal", 0.5).select("segment", F.round("quantile", 4).alias("median_balance"))


@query("a13_distinct_and_duplicates", "SELECT count(DISTINCT place_id) AS tenders, count(*) - count(DISTINCT place_id) AS repeats FROM corpus")
def a13(spark, d):
    return table(spark, d, "corpus").agg(F.countDistinct("place_id").alias("tenders"), (F.count(F.lit(1)) - F.countDistinct("place_id")).alias("repeats"))


@query("a14_dedup_newest", f"WITH {NEWEST} SELECT place_id, indexed_at, title FROM newest")
def a14(spark, d):
    return newest(spark, d).select("place_id", "indexed_at", "title")


@query("a15_vocabulary", """
WITH t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS term FROM documents),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT term, df FROM f WHERE df >= 5 AND df <= 0.4 * (SELECT count(DISTINCT doc_id) FROM documents) ORDER BY df DESC, term LIMIT 500""")
def a15(spark, d):
    from acervo.operators.retrieval import tokens

    docs = table(spark, d, "documents")
    total = docs.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    df = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    return df.where("df >= 5").join(F.broadcast(total), F.col("df") <= 0.4 * F.col("total")).select("term", "df").orderBy(F.desc("df"), "term").limit(500)  # one row; the 500 most frequent are kept


@query("a16_granularity", "SELECT p_brand AS grp, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand")
def a16(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@query("a18_next_id", "SELECT max(TRY_CAST(id AS BIGINT)) + 1 AS next_id FROM uploads")
def a18(spark, d):
    return table(spark, d, "uploads").agg((F.max(F.col("id").cast("long")) + 1).alias("next_id"))


@query("a19_annotator_totals", "SELECT annotator, count(*) AS votes, round(sum(seconds_spent), 2) AS seconds, round(avg(seconds_spent), 4) AS mean_seconds FROM annotations WHERE annotator IS NOT NULL GROUP BY annotator")
def a19(spark, d):
    return table(spark, d, "annotations").where("annotator IS NOT NULL").groupBy("annotator").agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum("seconds_spent"), 2).alias("seconds"), F.round(F.avg("seconds_spent"), 4).alias("mean_seconds"))


@query("a20_label_distribution", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def a20(spark, d):
    counts = table(spark, d, "events").where("event_type IS NOT NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))  # one row


# -- projections, filters, paging ------------------------------------------------------------


@query("proj_point_lookup", "SELECT place_id, title, cpv, origin FROM corpus WHERE place_id = (SELECT min(place_id) FROM corpus)")
def point(spark, d):
    rows = table(spark, d, "corpus")
    first = rows.agg(F.min("place_id").alias("m"))
    return rows.join(F.broadcast(first), F.col("place_id") == F.col("m"), "left_semi").select("place_id", "title", "cpv", "origin")  # one row


@query("filter_keyword", r"SELECT doc_id FROM documents WHERE list_has_any(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), ['residuos', 'archivo'])")
def by_keyword(spark, d):
    return table(spark, d, "documents").where(keyword(F.col("text"), "residuos archivo")).select("doc_id")


@query("filter_phrase", r"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> ''), ' ') || ' ', ' zonas verdes ')")
def by_phrase(spark, d):
    return table(spark, d, "documents").where(keyword(F.col("text"), '"zonas verdes"')).select("doc_id")


@query("filter_year_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def by_years(spark, d):
    return table(spark, d, "orders").where(year_range(F.col("o_orderdate"), 1996, 1997)).select("o_orderkey")


@query("filter_single_year", "SELECT place_id, indexed_at FROM corpus WHERE pub_date >= TIMESTAMP '2024-01-01' AND pub_date < TIMESTAMP '2025-01-01'")
def by_one_year(spark, d):
    return table(spark, d, "corpus").where(year_range(F.col("pub_date"), 2024, None)).select("place_id", "indexed_at")


@query("filter_isin_negated", "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('insiders', 'minors') GROUP BY source")
def not_in(spark, d):
    return table(spark, d, "documents").where(~F.col("source").isin("insiders", "minors")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("filter_contains_ci", "SELECT place_id, indexed_at FROM corpus WHERE coalesce(contains(lower(criterios_adjudicacion), 'precio'), false)")
def contains(spark, d):
    return table(spark, d, "corpus").where(F.coalesce(F.lower("criterios_adjudicacion").contains("precio"), F.lit(False))).select("place_id", "indexed_at")


@query("filter_usable_text", r"SELECT place_id FROM (SELECT DISTINCT place_id, raw_text, title FROM pliegos) WHERE raw_text IS NOT NULL AND NOT starts_with(raw_text, '[ERROR:') AND NOT regexp_matches(raw_text, '^[\x00-\x1F\x7F\s]+$') AND trim(title) <> ''")
def usable(spark, d):
    rows = table(spark, d, "pliegos").select("place_id", "raw_text", "title").distinct()
    t = F.col("raw_text")
    return rows.where(t.isNotNull() & ~t.startswith("[ERROR:") & ~t.rlike(r"^[\x00-\x1F\x7F\s]+$") & (F.trim("title") != "")).select("place_id")


@query("filter_no_slash", "SELECT place_id, indexed_at FROM corpus WHERE origin IS NOT NULL AND NOT contains(generated_objective, '/')")
def no_slash(spark, d):
    """Objectives without any slash; null ones drop out."""
    return table(spark, d, "corpus").where(F.col("origin").isNotNull() & ~F.col("generated_objective").contains("/")).select("place_id", "indexed_at")


@query("filter_exists", "SELECT DISTINCT place_id FROM corpus WHERE lemmas IS NOT NULL AND bow IS NOT NULL")
def exists(spark, d):
    """`field:[* TO *]` and `field:*` of the raw query."""
    return raw_query(table(spark, d, "corpus"), "lemmas:[* TO *] AND bow:*", fl="place_id").distinct()


@query("filter_match_all", "SELECT doc_id FROM documents")
def match_all(spark, d):
    return raw_query(table(spark, d, "documents").where(keyword(F.col("text"), "*")), "*:*", fl="doc_id")


@query("filter_any_field", r"SELECT DISTINCT place_id FROM corpus WHERE list_has_any(string_split_regex(lower(coalesce(title, '')), '[^\p{L}\p{N}_]+'), ['limpieza', 'archivo']) OR list_has_any(string_split_regex(lower(coalesce(generated_objective, '')), '[^\p{L}\p{N}_]+'), ['limpieza', 'archivo'])")
def any_field(spark, d):
    """A keyword over several fields: any of its words in any of them."""
    return table(spark, d, "corpus").where(keyword(F.col("title"), "limpieza archivo", (F.col("generated_objective"),))).select("place_id").distinct()


@query("filter_depth", "SELECT place_id, indexed_at FROM corpus WHERE list_has_any(list_transform(string_split(replace(cpv, ' ', ''), ','), lambda x: length(rtrim(x, '0'))), [4, 6])")
def depth(spark, d):
    codes = F.split(F.replace(F.col("cpv"), F.lit(" "), F.lit("")), ",")
    return table(spark, d, "corpus").where(F.arrays_overlap(F.transform(codes, cpv_depth), F.array(F.lit(4), F.lit(6)))).select("place_id", "indexed_at")


@query("page_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged(spark, d):
    from acervo.operators.retrieval import page, parse_sort

    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return page(rows, parse_sort("o_totalprice:desc", "o_orderkey"), 50, 25)


@query("project_renamed_constant", "SELECT place_id AS id, lower(title) AS title, 'tender' AS kind, 'I' || place_id AS tagged FROM corpus")
def renamed(spark, d):
    return table(spark, d, "corpus").select("place_id", "title").withColumnsRenamed({"place_id": "id"}).withColumns({"title": F.lower("title"), "kind": F.lit("tender"), "tagged": F.concat(F.lit("I"), F.col("id"))})


@query("project_cast_coerce", r"SELECT id, CASE WHEN regexp_full_match(metadata_value, '[+-]?[0-9]+') THEN TRY_CAST(metadata_value AS BIGINT) END AS whole, CASE WHEN regexp_full_match(metadata_value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(metadata_value AS DATE) END AS day, CASE WHEN regexp_full_match(metadata_value, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN try_strptime(metadata_value, '%d/%m/%Y')::DATE END AS local_day FROM metadatos")
def coerced(spark, d):
    """Whole numbers and dates of every value; what isn't one becomes null."""
    v = F.col("metadata_value")
    local = F.to_date(F.try_to_timestamp(v, F.lit("dd/MM/yyyy")))
    return table(spark, d, "metadatos").select("id", F.when(v.rlike(r"^[+-]?[0-9]+\z"), v.try_cast("long")).alias("whole"), F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), v.try_cast("date")).alias("day"), F.when(v.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"), local).alias("local_day"))


@query("project_drop_null_defaults", "SELECT doc_id, coalesce(lang, 'NA') AS lang, coalesce(source, 'NA') AS source FROM documents WHERE text IS NOT NULL")
def defaults(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").drop("missing_column").select("doc_id", F.coalesce("lang", F.lit("NA")).alias("lang"), F.coalesce("source", F.lit("NA")).alias("source"))


@query("project_record_json", "SELECT doc_id, lang, source, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END AS words FROM (SELECT doc_id, lang, source, list_filter(string_split(coalesce(lang, '') || ' ' || coalesce(source, ''), ' '), lambda x: x <> '') AS w FROM documents)")
def record(spark, d):
    """A record as JSON without its null and empty fields, read back: what was left out is null."""
    words = F.filter(F.split(F.concat_ws(" ", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), " "), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", words.alias("words"))
    back = F.from_json(to_record(rows, "lang", "source", "words"), "lang string, source string, words array<string>")
    return rows.select("doc_id", back.alias("r")).select("doc_id", "r.lang", "r.source", F.array_join("r.words", " ").alias("words"))


@query("project_serialisable", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN isfinite(value) THEN round(value, 6) END AS value FROM events")
def serialisable(spark, d):
    """Values as JSON holds them: times as ISO text, what isn't a number as null."""
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(iso(F.col("ts")).alias("ts"), finite(F.round("value", 6)).alias("value"))).alias("j"))
    return rows.select("event_id", F.from_json("j", "ts string, value double").alias("r")).select("event_id", "r.ts", "r.value")


@query("project_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL")
def json_fields(spark, d):
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("project_searchable", "SELECT place_id, indexed_at, concat_ws(' ', CASE WHEN lower(trim(title)) NOT IN ('', 'nan', 'none') THEN title END, CASE WHEN lower(trim(generated_objective)) NOT IN ('', 'nan', 'none') THEN generated_objective END) AS searchable FROM corpus")
def searchable_field(spark, d):
    return table(spark, d, "corpus").select("place_id", "indexed_at", searchable(F.col("title"), F.col("generated_objective")).alias("searchable"))


@query("project_null_like", "SELECT id, CASE WHEN lower(trim(metadata_value)) NOT IN ('nan', 'nat', 'none', 'null', '', 'n/a', 'na') THEN metadata_value END AS v FROM metadatos")
def null_likes(spark, d):
    return table(spark, d, "metadatos").select("id", null_like(F.col("metadata_value")).alias("v"))


@query("project_word_count", r"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS nwords FROM documents")
def nwords(spark, d):
    return table(spark, d, "documents").select("doc_id", word_count(F.col("text")).alias("nwords"))


_CPV = "list_sort(list_distinct(list_transform(list_filter(string_split(regexp_replace(cpv, '[\\[\\]''\"\\s]', '', 'g'), ','), lambda x: x <> ''), lambda x: lpad(string_split(x, '.')[1], 8, '0'))))"


@query("project_cpv_list", f"SELECT place_id, indexed_at, array_to_string({_CPV}, ',') AS codes FROM corpus WHERE cpv IS NOT NULL")
def cpvs(spark, d):
    return table(spark, d, "corpus").where("cpv IS NOT NULL").select("place_id", "indexed_at", F.array_join(cpv_list(F.col("cpv")), ",").alias("codes"))


@query("project_nested_codes", "SELECT place_id, indexed_at, array_to_string(list_filter(list_transform(string_split(cpv, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS codes FROM corpus WHERE cpv IS NOT NULL")
def nested_codes(spark, d):
    """Codes wrapped in a list of lists and in text come out flat."""
    rows = table(spark, d, "corpus").where("cpv IS NOT NULL").select("place_id", "indexed_at", comma_list(F.col("cpv")).alias("l"))
    wrapped = rows.withColumn("s", F.concat(F.lit("[['"), F.array_join("l", "'], ['"), F.lit("']]")))
    return wrapped.select("place_id", "indexed_at", F.array_join(unwrapped(F.col("s")), "|").alias("codes"))


@query("project_cpv_prefix", f"SELECT place_id, indexed_at, array_to_string(list_sort(list_distinct(list_transform({_CPV}, lambda x: x[1:2]))), ',') AS two FROM corpus WHERE cpv IS NOT NULL")
def cpv_twos(spark, d):
    return table(spark, d, "corpus").where("cpv IS NOT NULL").select("place_id", "indexed_at", F.array_join(cpv_prefixes(F.col("cpv")), ",").alias("two"))


# -- joins -------------------------------------------------------------------------------------


@query("join_inner_renamed", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def inner(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 200000")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return orders.join(c, orders.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("join_left_fanout", "SELECT u.id, count(m.id) AS n FROM uploads u LEFT JOIN metadatos m ON m.document_id = u.id GROUP BY u.id")
def left(spark, d):
    counts = table(spark, d, "metadatos").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    per = table(spark, d, "uploads").groupBy("id").agg(F.count(F.lit(1)).alias("r")).join(counts, "id", "left")
    return per.select("id", (F.col("r") * F.coalesce("m", F.lit(0))).alias("n"))


@query("join_left_composite", "SELECT d.doc_id, t.target_share FROM documents d LEFT JOIN (SELECT source, 'es' AS lang, target_share FROM source_targets) t ON t.source = d.source AND t.lang = d.lang")
def composite(spark, d):
    t = table(spark, d, "source_targets").select("source", F.lit("es").alias("lang"), "target_share")
    return table(spark, d, "documents").join(t, ["source", "lang"], "left").select("doc_id", "target_share")


@query("join_full_fold", "SELECT coalesce(a.k, b.k, c.k) AS k, a.n AS n1, b.n AS n2, c.n AS n3 FROM (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1) a FULL JOIN (SELECT l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1) b USING (k) FULL JOIN (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1) c USING (k)")
def full_fold(spark, d):
    parts = [(table(spark, d, "lineitem"), "l_returnflag"), (table(spark, d, "lineitem"), "l_linestatus"), (table(spark, d, "orders"), "o_orderstatus")]
    counted = [t.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, (t, c) in enumerate(parts, 1)]
    return reduce(lambda a, b: a.join(b, "k", "full"), counted)


@query("join_eav_lists", "SELECT u.id, string_agg(m.k, ',' ORDER BY m.k) AS keys FROM (SELECT DISTINCT id FROM uploads) u LEFT JOIN (SELECT DISTINCT document_id, lower(metadata_key) AS k FROM metadatos) m ON m.document_id = u.id GROUP BY u.id")
def eav_lists(spark, d):
    m = table(spark, d, "metadatos").select(F.col("document_id").alias("id"), F.lower("metadata_key").alias("k")).distinct()
    lists = m.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keys"))  # distinct keys of a document
    return table(spark, d, "uploads").select("id").distinct().join(lists, "id", "left").select("id", F.nullif("keys", F.lit("")).alias("keys"))


@query("join_anti", "SELECT DISTINCT m.document_id FROM metadatos m WHERE m.document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM uploads u WHERE u.id = m.document_id)")
def anti(spark, d):
    return table(spark, d, "metadatos").select("document_id").where("document_id IS NOT NULL").distinct().join(table(spark, d, "uploads"), F.col("document_id") == F.col("id"), "left_anti")


@query("join_semi", "SELECT place_id, title FROM pliegos p WHERE EXISTS (SELECT 1 FROM corpus c WHERE c.place_id = p.place_id AND c.origin = 'insiders')")
def semi(spark, d):
    return table(spark, d, "pliegos").join(table(spark, d, "corpus").where("origin = 'insiders'"), "place_id", "left_semi").select("place_id", "title")


@query("join_pair_enumeration", "SELECT a.model AS a, b.model AS b FROM (SELECT DISTINCT model FROM model_alias) a JOIN (SELECT DISTINCT model FROM model_alias) b ON a.model < b.model")
def pairs(spark, d):
    m = table(spark, d, "model_alias").select("model").distinct()  # a fixed list of systems
    return m.select(F.col("model").alias("a")).join(m.select(F.col("model").alias("b")), F.col("a") < F.col("b"))


@query("join_neighbour_window", "WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), h AS (SELECT * FROM c WHERE l_quantity >= 49) SELECT DISTINCT c.l_orderkey, c.l_linenumber FROM c JOIN h ON c.l_orderkey = h.l_orderkey AND abs(c.l_linenumber - h.l_linenumber) <= 1")
def neighbour(spark, d):
    from acervo.operators.retrieval import neighbours

    c = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx"), "l_quantity")
    return neighbours(c.select("l_orderkey", "idx"), c.where("l_quantity >= 49"), "l_orderkey").select("l_orderkey", F.col("idx").alias("l_linenumber")).distinct()


# -- sorts, samples, set operations ---------------------------------------------------------------


@query("sort_multi_key", "SELECT p_brand, p_type, p_partkey FROM part ORDER BY p_brand, p_type DESC, p_partkey")
def multi_key(spark, d):
    from acervo.operators.retrieval import parse_sort

    return table(spark, d, "part").select("p_brand", "p_type", "p_partkey").orderBy(*parse_sort("p_brand:asc,p_type:desc", "p_partkey"))


@query("sort_by_aggregate", "SELECT origin, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, origin) AS rank FROM corpus WHERE origin IS NOT NULL GROUP BY origin")
def by_aggregate(spark, d):
    counts = table(spark, d, "corpus").where("origin IS NOT NULL").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "origin")).cast("long"))  # a few origins


@query("top_k_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def top_k(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 2").select("o_custkey", "o_orderkey", "rn")


@query("sample_split", "SELECT doc_id, ('0x' || substr(md5('42|' || doc_id), 1, 7))::BIGINT % 100 < 80 AS train FROM documents")
def split(spark, d):
    """Deterministic 80/20 split by digest; the complement is what the sample leaves."""
    return table(spark, d, "documents").select("doc_id", (F.conv(F.substring(drawn(42, "doc_id"), 1, 7), 16, 10).cast("long") % 100 < 80).alias("train"))


@query("sample_pairs", "WITH p AS (SELECT a.model AS a, b.model AS b FROM (SELECT DISTINCT model FROM model_alias) a JOIN (SELECT DISTINCT model FROM model_alias) b ON a.model < b.model) SELECT a, b FROM (SELECT *, row_number() OVER (ORDER BY md5('7|' || a || '|' || b)) AS r, count(*) OVER () AS n FROM p) WHERE r <= greatest(1, n // 3)")
def pair_sample(spark, d):
    """A third of the pairs of systems, one at least, drawn by digest. The systems are a fixed list."""
    m = table(spark, d, "model_alias").select("model").distinct()
    p = m.select(F.col("model").alias("a")).join(m.select(F.col("model").alias("b")), F.col("a") < F.col("b"))
    n = p.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 3)).alias("n"))
    ranked = p.withColumn("r", F.row_number().over(Window.orderBy(drawn(7, "a", "b"))))
    return ranked.join(F.broadcast(n), F.col("r") <= F.col("n")).select("a", "b")  # one row


@query("sample_stratified", "WITH d AS (SELECT doc_id, lang FROM documents WHERE lang IN ('es', 'ca')), s AS (SELECT lang, least(count(*), 500) AS n FROM d GROUP BY 1), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS rn FROM d) SELECT doc_id, lang FROM r JOIN s USING (lang) WHERE rn <= n + 1000 - (SELECT sum(n) FROM s)")
def stratified(spark, d):
    """500 a stratum, what one lacks taken from the other: ranks per stratum, then arithmetic on counts."""
    rows = table(spark, d, "documents").where("lang IN ('es', 'ca')").select("doc_id", "lang")
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(drawn(42, "doc_id"), "doc_id"))).where("rn <= 1000")
    sizes = rows.groupBy("lang").agg(F.least(F.count(F.lit(1)), F.lit(500)).alias("n"))
    short = sizes.agg((F.lit(1000) - F.sum("n")).alias("short"))
    return ranked.join(F.broadcast(sizes), "lang").crossJoin(F.broadcast(short)).where("rn <= n + short").select("doc_id", "lang")  # two rows and one


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("set_operations", "SELECT 'both' AS side, word FROM (SELECT word FROM common_words WHERE lang = 'es' INTERSECT SELECT word FROM common_words WHERE lang = 'gl') UNION ALL SELECT 'es', word FROM (SELECT word FROM common_words WHERE lang = 'es' EXCEPT SELECT word FROM common_words WHERE lang = 'gl') UNION ALL SELECT 'any', word FROM (SELECT word FROM common_words WHERE lang = 'es' UNION SELECT word FROM common_words WHERE lang = 'gl')")
def sets(spark, d):
    words = table(spark, d, "common_words")
    es, gl = words.where("lang = 'es'").select("word"), words.where("lang = 'gl'").select("word")
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "word")
    return tag(es.intersect(gl), "both").unionAll(tag(es.subtract(gl), "es")).unionAll(tag(es.union(gl).distinct(), "any"))
