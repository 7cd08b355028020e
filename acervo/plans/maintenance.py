"""Sources, sinks, table maintenance, the raw query surface and streams, each as a round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from acervo.operators.selection import greedy
from acervo.plans.catalog import Catalog, raw_query
from acervo.plans.registry import query
from acervo.runtime import shared_dir, table
from acervo.sources import readers, sinks
from acervo.streaming.upserts import Buckets, ingest, run_windows


def _folder(spark, name):
    return f"{shared_dir(spark)}/acervo-{name}-{uuid.uuid4().hex}"


@query("s4_json_round_trip", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def s4(spark, d):
    out = _folder(spark, "json")
    sinks.write_json(table(spark, d, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value")), out)
    return readers.json_records(spark, out, "event_id long, user_id long, event_type string, value double")


@query("s8_csv_round_trip", "SELECT doc_id, replace(text, chr(13), '') AS text, lang FROM documents WHERE text IS NOT NULL AND text <> '' AND lang IS NOT NULL")
def s8(spark, d):
    out = _folder(spark, "csv")
    rows = table(spark, d, "documents").where("text IS NOT NULL AND text <> '' AND lang IS NOT NULL").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), "lang")
    sinks.write_csv(rows, out + ".csv")
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).schema("doc_id long, text string, lang string").csv(out + ".csv")
    return read


@query("s8_last_instance_wins", "SELECT id::VARCHAR AS id, metadata_key FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id DESC) AS rn FROM (SELECT DISTINCT * FROM metadatos WHERE document_id IS NOT NULL)) WHERE rn = 1")
def s8b(spark, d):
    rows = table(spark, d, "metadatos").distinct().withColumn("doc", F.col("document_id"))
    return readers.instances(rows, "doc", "id").select(F.col("id").cast("string").alias("id"), "metadata_key")


@query("s11_line_corpus", r"SELECT place_id AS id, trim(regexp_replace(lemmas, '\s+', ' ', 'g'), ' ') AS tokens FROM (SELECT place_id, max(lemmas) AS lemmas FROM corpus WHERE trim(regexp_replace(lemmas, '\s+', ' ', 'g'), ' ') <> '' GROUP BY 1)")
def s11(spark, d):
    out = _folder(spark, "lines")
    tokens = F.trim(F.regexp_replace("lemmas", r"\s+", " "))
    rows = table(spark, d, "corpus").where(tokens != "").groupBy("place_id").agg(F.max("lemmas").alias("lemmas"))
    rows.select(F.concat("place_id", F.lit(" 0 "), tokens).alias("value")).write.text(out)
    return readers.line_corpus(spark, out)


@query("k1_upsert", "SELECT c_custkey, c_name, c_acctbal, NULL::INTEGER AS version FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT c_custkey, upper(c_name), NULL, 2 FROM customer WHERE c_nationkey < 5")
def k1(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    few = base.where("c_nationkey < 5")
    changes = few.select("c_custkey", F.lower("c_name").alias("c_name"), F.lit(1).alias("version")).unionByName(few.select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(2).alias("version")))
    return sinks.upsert(base.drop("c_nationkey"), changes, "c_custkey", "version")


@query("k2_delete", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def k2(spark, d):
    return sinks.delete(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("k3_partial_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'changed' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'a,b,c' ELSE 'a,b' END AS tags FROM supplier")
def k3(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", F.array(F.lit("a"), F.lit("b")).alias("tags"))
    changes = base.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("changed").alias("s_name"), F.array(F.lit("b"), F.lit("c")).alias("tags"))
    out = sinks.partial_update(base, changes, "s_suppkey", {"s_name": "set", "tags": "add"})
    return out.select("s_suppkey", "s_name", F.array_join("tags", ",").alias("tags"))


@query("k5_chunked_parquet", "SELECT o_orderkey, o_orderstatus FROM orders")
def k5(spark, d):
    out = _folder(spark, "chunks")
    sinks.write_parquet(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), out, rows_per_file=4000)
    return readers.parquet(spark, out)


@query("k6_ranked_folders", "WITH n AS (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS idx FROM customer GROUP BY 1) SELECT c_custkey, idx::INTEGER AS idx, c_mktsegment FROM customer JOIN n USING (c_mktsegment)")
def k6(spark, d):
    out = _folder(spark, "folders")
    sinks.write_ranked_folders(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", out)
    return readers.parquet(spark, out).select("c_custkey", "idx", "c_mktsegment")


@query("k9_resumed_batch", "SELECT c_custkey, upper(c_name) AS name FROM customer")
def k9(spark, d):
    """The second run does what the first left."""
    ledger = _folder(spark, "ledger")
    work = table(spark, d, "customer").select("c_custkey", "c_name")
    step = lambda df: df.select("c_custkey", F.upper("c_name").alias("name"))
    sinks.run_batch(work.where("c_custkey % 2 = 0"), ledger, "c_custkey", step)
    return sinks.run_batch(work, ledger, "c_custkey", step)


@query("k10_ledger", "SELECT count(*) AS done, true AS skipped FROM customer")
def k10(spark, d):
    """A job whose ledger has a row for each row of the work is skipped."""
    ledger = _folder(spark, "ledger")
    work = table(spark, d, "customer").select("c_custkey")
    if not sinks.same_rows(spark, ledger, work):
        sinks.run_batch(work, ledger, "c_custkey", lambda df: df)
    skipped = sinks.same_rows(spark, ledger, work)
    return spark.read.parquet(ledger).agg(F.count(F.lit(1)).alias("done")).withColumn("skipped", F.lit(skipped))


@query("q3_ndocs_of_collection", "SELECT count(DISTINCT place_id) AS ndocs FROM corpus")
def q3(spark, d):
    catalog = Catalog(spark, _folder(spark, "catalog"))
    rows = table(spark, d, "corpus").select("place_id", "title").groupBy("place_id").agg(F.max("title").alias("title"))
    catalog.index_corpus("Tenders", rows, {"id": "place_id"}, ("title",), ("title",))
    return catalog.read("tenders").agg(F.count(F.lit(1)).alias("ndocs"))


@query("q6_metadata_by_doc", "SELECT place_id AS id, max(title) AS title FROM corpus WHERE place_id = (SELECT min(place_id) FROM corpus) GROUP BY 1")
def q6(spark, d):
    rows = table(spark, d, "corpus").groupBy(F.col("place_id").alias("id")).agg(F.max("title").alias("title"))
    first = rows.agg(F.min("id")).first()[0]
    return raw_query(rows, f'id:"{first}"', fl="id, title")


@query("q7_docs_with_string", r"SELECT doc_id AS id FROM documents WHERE list_has_any(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), ['penalidad', 'diaria'])")
def q7(spark, d):
    """All words of an unquoted string are bound to the field."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return raw_query(rows, "text:penalidad OR text:diaria", fl="id")


@query("d9_raw_query", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice >= 100000 AND o_totalprice < 200000 AND o_custkey <> 7")
def d9(spark, d):
    rows = table(spark, d, "orders").withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "status", "o_orderpriority": "priority", "o_custkey": "cust"})
    return raw_query(rows, '(status:F OR priority:"1 URGENT") AND NOT cust:7', fq="o_totalprice:[100000 TO 200000}", fl="id,o_totalprice")


@query("r10_greedy_selection", """WITH RECURSIVE c AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, l_extendedprice / 1e5 AS score, l_quantity::INT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / 1e5 DESC, l_linenumber) AS r FROM lineitem),
s AS (SELECT doc_id, 0::BIGINT AS r, []::INTEGER[] AS taken, 0 AS used, NULL::DOUBLE AS last FROM (SELECT DISTINCT doc_id FROM c)
  UNION ALL SELECT doc_id, r, CASE WHEN ok THEN list_append(taken, idx) ELSE taken END, CASE WHEN ok THEN used + size ELSE used END, CASE WHEN ok THEN score ELSE last END FROM (
    SELECT s.doc_id, c.r, s.taken, s.used, s.last, c.idx::INTEGER AS idx, c.size, c.score,
      len(list_filter(s.taken, lambda t: abs(t - c.idx) < 2)) = 0 AND (s.last IS NULL OR len(s.taken) < 1 OR c.score >= 0.6 * s.last) AND s.used + c.size <= 90 AND len(s.taken) < 4 AS ok
    FROM s JOIN c ON c.doc_id = s.doc_id AND c.r = s.r + 1))
SELECT doc_id, unnest(range(0, len(taken)))::INTEGER AS "order", unnest(taken) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) AS z FROM s) WHERE z = 1""")
def r10(spark, d):
    """Lines of an order as chunks: a diverse selection under a budget."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), (F.col("l_extendedprice") / 1e5).alias("score"), F.col("l_quantity").cast("int").alias("size"))
    return greedy(rows, "doc_id", budget=90, gap=2, drop=0.6, least=1, most=4)


@query("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark, d):
    """A finite stream run to its end in append mode, into a folder: a window is written when the watermark has
    passed it, the last ones because a closing row of no type, two days later, comes after the rest."""
    source, out = _folder(spark, "stream-in"), _folder(spark, "stream-out")
    events = table(spark, d, "events").select("ts", "event_type", "value")
    events.write.parquet(source)
    stamps = _folder(spark, "stream")
    run_windows(spark, source, out, stamps, "60 days")  # rows come in any order, so none is late
    end = events.agg((F.max("ts") + F.expr("INTERVAL 62 DAYS")).alias("ts")).select("ts", F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    end.write.mode("append").parquet(source)
    run_windows(spark, source, out, stamps, "60 days")
    rows = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out)
    return rows.where("event_type IS NOT NULL").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1")
def stream_upsert(spark, d):
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).select("user_id", "ts", "event_id", "event_type")
    out = Buckets(spark, _folder(spark, "buckets"), "user_id", "ts")
    ingest(rows.where("user_id IS NOT NULL"), out, _folder(spark, "stream")).awaitTermination()
    return out.read().select("user_id", "event_id", "event_type")
