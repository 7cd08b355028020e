"""Topic, vector and retrieval queries. Thetas are the softmax of twice the components of the
vectors; betas come from words of documents spread over as many topics by id."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from acervo.operators import retrieval as R
from acervo.operators import topics as T
from acervo.operators.encoders import complete
from acervo.operators.ranking import bucket_rank
from acervo.operators.search import block_search, cosine, unit
from acervo.functions.procurement import word_count
from acervo.plans.registry import query
from acervo.runtime import materialise, shared_dir, table

K = 64
#: Neighbours of a document that the export of similarities takes before the triangle.
TOP_SIMILAR = 300
_TH = """e AS (SELECT vec_id AS doc_id, unnest(range(0, 64)) AS topic, exp(2 * unnest(embedding[1:64])::DOUBLE) AS x FROM embeddings),
th AS (SELECT doc_id, topic::INTEGER AS topic, x / sum(x) OVER (PARTITION BY doc_id) AS w FROM e),
sp AS (SELECT doc_id, topic, w / sum(w) OVER (PARTITION BY doc_id) AS w FROM th WHERE w >= 0.003)"""
_INT = f"""{_TH},
sc AS (SELECT doc_id, topic, round(w * 1000, 9) AS x, floor(round(w * 1000, 9)) AS n FROM sp),
rk AS (SELECT doc_id, topic, n, 1000 - sum(n) OVER (PARTITION BY doc_id) AS short, row_number() OVER (PARTITION BY doc_id ORDER BY round(x - n, 9) DESC, topic) AS r FROM sc),
iw AS (SELECT doc_id, topic, (n + CASE WHEN r <= short THEN 1 ELSE 0 END)::BIGINT AS n FROM rk)"""
_TOK = r"tok AS (SELECT doc_id, (doc_id % 64)::INTEGER AS topic, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS term FROM documents)"
_BETA = f"{_TOK}, cn AS (SELECT topic, term, count(*) AS n FROM tok GROUP BY ALL), b AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS w FROM cn)"


def thetas(spark, d):
    v = F.slice("embedding", 1, K)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode(v).alias("topic", "c"))
    x = F.exp(2 * F.col("c").cast("double"))
    return rows.select("doc_id", "topic", (x / F.sum(x).over(Window.partitionBy("doc_id"))).alias("w"))


def sparse(spark, d):
    return T.sparsify(thetas(spark, d))


def words(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("doc_id") % K).cast("int").alias("topic"), F.explode(R.tokens(F.col("text"))).alias("term"))


def betas(spark, d):
    return T.betas(words(spark, d).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n")))


def alphas(spark, d):
    return T.alphas(sparse(spark, d))


@query("t1_thetas_encoded", f"WITH {_INT} SELECT doc_id, string_agg('t' || topic || '|' || n, ' ' ORDER BY topic) AS thetas FROM iw WHERE n > 0 GROUP BY doc_id")
def encoded(spark, d):
    return T.encode(T.to_integers(sparse(spark, d)))


@query("t1_thetas_decoded", f"WITH {_INT} SELECT doc_id, count(*) AS topics, sum(n)::BIGINT AS total FROM iw WHERE n > 0 GROUP BY doc_id")
def decoded(spark, d):
    m = T.decode(F.col("thetas"))
    return encoded(spark, d).select("doc_id", F.size(m).cast("long").alias("topics"), F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + x).cast("long").alias("total"))


@query("q1_thetas_by_doc", f"WITH {_INT}, en AS (SELECT doc_id, string_agg('t' || topic || '|' || n, ' ' ORDER BY topic) AS thetas FROM iw WHERE n > 0 GROUP BY 1) SELECT id, coalesce(thetas, '-1') AS thetas FROM (VALUES (7), (-5)) t(id) LEFT JOIN en ON doc_id = id")
def q1(spark, d):
    """A document without weights has -1."""
    asked = spark.createDataFrame([(7,), (-5,)], "id int")
    met = asked.join(encoded(spark, d), F.col("doc_id") == F.col("id"), "left")
    return met.select("id", F.coalesce("thetas", F.lit("-1")).alias("thetas"))


@query("q5_similar_to_doc", f"WITH {_TH} SELECT a.doc_id, round(sum(sqrt(a.w * b.w)) * 100 / 1002, 6) AS score FROM sp a JOIN sp b ON a.topic = b.topic AND b.doc_id = 7 GROUP BY a.doc_id")
def q5(spark, d):
    s = sparse(spark, d)
    return T.bhattacharyya(s, s.where("doc_id = 7").select("topic", F.col("w").alias("q"))).select("doc_id", F.round("score", 6).alias("score"))


@query("q14_similar_to_text_topics", f"WITH {_TH}, q AS (SELECT * FROM (VALUES (0, 0.5), (3, 0.3), (5, 0.2)) t(topic, q)) SELECT doc_id, round(sum(sqrt(w * q)) * 100 / 1002, 6) AS score FROM sp JOIN q USING (topic) GROUP BY doc_id")
def q14(spark, d):
    q = spark.createDataFrame([(0, 0.5), (3, 0.3), (5, 0.2)], "topic int, q double")
    return T.bhattacharyya(sparse(spark, d), q).select("doc_id", F.round("score", 6).alias("score"))


@query("q9_topic_top_docs", f"WITH {_INT}, w AS (SELECT doc_id, max(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) AS nwords FROM documents GROUP BY 1) SELECT doc_id, n AS weight, round(n * 0.1, 6) AS relevance, nwords FROM iw LEFT JOIN w USING (doc_id) WHERE topic = 2 AND n > 0 ORDER BY n DESC, nwords DESC NULLS LAST, doc_id LIMIT 100")
def q9(spark, d):
    """By weight, then by number of words; relevance is a tenth of the weight. At most 100, as the page has."""
    sizes = table(spark, d, "documents").groupBy("doc_id").agg(F.max(word_count(F.col("text"))).cast("long").alias("nwords"))
    rows = T.to_integers(sparse(spark, d)).where("topic = 2 AND n > 0").join(sizes, "doc_id", "left").select("doc_id", F.col("n").alias("weight"), F.round(F.col("n") * 0.1, 6).alias("relevance"), "nwords")
    return R.page(rows, [F.desc("weight"), F.desc_nulls_last("nwords"), F.asc("doc_id")], 0, 100)


@query("t9_betas", f"WITH {_BETA} SELECT topic, term, round(w, 9) AS w FROM b")
def t9(spark, d):
    return betas(spark, d).select("topic", "term", F.round("w", 9).alias("w"))


@query("t6_sparse_thetas", f"WITH {_TH} SELECT doc_id, topic, round(w, 9) AS w FROM sp")
def t6(spark, d):
    return sparse(spark, d).select("doc_id", "topic", F.round("w", 9).alias("w"))


@query("a9_alphas", f"WITH {_TH} SELECT topic, round(sum(w) / (SELECT count(*) FROM embeddings), 9) AS alpha, count_if(w <> 0) AS ndocs_active FROM sp GROUP BY topic")
def a9(spark, d):
    return alphas(spark, d).select("topic", F.round("alpha", 9).alias("alpha"), "ndocs_active")


@query("t10_sorted_topics", f"WITH {_TH}, a AS (SELECT topic, sum(w) AS s FROM sp GROUP BY topic) SELECT topic, row_number() OVER (ORDER BY round(s / (SELECT count(*) FROM embeddings), 12) DESC, topic) - 1 AS new_topic FROM a")
def t10(spark, d):
    return T.reorder(alphas(spark, d)).withColumn("new_topic", F.col("new_topic").cast("long"))


_SORT = "so AS (SELECT topic, row_number() OVER (ORDER BY round(sum(w) / (SELECT count(*) FROM embeddings), 12) DESC, topic) - 1 AS new_topic FROM sp GROUP BY topic)"


@query("t10_reindexed_thetas", f"WITH {_TH}, {_SORT} SELECT doc_id, new_topic AS topic, round(w, 9) AS w FROM sp JOIN so USING (topic)")
def t10b(spark, d):
    s = sparse(spark, d)
    return T.reindex(s, T.reorder(alphas(spark, d))).select("doc_id", F.col("topic").cast("long").alias("topic"), F.round("w", 9).alias("w"))


@query("t10_reindexed_betas", f"WITH {_TH}, {_SORT}, {_BETA} SELECT new_topic AS topic, term, round(b.w, 9) AS w FROM b JOIN so USING (topic)")
def t10c(spark, d):
    return T.reindex(betas(spark, d), T.reorder(alphas(spark, d))).select(F.col("topic").cast("long").alias("topic"), "term", F.round("w", 9).alias("w"))


@query("t11_downscored_betas", f"WITH {_BETA}, m AS (SELECT term, (sum(ln(w + 1e-12)) + (64 - count(*)) * ln(1e-12)) / 64 AS mean FROM b GROUP BY term) SELECT topic, term, round(w * (ln(w + 1e-12) - mean), 7) AS score FROM b JOIN m USING (term)")
def t11(spark, d):
    return T.downscore(betas(spark, d), K).select("topic", "term", F.round("score", 7).alias("score"))


@query("t12_topic_entropy", f"WITH {_BETA} SELECT topic, round(-sum(w * ln(w)) / ln((SELECT count(DISTINCT term) FROM b)), 6) AS entropy FROM b GROUP BY topic")
def t12(spark, d):
    b = betas(spark, d)
    v = b.agg(F.countDistinct("term")).first()[0]
    return T.entropy(b, v).select("topic", F.round("entropy", 6).alias("entropy"))


_TOP = f"{_BETA}, tp AS (SELECT * FROM (SELECT topic, term, w, row_number() OVER (PARTITION BY topic ORDER BY round(w, 12) DESC, term) AS rank FROM b) WHERE rank <= 15)"


@query("q8_topic_labels", f"WITH {_TOP} SELECT topic, string_agg(term, ', ' ORDER BY rank) AS label FROM tp WHERE rank <= 3 GROUP BY topic")
def q8(spark, d):
    return T.describe(T.top_terms(betas(spark, d), 3)).withColumnRenamed("description", "label")


@query("t13_topic_descriptions", f"WITH {_TOP} SELECT topic, string_agg(term, ', ' ORDER BY rank) AS description FROM tp GROUP BY topic")
def t13(spark, d):
    return T.describe(T.top_terms(betas(spark, d)))


@query("t14_relative_weights", f"WITH {_TOP} SELECT topic, rank, term, round(100 * w / first_value(w) OVER (PARTITION BY topic ORDER BY rank), 3) AS relative FROM tp")
def t14(spark, d):
    return T.relative_weights(T.top_terms(betas(spark, d))).withColumn("rank", F.col("rank").cast("long"))


_INFO = f"""{_TOP}, {_TH}, a AS (SELECT topic, sum(w) / (SELECT count(*) FROM embeddings) AS alpha, count_if(w <> 0) AS n FROM sp GROUP BY topic),
en AS (SELECT topic, -sum(w * ln(w)) / ln((SELECT count(DISTINCT term) FROM b)) AS entropy FROM b GROUP BY topic),
ds AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS description, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 3) AS label, string_agg(term || '|' || printf('%.3f', relative), ' ' ORDER BY rank) AS top_words, string_agg(term || '|' || printf('%.6f', w), ' ' ORDER BY rank) AS word_betas FROM (SELECT *, round(100 * w / max(w) OVER (PARTITION BY topic), 3) AS relative FROM tp) GROUP BY topic),
vo AS (SELECT topic, count(*) AS vocabulary FROM b GROUP BY topic)"""


@query("q10_model_info", f"WITH {_INFO} SELECT 't' || topic AS id, round(alpha, 6) AS alphas, n AS ndocs_active, round(entropy, 6) AS topic_entropy, label AS tpc_labels, description AS tpc_descriptions, top_words AS top_words_betas, word_betas AS betas, vocabulary AS vocab FROM a LEFT JOIN en USING (topic) LEFT JOIN ds USING (topic) LEFT JOIN vo USING (topic)")
def q10(spark, d):
    """A row of nine attributes for every topic."""
    b = betas(spark, d)
    return T.model_rows(alphas(spark, d), b, b.agg(F.countDistinct("term")).first()[0])


@query("t31_theta_updates", f"WITH {_INT} SELECT doc_id, '{{\"set\":\"' || string_agg('t' || topic || '|' || n, ' ' ORDER BY topic) || '\"}}' AS update FROM iw WHERE n > 0 GROUP BY doc_id")
def t31(spark, d):
    """The records that set the weights of documents in a corpus."""
    return encoded(spark, d).select("doc_id", F.to_json(F.struct(F.col("thetas").alias("set"))).alias("update"))


@query("t25_topics_table", f"WITH {_INFO} SELECT printf('%.4f', alpha) AS size, upper(label) AS label, description, n::VARCHAR AS ndocs_active, printf('%.4f', entropy) AS entropy FROM a LEFT JOIN en USING (topic) LEFT JOIN ds USING (topic)")
def t25(spark, d):
    """The table of topics as it is shown, with labels that were set."""
    b, a = betas(spark, d), alphas(spark, d)
    rows = T.model_rows(a, b, b.agg(F.countDistinct("term")).first()[0], 12)
    labelled = T.set_labels(rows.withColumnRenamed("tpc_labels", "label"), rows.select("id", F.upper("tpc_labels").alias("label")), "id", "label")
    return labelled.select(F.format_string("%.4f", "alphas").alias("size"), "label", F.col("tpc_descriptions").alias("description"), F.col("ndocs_active").cast("string").alias("ndocs_active"), F.format_string("%.4f", "topic_entropy").alias("entropy"))


@query("t25_reset_model", f"WITH {_TH} SELECT doc_id, topic, round(w, 9) AS w FROM sp")
def t25b(spark, d):
    """A model changed and set back to what was saved."""
    model = T.save(f"{shared_dir(spark)}/acervo-model-{uuid.uuid4().hex}", thetas=sparse(spark, d), alphas=alphas(spark, d))
    T.save(model, thetas=T.drop_topics(T.load(spark, model, "thetas"), [1, 4]))
    return T.reset(spark, model, "thetas").select("doc_id", "topic", F.round("w", 9).alias("w"))


@query("t35_saved_model", f"WITH {_TH}, {_BETA} SELECT 'betas' AS part, count(*) AS n FROM b UNION ALL SELECT 'thetas', count(*) FROM sp UNION ALL SELECT 'alphas', count(DISTINCT topic) FROM sp")
def t35(spark, d):
    model = T.save(f"{shared_dir(spark)}/acervo-model-{uuid.uuid4().hex}", thetas=sparse(spark, d), betas=betas(spark, d), alphas=alphas(spark, d))
    counts = [T.load(spark, model, p).agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n")) for p in ("betas", "thetas", "alphas")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("t28_labelled_topics", f"WITH {_TOP}, ds AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS d FROM tp GROUP BY topic) SELECT topic, d AS description, upper(string_split(d, ', ')[1]) AS label FROM ds")
def t28(spark, d):
    """Labels by a model, here a callable that gives the first word in capitals."""
    return complete(T.describe(T.top_terms(betas(spark, d))), "description", lambda prompts: [p.split(", ")[0].upper() for p in prompts], out="label")


@query("q22_infer_topic_info", f"WITH {_TOP}, {_INT} SELECT 't' || iw.topic AS id, n AS weight, (SELECT string_agg(term, ', ' ORDER BY rank) FROM tp WHERE tp.topic = iw.topic) AS description FROM iw WHERE doc_id = 11 AND n > 0")
def q22(spark, d):
    weights = T.to_integers(sparse(spark, d)).where("doc_id = 11 AND n > 0")
    return weights.join(T.describe(T.top_terms(betas(spark, d))), "topic", "left").select(F.concat(F.lit("t"), F.col("topic").cast("string")).alias("id"), F.col("n").alias("weight"), "description")


@query("t16_s3_scores", f"WITH {_BETA} SELECT t.doc_id, b.topic, round(sum(b.w) + 1e-10, 6) AS score FROM (SELECT doc_id, term FROM tok) t JOIN b USING (term) GROUP BY ALL")
def t16(spark, d):
    return T.s3(words(spark, d).select("doc_id", "term"), betas(spark, d), K).select("doc_id", "topic", F.round(F.col("score") + 1e-10, 6).alias("score"))


@query("t17_top_docs_per_topic", f"WITH {_BETA}, s AS (SELECT t.doc_id, b.topic, sum(b.w) AS score FROM (SELECT doc_id, term FROM tok) t JOIN b USING (term) GROUP BY ALL), r AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT topic, rank, doc_id FROM r WHERE rank <= 3")
def t17(spark, d):
    return T.top_docs(T.s3(words(spark, d).select("doc_id", "term"), betas(spark, d), K)).select("topic", F.col("rank").cast("long").alias("rank"), "doc_id")


@query("t18_similar_documents", f"WITH {_TH}, s AS (SELECT q.doc_id AS query, r.doc_id AS id, sum(sqrt(q.w * r.w)) AS score FROM sp q JOIN sp r ON q.topic = r.topic WHERE q.doc_id % 100 = 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s) SELECT query, id, round(score, 6) AS score, rank FROM k WHERE rank <= 50")
def t18(spark, d):
    s = sparse(spark, d)
    root = s.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", F.sqrt("w")))).alias("m"))  # at most K entries
    rows = root.select(F.col("doc_id").alias("id"), F.array(*[F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0.0)) for t in range(K)]).alias("v"))
    return block_search(rows.where("id % 100 = 0"), rows, 50, K).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("t19_similarity_export", f"WITH {_TH}, s AS (SELECT q.doc_id AS query, r.doc_id AS id, sum(sqrt(q.w * r.w)) AS score FROM sp q JOIN sp r ON q.topic = r.topic GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s), l AS (SELECT query, list(id || '|' || printf('%.6f', score) ORDER BY rank) FILTER (id > query AND score > 0) AS l FROM k WHERE rank <= {TOP_SIMILAR} GROUP BY query) SELECT query, array_to_string(coalesce(l, [])[2:], ' ') AS similar FROM l")
def t19(spark, d):
    """The similarities as one line of 'id|score' per document: of its TOP_SIMILAR most similar documents,
    itself among them, those of larger id by falling score, without the first of these (as the
    reference has it). A document with none left has an empty line."""
    s = sparse(spark, d)
    root = s.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", F.sqrt("w")))).alias("m"))  # at most K entries
    rows = root.select(F.col("doc_id").alias("id"), F.array(*[F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0.0)) for t in range(K)]).alias("v"))
    near = block_search(rows, rows, TOP_SIMILAR, K)
    later = F.array_sort(F.collect_list(F.when((F.col("id") > F.col("query")) & (F.col("score") > 0), F.struct("rank", "id", F.format_string("%.6f", "score").alias("s")))))  # at most TOP_SIMILAR
    return near.groupBy("query").agg(later.alias("l")).select("query", F.array_join(F.transform(F.slice("l", 2, TOP_SIMILAR), lambda e: F.concat_ws("|", e["id"].cast("string"), e["s"])), " ").alias("similar"))


_FULL = "f AS (SELECT doc_id, topic, w FROM sp), n AS (SELECT count(*)::DOUBLE AS n FROM embeddings), mo AS (SELECT topic, sum(w) AS s, sum(w * w) AS ss FROM f GROUP BY topic)"


@query("t20_topic_correlation", f"WITH {_TH}, {_FULL}, co AS (SELECT a.topic AS i, b.topic AS j, sum(a.w * b.w) AS sxy FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.topic < b.topic GROUP BY ALL) SELECT i, j, round((sxy - x.s * y.s / n) / sqrt((x.ss - x.s * x.s / n) * (y.ss - y.s * y.s / n)), 6) AS r FROM co JOIN mo x ON x.topic = i JOIN mo y ON y.topic = j, n")
def t20(spark, d):
    return T.correlation(sparse(spark, d), table(spark, d, "embeddings").count()).select("i", "j", F.round("r", 6).alias("r"))


_JS = f"WITH {_BETA}, u AS (SELECT term FROM b GROUP BY term HAVING max(w) > 1e-6), kp AS (SELECT topic, term, w / sum(w) OVER (PARTITION BY topic) AS p FROM b SEMI JOIN u USING (term)), g AS (SELECT t.topic, x.term, coalesce(kp.p, 0) AS p FROM (SELECT DISTINCT topic FROM kp) t CROSS JOIN (SELECT DISTINCT term FROM kp) x LEFT JOIN kp ON kp.topic = t.topic AND kp.term = x.term) SELECT x.topic AS i, y.topic AS j, round(1 - sqrt(greatest(sum(CASE WHEN x.p > 0 THEN x.p * ln(2 * x.p / (x.p + y.p)) ELSE 0 END + CASE WHEN y.p > 0 THEN y.p * ln(2 * y.p / (x.p + y.p)) ELSE 0 END) / 2, 0)), 6) AS similarity FROM g x JOIN g y ON x.term = y.term AND x.topic < y.topic GROUP BY ALL"


@query("t21_topic_similarity", _JS)
def t21(spark, d):
    return T.jensen_shannon(betas(spark, d)).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query("t22_largest_pairs", f"WITH js AS ({_JS}), m AS (SELECT i, j, similarity AS s FROM js UNION ALL SELECT j, i, similarity FROM js UNION ALL SELECT DISTINCT i, i, 1.0 FROM (SELECT i FROM js UNION SELECT j FROM js)), t AS (SELECT * FROM m ORDER BY s DESC, i, j LIMIT 100) SELECT i, j, s AS similarity FROM t WHERE i < j")
def t22(spark, d):
    """Of the hundred largest cells of the whole matrix those above the diagonal."""
    js = T.jensen_shannon(betas(spark, d)).select("i", "j", F.round("similarity", 6).alias("similarity"))
    return T.largest(js, 100)


@query("t23_deleted_topics", f"WITH {_TH} SELECT doc_id, topic, round(w / sum(w) OVER (PARTITION BY doc_id), 9) AS w FROM sp WHERE topic NOT IN (1, 4)")
def t23(spark, d):
    return T.drop_topics(sparse(spark, d), [1, 4]).select("doc_id", "topic", F.round("w", 9).alias("w"))


@query("t24_fused_topics", f"WITH {_TH} SELECT doc_id, (CASE topic WHEN 6 THEN 2 WHEN 7 THEN 2 ELSE topic END)::INTEGER AS topic, round(sum(w), 9) AS w FROM sp GROUP BY ALL")
def t24(spark, d):
    return T.fuse(sparse(spark, d), {6: 2, 7: 2}).select("doc_id", "topic", F.round("w", 9).alias("w"))


@query("t24_fused_betas", f"WITH {_BETA}, {_TH}, a AS (SELECT topic, sum(w) / (SELECT count(*) FROM embeddings) AS alpha FROM sp GROUP BY topic), m AS (SELECT topic, CASE WHEN topic IN (6, 7) THEN 2 ELSE topic END AS t, alpha FROM a), tt AS (SELECT t, sum(alpha) AS total FROM m GROUP BY t) SELECT t::INTEGER AS topic, term, round(sum(w * alpha) / any_value(total), 9) AS w FROM b JOIN m USING (topic) JOIN tt USING (t) GROUP BY t, term")
def t24b(spark, d):
    return T.fuse_betas(betas(spark, d), alphas(spark, d), {6: 2, 7: 2}).select("topic", "term", F.round("w", 9).alias("w"))


@query("t30_topic_treemap", f"WITH {_TH} SELECT topic, round(100 * sum(w) / (SELECT sum(w) FROM sp), 6) AS pct FROM sp GROUP BY topic")
def t30(spark, d):
    a = alphas(spark, d)
    return a.crossJoin(F.broadcast(a.agg(F.sum("alpha").alias("t")))).select("topic", F.round(100 * F.col("alpha") / F.col("t"), 6).alias("pct"))  # one row


# -- vectors -------------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("v"), "label")


_U = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS v FROM embeddings)"


@query("q21_nearest_documents", f"WITH {_U}, s AS (SELECT q.id AS query, r.id, list_dot_product(q.v, r.v) AS score FROM u q, u r WHERE q.id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s) SELECT query, id, round(score, 6) AS cosine, round((1 + score) / 2, 6) AS score, rank FROM k WHERE rank <= 100")
def q21(spark, d):
    rows = _vectors(spark, d)
    near = block_search(rows.where("id % 100 = 0"), rows, 100, 64)
    return near.select("query", "id", F.round("score", 6).alias("cosine"), F.round((1 + F.col("score")) / 2, 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("q21e_nearest_filtered", f"WITH {_U}, s AS (SELECT q.id AS query, r.id, list_dot_product(q.v, r.v) AS score FROM u q, u r WHERE q.id % 100 = 0 AND r.label = 3), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s) SELECT query, id, round(score, 6) AS cosine, rank FROM k WHERE rank <= 20")
def q21e(spark, d):
    """The filter comes before the top k."""
    rows = _vectors(spark, d)
    return block_search(rows.where("id % 100 = 0"), rows.where("label = 3"), 20, 64).select("query", "id", F.round("score", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("q20_docs_related_to_word", f"WITH {_INT}, {_U}, c AS (SELECT topic, i, sum(sp.w * v[i]) AS x FROM sp JOIN u ON u.id = sp.doc_id, range(1, 65) r(i) GROUP BY ALL), q AS (SELECT i, v[i] AS y FROM u, range(1, 65) r(i) WHERE id = 3), best AS (SELECT topic FROM c JOIN q USING (i) GROUP BY topic ORDER BY round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 12) DESC, topic LIMIT 1) SELECT iw.topic, doc_id, n AS weight FROM iw JOIN best USING (topic) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 100")
def q20(spark, d):
    """The topic whose mean vector is nearest to the word's vector (here that of document 3), and the documents of most weight."""
    s, v = sparse(spark, d), _vectors(spark, d)
    cells = s.join(v.select(F.col("id").alias("doc_id"), "v"), "doc_id").select("topic", "w", F.posexplode("v").alias("i", "x"))
    centres = cells.groupBy("topic", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    word = v.where("id = 3").select(F.posexplode("v").alias("i", "y"))
    score = F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    best = centres.join(F.broadcast(word), "i").groupBy("topic").agg(score.alias("s")).orderBy(F.desc(F.round("s", 12)), "topic").limit(1).select("topic")  # 64 rows
    docs = T.to_integers(s).join(F.broadcast(best), "topic").where("n > 0")  # one row
    return R.page(docs.select("topic", "doc_id", F.col("n").alias("weight")), [F.desc("weight"), F.asc("doc_id")], 0, 100)


@query("v7_mean_pool", "WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL), z AS (SELECT label, list(m ORDER BY i) AS v, count(*) FROM x GROUP BY label) SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = z.label) AS n_chunks, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-12), 6) AS first, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM z")
def v7(spark, d):
    rows = table(spark, d, "embeddings")
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_chunks"), F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return sums.select("label", "n_chunks", F.round(unit(F.col("v"))[0], 6).alias("first"), F.round(size, 6).alias("norm"))


@query("v12_top_per_row", "WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS w FROM embeddings, range(1, 65) r(i)), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, i) AS r FROM x) SELECT vec_id, i, round(w, 6) AS w FROM k WHERE r <= 3")
def v12(spark, d):
    """Sorted inside the row: no shuffle."""
    rows = table(spark, d, "embeddings")
    best = F.slice(F.array_sort(F.transform("embedding", lambda x, i: F.struct((-x.cast("double")).alias("n"), i.cast("long").alias("i")))), 1, 3)
    return rows.select("vec_id", F.inline(best)).select("vec_id", "i", F.round(-F.col("n"), 6).alias("w"))


@query("v4_cosine_scores", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 5")
def v4(spark, d):
    rows = table(spark, d, "embeddings")
    q = rows.where("vec_id = 5").select(F.col("embedding").alias("q"))
    return rows.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))  # one row


# -- retrieval ---------------------------------------------------------------------------------------

_BM = r"""dd AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM documents),
q AS (SELECT unnest(['limpieza', 'residuos', 'plazo']) AS term),
tf AS (SELECT doc_id, len(t) AS n, term, len(list_filter(t, lambda x: x = term)) AS tf FROM dd, q),
st AS (SELECT count(*) AS nd, avg(len(t)) AS av FROM dd), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / av))) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id)"""


def _bm(spark, d):
    return R.bm25(table(spark, d, "documents"), ["limpieza", "residuos", "plazo"], "doc_id")


@query("r3_bm25", f"WITH {_BM} SELECT doc_id, round(score, 6) AS score FROM bm")
def r3(spark, d):
    return _bm(spark, d).select("doc_id", F.round("score", 6).alias("score"))


@query("r6_rank_fusion", f"WITH {_BM}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM (SELECT doc_id, max(score) AS score FROM bm GROUP BY 1)), b AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS r FROM (SELECT doc_id, max(n_chars) AS n FROM documents GROUP BY 1)) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(1.0 / (60 + coalesce(a.r, 1000000)) + 1.0 / (60 + coalesce(b.r, 1000000)), 9) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def r6(spark, d):
    """Two whole rankings fused: by keywords, and by length."""
    a = _bm(spark, d).groupBy("doc_id").agg(F.max(F.round("score", 9)).alias("s"))
    b = table(spark, d, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("s"))
    rank = lambda df, step, name: bucket_rank(materialise(df.withColumn("k", F.floor(-F.col("s") * step)), name), [], "k", [F.desc("s"), F.asc("doc_id")])
    return R.fuse(rank(a, 1000, "keywords"), rank(b, 1, "lengths"), "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("r7_rerank", "SELECT l_orderkey, l_linenumber, round(0.35 * l_discount * 10 + 0.45 * (l_quantity / 50) + 0.10 * greatest(0, 1 - (l_linenumber - 1) / greatest(1, count(*) OVER (PARTITION BY l_orderkey) - 1)) - 0.10 * l_tax * 10, 6) AS score FROM lineitem")
def r7(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    score = R.rerank(F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 10, F.col("l_linenumber") - 1, n)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("r8_minmax", "SELECT l_orderkey, l_linenumber, round(CASE WHEN max(l_quantity) OVER w > min(l_quantity) OVER w THEN (l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w) ELSE 0.5 END, 6) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def r8(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.minmax("l_quantity", ["l_orderkey"]), 6).alias("scaled"))


@query("r9_adaptive_threshold", "WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, round(greatest(max(CASE WHEN i = ceil(0.4 * (n - 1)) THEN l_quantity END), avg(l_quantity) - 0.25 * coalesce(stddev_samp(l_quantity), 0)), 6) AS threshold FROM r GROUP BY l_orderkey")
def r9(spark, d):
    return R.adaptive_threshold(table(spark, d, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", F.round("threshold", 6).alias("threshold"))


@query("v5_token_chunks", r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, (1 + ceil(greatest(len(t) - 256, 0) / 192))::BIGINT)) AS idx FROM w WHERE len(t) > 0) SELECT doc_id, idx::INTEGER AS idx, sha256(doc_id || '|' || idx) AS chunk_id, array_to_string(t[idx * 192 + 1:idx * 192 + 256], ' ') AS text FROM c")
def v5(spark, d):
    return R.chunks(table(spark, d, "documents"), "doc_id", "text")
