"""Queries of the extraction of objectives: encoders, the retrieval chain, snippets, layout and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions import objective as O
from acervo.functions import procurement as P
from acervo.operators import chain as C
from acervo.operators import encoders as N
from acervo.operators import evaluation as E
from acervo.operators import retrieval as R
from acervo.operators.search import block_search
from acervo.plans.registry import query
from acervo.runtime import materialise, table

SIZE, OVERLAP = 64, 16
_NODES = rf"""w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(0, (1 + ceil(greatest(len(t) - {SIZE}, 0) / {SIZE - OVERLAP}))::BIGINT)) AS idx FROM w WHERE len(t) > 0),
nodes AS (SELECT doc_id, idx::INTEGER AS idx, array_to_string(t[idx * {SIZE - OVERLAP} + 1:idx * {SIZE - OVERLAP} + {SIZE}], ' ') AS text FROM c),
sizes AS (SELECT doc_id, count(*) AS n FROM nodes GROUP BY 1)"""
_TOKENS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')".format


def _cells(name: str, source: str, keys: str, text: str = "text") -> str:
    """CTEs of the hashed unit vectors of a table's texts."""
    return f"""{name}_t AS (SELECT {keys}, md5(unnest({_TOKENS(text)})) AS d FROM {source}),
{name}_c AS (SELECT {keys}, ('0x' || substr(d, 1, 7))::BIGINT % 64 AS i, sum(CASE WHEN substr(d, 8, 1) >= '8' THEN -1 ELSE 1 END)::DOUBLE AS x FROM {name}_t GROUP BY ALL HAVING sum(CASE WHEN substr(d, 8, 1) >= '8' THEN -1 ELSE 1 END) <> 0),
{name} AS (SELECT * REPLACE (x / sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS x) FROM {name}_c)"""


_LIST = ", ".join(f"({i}, '{q}')" for i, q in enumerate(C.QUERIES))
_DENSE = f"""{_NODES}, ql AS (SELECT * FROM (VALUES {_LIST}) q(query, text)), {_cells("qc", "ql", "query")}, {_cells("nc", "nodes", "doc_id, idx")},
ds AS (SELECT doc_id, idx, query, sum(nc.x * qc.x) AS score FROM nc JOIN qc USING (i) GROUP BY ALL),
dh AS (SELECT doc_id, idx, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, query ORDER BY round(score, 9) DESC, idx) AS r FROM ds WHERE round(score, 9) > 0) JOIN sizes USING (doc_id) WHERE r <= greatest(3, least(6, least(n, 9))) GROUP BY ALL)"""
_B = r"[^\p{L}\p{N}_]"
_ANY = "|".join(O.HEADS + O.VERBS).replace("'", "''")
_BAD = "|".join(O.NOISE)
_ANCHORED = f"regexp_matches(@@, '(?i)(^|{_B})({_ANY})({_B}|$)')"
_BADHIT = f"regexp_matches(@@, '(?i)(^|{_B})({_BAD})({_B}|$)')"
# a noisy word is counted with what stands around it; separators are doubled so that two in a row count as two
_BADS = rf"len(regexp_extract_all(regexp_replace(@@, '([^\p{{L}}\p{{N}}_.]+)', '\1 \1', 'g'), '(?i)(^|{_B})({_BAD})({_B}|$)'))"
_FLOW = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(@@, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), '\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _found(text: str) -> str:
    one = [rf"trim(regexp_replace(regexp_extract({text}, '(?i)(?:{a.replace(chr(39), chr(39) * 2)})[ \t]*[:\-]?[ \t]*([^\n.;]+)', 1), '\s+', ' ', 'g'))" for a in O.ANCHORS]
    return "coalesce(" + ", ".join(f"CASE WHEN length({x}) BETWEEN 15 AND 350 THEN {x} END" for x in one) + ")"


def _noise(text: str) -> str:
    words = rf"greatest(1, len(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+')))"
    return f"CASE WHEN length({text}) > 0 THEN least(1.0, {_BADS.replace("@@", text)} / greatest(8.0, {words} / 30.0)) ELSE 1.0 END"


def _purpose(text: str) -> str:
    return f"greatest(0.0, coalesce({_ANCHORED.replace("@@", text)}, false)::INT - 0.5 * coalesce({_BADHIT.replace("@@", text)}, false)::INT)"


def nodes(spark, d):
    """Chunks of the documents: windows of SIZE tokens."""
    return R.chunks(table(spark, d, "documents"), "doc_id", "text", SIZE, OVERLAP).select("doc_id", "idx", "text")


def sizes(chunked):
    return chunked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# -- encoders -----------------------------------------------------------------------------------------


@query("v6_chunk_vectors", f"WITH {_NODES}, {_cells('nc', 'nodes', 'doc_id, idx')} SELECT doc_id, idx, i::BIGINT AS i, round(x, 6) AS x FROM nc")
def v6(spark, d):
    """Chunks through the encoder as an injected callable (the default one), cells that aren't 0."""
    vectors = N.encode(nodes(spark, d), "text")
    return vectors.select("doc_id", "idx", F.posexplode("embedding").alias("i", "x")).where("x <> 0").select("doc_id", "idx", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("v10_column_vectors", f"WITH p AS (SELECT DISTINCT place_id, title FROM corpus WHERE title IS NOT NULL), {_cells('pc', 'p', 'place_id, title', 'title')}, g AS (SELECT place_id, title, list(round(x, 4) ORDER BY i) AS xs FROM pc GROUP BY ALL) SELECT place_id, title, len(xs) AS cells, round(list_sum(xs), 3) AS total FROM p LEFT JOIN g USING (place_id, title)")
def v10(spark, d):
    """A text column encoded, of each vector the number of cells and their sum."""
    rows = N.encode(table(spark, d, "corpus").select("place_id", "title").where("title IS NOT NULL").distinct(), "title", unit=False)
    cells = F.filter("embedding", lambda x: x != 0)
    some = F.size(cells) > 0
    return rows.select("place_id", "title", F.when(some, F.size(cells)).cast("long").alias("cells"), F.when(some, F.round(F.aggregate(F.transform(cells, lambda x: F.round(x, 4)), F.lit(0.0), lambda s, x: s + x), 3)).alias("total"))


@query("v13_dispatched_vectors", f"WITH wv AS (SELECT vec_id, embedding[1:4]::DOUBLE[] AS v FROM embeddings), t AS (SELECT id, unnest({_TOKENS('text')}) AS word FROM (SELECT doc_id AS id, left(text, 60) AS text FROM documents)), h AS (SELECT word, 'x' AS x FROM (SELECT DISTINCT word FROM t)), k AS (SELECT word, ('0x' || substr(md5(word), 1, 7))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM h), m AS (SELECT t.id, i, avg(v[i]) AS x FROM t JOIN k USING (word) JOIN wv USING (vec_id), range(1, 5) r(i) GROUP BY ALL) SELECT id, i - 1 AS i, round(x, 6) AS x FROM m")
def v13(spark, d):
    """Vectors of texts by their words: a word has one of the vectors (by digest), several have the mean."""
    short = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("text"))
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    words = short.select(F.explode(R.tokens(F.col("text"))).alias("word")).distinct().crossJoin(F.broadcast(n))  # one row
    keyed = words.select("word", (F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 7), 16, 10).cast("long") % F.col("n")).alias("vec_id"))
    vectors = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("v"))
    out = N.embed(short, "text", keyed.join(vectors, "vec_id").select("word", "v"), "id")
    return out.select("id", F.posexplode("embedding").alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_DOCS = f"dd AS (SELECT doc_id, max(text) AS text FROM documents GROUP BY 1), {_cells('dc', 'dd', 'doc_id')}"


@query("q21e_keyword_filtered", f"WITH {_DOCS}, kw AS (SELECT doc_id FROM dd WHERE list_has_any({_TOKENS('text')}, ['limpieza', 'residuos'])), s AS (SELECT q.doc_id AS query, r.doc_id AS id, sum(q.x * r.x) AS score FROM dc q JOIN dc r ON q.i = r.i JOIN kw ON kw.doc_id = r.doc_id WHERE q.doc_id % 100 = 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s) SELECT query, id, round(score, 6) AS cosine, rank FROM k WHERE rank <= 20")
def q21e(spark, d):
    """The nearest documents of those that hold a keyword: the filter comes before the top k."""
    docs = table(spark, d, "documents").groupBy("doc_id").agg(F.max("text").alias("text")).where("text IS NOT NULL")
    vectors = materialise(N.encode(docs, "text").select(F.col("doc_id").cast("long").alias("id"), "text", F.col("embedding").alias("v")).where(F.exists("v", lambda x: x != 0)), "vectors")
    held = vectors.where(R.keyword(F.col("text"), "limpieza residuos"))
    near = block_search(vectors.where("id % 100 = 0").select("id", "v"), held.select("id", "v"), 20, N.DIM)
    return near.select("query", "id", F.round("score", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


# -- retrieval ------------------------------------------------------------------------------------------


@query("r1_query_by_example", f"WITH {_NODES}, ex AS (SELECT doc_id, left(text, 250) AS text FROM documents), {_cells('ec', 'ex', 'doc_id')}, {_cells('nc', 'nodes', 'doc_id, idx')}, s AS (SELECT nc.doc_id, idx, sum(nc.x * ec.x) AS score FROM nc JOIN ec ON nc.doc_id = ec.doc_id AND nc.i = ec.i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS rank FROM s) SELECT doc_id, idx, round(score, 6) AS score, rank FROM r WHERE rank <= 8")
def r1(spark, d):
    """The chunks of a document nearest to its first 250 characters."""
    found = C.by_example(nodes(spark, d), table(spark, d, "documents").select("doc_id", "text"))
    return C.ranked(found, ["doc_id"]).where("rank <= 8").select("doc_id", "idx", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r2_multi_query", f"WITH {_DENSE} SELECT doc_id, idx, round(score, 6) AS score FROM dh")
def r2(spark, d):
    n = nodes(spark, d)
    return C.fuse_queries(C.dense(n), sizes(n)).select("doc_id", "idx", F.round("score", 6).alias("score"))


_KW = ", ".join(f"'{w}'" for w in C.KEYWORDS)
_BM = f"""bw AS (SELECT doc_id, idx, text, list_filter(string_split_regex(regexp_replace(lower(text), '[:.,"()\\n\\-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM nodes),
bs AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS av FROM bw WHERE len(w) > 0 GROUP BY 1), bt AS (SELECT doc_id, idx, len, t, count(*) AS tf FROM (SELECT doc_id, idx, len(w) AS len, unnest(w) AS t FROM bw) WHERE t IN ({_KW}) GROUP BY ALL),
bd AS (SELECT doc_id, t, count(*) AS df FROM bt GROUP BY ALL), bm AS (SELECT doc_id, idx, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))) AS score FROM bt JOIN bd USING (doc_id, t) JOIN bs USING (doc_id) GROUP BY ALL),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS r FROM bm) WHERE r <= 5),
kh AS (SELECT doc_id, idx, CASE WHEN regexp_matches(text, '{O.TOC}') OR regexp_matches(text, '{O.MACHINERY}') OR regexp_matches(text, '{O.LEADER}') THEN 0.6 * score ELSE score END AS score FROM bk JOIN nodes USING (doc_id, idx))"""


@query("r5_keyword_hits", f"WITH {_NODES}, {_BM} SELECT doc_id, idx, round(score, 6) AS score FROM kh")
def r5(spark, d):
    """BM25 within each document, at most five hits, noisy chunks at 0.6."""
    return C.keyword_hits(nodes(spark, d)).select("doc_id", "idx", F.round("score", 6).alias("score"))


_GATE = f"""fd AS (SELECT doc_id, bool_or({_found(_FLOW.replace("@@", 'text'))} IS NOT NULL) AS found FROM documents GROUP BY 1),
gt AS (SELECT sizes.doc_id, n, coalesce(m, 0) AS top_dense, coalesce(found, false) AS found, NOT coalesce(found, false) AND (round(coalesce(m, 0), 9) < 0.35 OR n > 120) AS keywords FROM sizes LEFT JOIN (SELECT doc_id, max(score) AS m FROM dh GROUP BY 1) USING (doc_id) LEFT JOIN fd USING (doc_id))"""


def _gates(spark, d, n, hits):
    anchored = table(spark, d, "documents").groupBy("doc_id").agg(F.max(O.snippet(F.col("text")).isNotNull()).alias("found"))
    return C.gate(sizes(n), hits, anchored)


@query("r4_keyword_gate", f"WITH {_DENSE}, {_GATE} SELECT doc_id, n, round(top_dense, 6) AS top_dense, found, keywords FROM gt")
def r4(spark, d):
    n = nodes(spark, d)
    return _gates(spark, d, n, C.fuse_queries(C.dense(n), sizes(n))).withColumn("top_dense", F.round("top_dense", 6))


_POOL = f"""a AS (SELECT doc_id, idx, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS dr FROM dh),
b AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS kr FROM kh SEMI JOIN (SELECT doc_id FROM gt WHERE keywords) USING (doc_id)),
fu AS (SELECT doc_id, idx, score, dr, kr, bool_or(kr IS NOT NULL) OVER (PARTITION BY doc_id) AS k FROM a FULL JOIN b USING (doc_id, idx)),
fs AS (SELECT doc_id, idx, dr, kr, k, CASE WHEN k THEN 1.0 / (60 + coalesce(kr, 1000000)) + 1.0 / (60 + coalesce(dr, 1000000)) ELSE score END AS score FROM fu),
pl AS (SELECT fs.*, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS r FROM fs) fs JOIN sizes USING (doc_id) WHERE NOT k OR r <= 3 * least(n, 9)),
rr AS (SELECT doc_id, idx, kr, score AS base, text, 0.35 * score + 0.45 * {_purpose('text')} + 0.10 * greatest(0.0, 1 - idx / greatest(1, n - 1)) - 0.10 * ({_noise('text')}) AS score FROM pl JOIN nodes USING (doc_id, idx))"""


def _chain(spark, d):
    n = nodes(spark, d)
    hits = C.fuse_queries(C.dense(n), sizes(n))
    gates = _gates(spark, d, n, hits)
    pooled = C.pool(hits, C.keyword_hits(n), gates)
    return n, hits, gates, pooled, C.rerank(pooled, n)


@query("r7_reranked_pool", f"WITH {_DENSE}, {_GATE}, {_BM}, {_POOL} SELECT doc_id, idx, round(base, 6) AS base, round(score, 6) AS score FROM rr")
def r7b(spark, d):
    return _chain(spark, d)[4].select("doc_id", "idx", F.round("base", 6).alias("base"), F.round("score", 6).alias("score"))


_FIRST = "(SELECT doc_id, idx FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS r FROM {}) WHERE r = 1)".format


@query("r11_provenance", f"WITH {_DENSE}, {_GATE}, {_BM}, {_POOL}, t AS (SELECT gt.doc_id, keywords, x.idx AS top_before, y.idx AS top_after, z.idx AS td, kr FROM gt LEFT JOIN {_FIRST('pl')} x USING (doc_id) LEFT JOIN {_FIRST('rr')} y USING (doc_id) LEFT JOIN {_FIRST('dh')} z USING (doc_id) LEFT JOIN rr ON rr.doc_id = gt.doc_id AND rr.idx = y.idx) SELECT doc_id, keywords, top_before, top_after, CASE WHEN top_after IS NULL THEN 'none' WHEN kr IS NOT NULL THEN 'bm25' ELSE 'dense' END AS top1_source, coalesce(top_before <> top_after, false) AS rerank_changed, coalesce(kr IS NOT NULL AND td IS NOT NULL AND top_after <> td, false) AS keywords_changed FROM t")
def r11(spark, d):
    n, hits, gates, pooled, scored = _chain(spark, d)
    return C.provenance(pooled, scored, hits, gates)


@query("r12_windowed_pool", f"WITH {_DENSE}, {_GATE}, {_BM}, {_POOL}, an AS {_FIRST('(SELECT * FROM rr WHERE ' + _ANCHORED.replace("@@", 'text') + ')')}, ev AS (SELECT doc_id, idx, score, false AS required FROM rr UNION ALL SELECT nodes.doc_id, nodes.idx, 0.25, abs(nodes.idx - an.idx) <= 1 FROM nodes JOIN an ON nodes.doc_id = an.doc_id AND abs(nodes.idx - an.idx) <= 2) SELECT doc_id, idx, round(max(score), 6) AS score, bool_or(required) AS required FROM ev GROUP BY ALL")
def r12(spark, d):
    n, _, _, _, scored = _chain(spark, d)
    return C.windows(scored, n).withColumn("score", F.round("score", 6))


@query("r10_contexts")
def r10(spark, d):
    """The context of every document: a choice in turns, tested by hand-worked cases."""
    n, _, _, _, scored = _chain(spark, d)
    return C.contexts(C.windows(scored, n), n)


# -- snippets, noise and layout ----------------------------------------------------------------------------


def _texts(spark, d):
    return table(spark, d, "pliegos").where("raw_text IS NOT NULL").select("place_id", "raw_text").distinct()


_PL = "p AS (SELECT DISTINCT place_id, raw_text FROM pliegos WHERE raw_text IS NOT NULL)"


@query("f17_anchors", f"WITH {_PL} SELECT place_id, {_ANCHORED.replace("@@", 'raw_text')} AS found FROM p")
def f17(spark, d):
    return _texts(spark, d).select("place_id", O.has_anchor(F.col("raw_text")).alias("found"))


@query("f18_objective_snippets", f"WITH {_PL} SELECT place_id, {_found(_FLOW.replace("@@", 'raw_text'))} AS objective FROM p")
def f18(spark, d):
    return _texts(spark, d).select("place_id", O.snippet(F.col("raw_text")).alias("objective"))


@query("f19_noise_and_purpose", f"WITH {_PL} SELECT place_id, round({_noise('raw_text')}, 6) AS noise, {_purpose('raw_text')}::DOUBLE AS purpose FROM p")
def f19(spark, d):
    return _texts(spark, d).select("place_id", F.round(O.noise(F.col("raw_text")), 6).alias("noise"), O.purpose(F.col("raw_text")).alias("purpose"))


def _kept(x: str) -> str:
    line = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return f"({line} <> '' AND NOT regexp_matches({line}, '{O.PAGE}') AND NOT regexp_matches({line}, '{O.TOC}') AND ({_ANCHORED.replace("@@", line)} OR NOT ((regexp_matches({line}, '{O.LEADER}') AND length({line}) < 200) OR regexp_matches({line}, '{O.MACHINERY}') OR (regexp_matches({line}, '{O.HEADER}') AND length({line}) <= 80))))"


@query("f21_stripped_layout", rf"SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: {_kept('x')}), chr(10)), '\.{{4,}}', '…', 'g') AS text FROM documents")
def f21(spark, d):
    return table(spark, d, "documents").select("doc_id", O.strip_layout(F.col("text")).alias("text"))


_W = r"CASE WHEN regexp_extract(h, '(?s)^(.*[.!?]\s+)', 1) <> '' THEN regexp_extract(h, '(?s)^(.*[.!?]\s+)', 1) ELSE regexp_extract(h, '(?s)^(.*?\n\n)', 1) END"


@query("f23_clipped", rf"WITH h AS (SELECT doc_id, text, left(text, 300) AS h FROM documents), w AS (SELECT *, {_W} AS w FROM h) SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN length(w) > 180 THEN regexp_replace(w, '^\s+|\s+$', '', 'g') ELSE regexp_replace(h, '^\s+|\s+$', '', 'g') END AS clipped FROM w")
def f23(spark, d):
    return table(spark, d, "documents").select("doc_id", O.clip(F.col("text"), 300).alias("clipped"))


@query("f22_normalised_layout", r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13), ''), '[•·▪]', '', 'g'), '[ \t]+', ' ', 'g') AS text FROM documents")
def f22(spark, d):
    return table(spark, d, "documents").select("doc_id", P.normalise_layout(F.col("text")).alias("text"))


@query("f25_pieces", "SELECT doc_id, len(range(0, length(text), 500)) AS pieces, length(text[1 + 500 * (len(range(0, length(text), 500)) - 1):]) AS last FROM documents WHERE length(text) > 0")
def f25(spark, d):
    p = O.pieces(F.col("text"), 500)
    rows = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", p.alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("pieces"), F.length(F.element_at("p", -1)).cast("long").alias("last"))


@query("f25_sentence_pieces", "WITH RECURSIVE s AS (SELECT doc_id, string_split(text, '. ') AS l FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE length(text) > 400), st AS (SELECT doc_id, l, 1 AS i, l[1] || '. ' AS now, 0 AS done FROM s UNION ALL SELECT doc_id, l, i + 1, CASE WHEN length(now) + length(l[i + 1]) + 2 < 400 THEN now || l[i + 1] || '. ' ELSE l[i + 1] || '. ' END, CASE WHEN length(now) + length(l[i + 1]) + 2 < 400 THEN done ELSE done + 1 END FROM st WHERE i < len(l)) SELECT doc_id, (done + 1)::BIGINT AS pieces, trim(now) AS last FROM st WHERE i = len(l)")
def f25b(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").distinct().where(F.length("text") > 400).select("doc_id", O.sentence_pieces(F.col("text"), 400).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("pieces"), F.element_at("p", -1).alias("last"))


_LEG = r"(length({0}) >= 20 AND len(regexp_extract_all({0}, '[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ\s]')) / greatest(length({0}), 1) >= 0.5)".format


@query("f28_extracted_text", rf"WITH {_PL.replace('WHERE raw_text IS NOT NULL', '')}, t AS (SELECT place_id, raw_text, regexp_replace(raw_text, '^\s+|\s+$', '', 'g') AS t FROM p) SELECT place_id, CASE WHEN raw_text IS NULL THEN '{O.UNOPENED}' WHEN {' OR '.join(f'contains(t, {chr(39)}{x}{chr(39)})' for x in O.NOT_THE_DOCUMENT)} THEN '{O.FILTERED}' WHEN NOT {_LEG('t')} THEN '{O.ILLEGIBLE}' ELSE trim(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9áéíóúÁÉÍÓÚñÑ.,;()\[\]\s]', '', 'g'), '\s+', ' ', 'g')) END AS text FROM t")
def f28(spark, d):
    return table(spark, d, "pliegos").select("place_id", "raw_text").distinct().select("place_id", O.extracted(F.col("raw_text")).alias("text"))


@query("f29_plain_strings", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[^\x00-\x7fáéíóúÁÉÍÓÚñÑüÜ¿¡]', '', 'g'), '[¡!#\\/{}&^_-]', ' ', 'g'), '\.{2,}', '.', 'g'), '(?:\s*\.\s*)+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def f29(spark, d):
    return table(spark, d, "documents").select("doc_id", O.plain_string(F.col("text")).alias("text"))


@query("f32_refused_answers", rf"SELECT DISTINCT place_id, CASE WHEN generated_objective IS NULL OR starts_with(generated_objective, '<think>') OR {' OR '.join(f'contains(lower(generated_objective), {chr(39)}{x}{chr(39)})' for x in O.REFUSALS)} THEN '/' ELSE regexp_replace(generated_objective, '^\s+|\s+$', '', 'g') END AS objective FROM corpus")
def f32(spark, d):
    return table(spark, d, "corpus").select("place_id", O.refused(F.col("generated_objective")).alias("objective")).distinct()


@query("f35_top_label", "WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE))) AS p FROM embeddings) SELECT vec_id, list_position(p, list_max(p)) - 1 AS label, round(list_max(p), 6) AS score, list_max(p) >= 0.9 AS sure FROM x")
def f35(spark, d):
    p = F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double"))))
    labels = F.sequence(F.lit(0), F.lit(63))
    return table(spark, d, "embeddings").select("vec_id", O.top_label(labels, p, 0.9).alias("t")).select("vec_id", F.col("t.label").cast("int").alias("label"), F.round("t.score", 6).alias("score"), "t.sure")


@query("e17_extracted_against_reference", f"WITH {_PL}, o AS (SELECT place_id, {_found(_FLOW.replace("@@", 'raw_text'))} AS a FROM p), r AS (SELECT place_id, max(title) AS b FROM corpus GROUP BY 1), s AS (SELECT place_id, a, list_distinct(list_filter({_TOKENS('a')}, lambda x: x NOT IN ('objeto', 'contrato', 'contratación', 'objetivo', 'pliego', 'licitación'))) AS x, list_distinct(list_filter({_TOKENS('b')}, lambda x: x NOT IN ('objeto', 'contrato', 'contratación', 'objetivo', 'pliego', 'licitación'))) AS y FROM o JOIN r USING (place_id)), m AS (SELECT place_id, a, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(x) END AS p, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(y) END AS r FROM s) SELECT place_id, a AS objective, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m")
def e17(spark, d):
    """The extractor applied to every text and measured against the tender's title."""
    titles = table(spark, d, "corpus").groupBy("place_id").agg(F.max("title").alias("b"))
    rows = _texts(spark, d).select("place_id", O.snippet(F.col("raw_text")).alias("objective")).join(titles, "place_id")
    p, r, f1 = E.overlap(E.content(F.col("objective")), E.content(F.col("b")))
    return rows.select("place_id", "objective", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1, 6).alias("f1"))
