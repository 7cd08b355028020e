"""Annotation projects, the catalogue, documents' states, descriptors and models behind callables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.procurement import xml_safe
from acervo.operators import annotation as A
from acervo.operators import chain as C
from acervo.operators import encoders as N
from acervo.operators import retrieval as R
from acervo.plans.catalog import Catalog, Exists, Missing
from acervo.plans.extraction import _NODES, OVERLAP, SIZE, _cells
from acervo.plans.registry import query
from acervo.plans.votes import _PC, _V, compared, named, votes
from acervo.runtime import shared_dir, table
from acervo.sources import sinks


def _folder(spark, name):
    return f"{shared_dir(spark)}/acervo-{name}-{uuid.uuid4().hex}"


# -- annotation -------------------------------------------------------------------------------------------


@query("d10_current_votes", "SELECT annotator, instance_id, selected_model FROM (SELECT annotator, instance_id, selected_model, row_number() OVER (PARTITION BY annotator, instance_id ORDER BY annotated_at DESC NULLS LAST, selected_model DESC NULLS LAST) AS r FROM annotations WHERE annotator IS NOT NULL AND instance_id IS NOT NULL) WHERE r = 1 AND selected_model <> ''")
def d10(spark, d):
    """Votes as they stand, whatever they say; an empty one deletes."""
    return A.current(table(spark, d, "annotations").select("annotator", "instance_id", "annotated_at", "selected_model"), ["annotator", "instance_id"], "annotated_at", "selected_model")


_QUOTA = "q AS (SELECT id, 3 - count(a.annotator) AS quota FROM (SELECT DISTINCT id FROM pair_comparisons) p LEFT JOIN (SELECT DISTINCT instance_id, annotator FROM annotations WHERE annotator IS NOT NULL) a ON a.instance_id = p.id GROUP BY id)"


def quotas(spark, d):
    """(id, quota): how many more annotators a comparison takes, of three."""
    taken = table(spark, d, "annotations").where("annotator IS NOT NULL").select(F.col("instance_id").alias("id"), "annotator").distinct()
    free = table(spark, d, "pair_comparisons").select("id").distinct().withColumn("quota", F.lit(3))
    return A.take_quota(free, taken)


@query("d11_assignment", f"WITH {_QUOTA} SELECT id, 'ann' AS \"user\" FROM q WHERE quota > 0 ORDER BY quota DESC, md5('42|ann|' || id), id LIMIT 50")
def d11(spark, d):
    """Fifty comparisons for an annotator: most room first, then drawn."""
    return A.assign(quotas(spark, d), "ann", 50)


@query("d12_removed_users", f"WITH {_QUOTA}, u AS (SELECT min(annotator) AS u FROM annotations), g AS (SELECT instance_id, count(DISTINCT annotator) AS g FROM annotations WHERE annotator = (SELECT u FROM u) GROUP BY 1), l AS (SELECT count(*) AS votes FROM annotations WHERE annotator <> (SELECT u FROM u)) SELECT q.id, quota + coalesce(g, 0) AS quota, votes FROM q LEFT JOIN g ON g.instance_id = q.id, l")
def d12(spark, d):
    """An annotator taken out: the room they had taken is given back, their votes are gone."""
    rows = table(spark, d, "annotations").select(F.col("instance_id").alias("id"), F.col("annotator").alias("user"), "annotation_id")
    first = rows.agg(F.min("user")).first()[0]
    left, free = A.remove_users(rows, quotas(spark, d), [first])
    return free.crossJoin(F.broadcast(left.agg(F.count(F.lit(1)).alias("votes"))))  # one row


_CONF = "c AS (SELECT DISTINCT doc_id AS id, (doc_id * 7919 % 1000)::DOUBLE / 1000 AS confidence FROM documents)"


@query("d13_interleaved", f"WITH {_CONF}, p AS (SELECT *, ('0x' || substr(md5('42|' || id), 1, 7))::BIGINT % 2 = 0 AS p FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY CASE WHEN p THEN md5('43|' || id) END, CASE WHEN NOT p THEN confidence END, id) AS r, count(*) FILTER (p) OVER () AS np, count(*) FILTER (NOT p) OVER () AS no FROM p) SELECT id, CASE WHEN p THEN r + least(no, r * 1) ELSE r + least(np, r - 1) END AS place FROM r")
def d13(spark, d):
    """The least certain first, every second place drawn."""
    scored = table(spark, d, "documents").select(F.col("doc_id").alias("id"), ((F.col("doc_id") * 7919 % 1000).cast("double") / 1000).alias("confidence")).distinct()
    return A.interleave(scored)


@query("d13_active_learning")
def d13b(spark, d):
    """The same with the confidence of a classifier of languages, fitted on the labelled documents."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", "lang").groupBy("id").agg(F.max("text").alias("text"), F.max("lang").alias("lang"))
    return A.interleave(A.confidence(rows, "text", "lang"))


@query("j9_annotators_with_metadata", f"WITH {_V}, {_PC}, n AS (SELECT min(annotator) AS a, max(annotator) AS b FROM v) SELECT x.instance_id, x.selected_model AS ann1, y.selected_model AS ann2, task, pc.a AS a_model, pc.b AS b_model FROM v x JOIN v y USING (instance_id) LEFT JOIN pc ON pc.id = x.instance_id WHERE x.annotator = (SELECT a FROM n) AND y.annotator = (SELECT b FROM n)")
def j9(spark, d):
    """What two annotators said of the comparisons they share, with the comparison's own columns."""
    said = named(votes(spark, d))
    low, high = said.agg(F.min("annotator"), F.max("annotator")).first()
    one = lambda who, name: said.where(F.col("annotator") == who).select("instance_id", F.col("selected_model").alias(name))
    names = compared(spark, d).select("instance_id", "task", F.col("a").alias("a_model"), F.col("b").alias("b_model"))
    return one(low, "ann1").join(one(high, "ann2"), "instance_id").join(names, "instance_id", "left")


_TIME = "t AS (SELECT DISTINCT annotation_id, annotator, CASE WHEN isfinite(seconds_spent) AND seconds_spent BETWEEN 0 AND 1e7 THEN floor(seconds_spent)::BIGINT END AS s FROM annotations WHERE annotator IS NOT NULL)"


def _times(spark, d):
    """Times as they are written: days, hours, minutes and seconds."""
    s = F.col("seconds_spent")
    whole = F.when(~F.isnan(s) & s.between(0, 1e7), F.floor(s))
    rows = table(spark, d, "annotations").where("annotator IS NOT NULL").select("annotation_id", "annotator", whole.alias("s")).distinct()
    part = lambda of, name: F.concat(of.cast("string"), F.lit(name))
    text = F.concat(F.lit("Time spent: "), F.concat_ws(" ", part(F.floor(F.col("s") / 86400), "d"), part(F.floor(F.col("s") % 86400 / 3600), "h"), part(F.floor(F.col("s") % 3600 / 60), "m"), part(F.col("s") % 60, "s")))
    return rows.select("annotation_id", "annotator", F.when(F.col("s").isNotNull(), text).alias("time"))


@query("f40_parsed_times", f"WITH {_TIME} SELECT annotation_id, s % 86400 AS seconds FROM t WHERE s IS NOT NULL")
def f40(spark, d):
    """Days don't count."""
    return _times(spark, d).where("time IS NOT NULL").select("annotation_id", A.seconds(F.col("time")).alias("seconds"))


@query("a19_working_time", f"WITH {_TIME} SELECT annotator, count(*) AS votes, coalesce(sum(s % 86400), 0)::BIGINT AS seconds, round(avg(s % 86400), 4) AS mean_seconds FROM t GROUP BY annotator")
def a19(spark, d):
    rows = _times(spark, d).withColumn("s", F.when(F.col("time").isNotNull(), A.seconds(F.col("time"))))
    return rows.groupBy("annotator").agg(F.count(F.lit(1)).alias("votes"), F.coalesce(F.sum("s"), F.lit(0)).alias("seconds"), F.round(F.avg("s"), 4).alias("mean_seconds"))


@query("f39_parsed_spans", "SELECT place_id, coalesce(title, '') || ' ' || coalesce(cpv, '') AS text, length(coalesce(title, '')) + 1 AS start, length(coalesce(title, '')) + 1 + length(coalesce(cpv, '')) AS stop FROM (SELECT place_id, max(title) AS title, max(cpv) AS cpv FROM corpus WHERE NOT contains(coalesce(title, ''), '<') GROUP BY 1)")
def f39(spark, d):
    """Titles with their code marked up, and where the mark lies in the plain text."""
    rows = table(spark, d, "corpus").where(~F.contains(F.coalesce("title", F.lit("")), F.lit("<"))).groupBy("place_id").agg(F.max("title").alias("title"), F.max("cpv").alias("cpv"))
    markup = F.concat(F.coalesce("title", F.lit("")), F.lit(' <span schema_label="cpv">'), F.coalesce("cpv", F.lit("")), F.lit("</span>"))
    parsed = rows.select("place_id", A.parse_spans(markup).alias("p"))
    return parsed.select("place_id", "p.text", F.col("p.spans")[0]["start"].cast("long").alias("start"), F.col("p.spans")[0]["stop"].cast("long").alias("stop"))


# -- catalogue ----------------------------------------------------------------------------------------------


def _catalogue(spark, d):
    catalog = Catalog(spark, _folder(spark, "catalog"))
    rows = table(spark, d, "corpus").groupBy("place_id").agg(F.max("title").alias("title"), F.max("generated_objective").alias("objective"))
    catalog.index_corpus("Tenders", rows, {"id": "place_id"}, ("title", "objective"), ("title",))
    return catalog


@query("d1_catalogue_steps", "SELECT * FROM (VALUES ('again', 'refused'), ('corpora', 'tenders'), ('created', 'a,tenders'), ('deleted', ''), ('field', 'true,false'), ('missing', 'refused'), ('models', 'm'), ('models of corpus', 'm')) t(step, result)")
def d1(spark, d):
    """Collections created, listed, refused, changed and deleted; a corpus takes its models with it."""
    catalog, steps = _catalogue(spark, d), {}
    catalog.create("a", table(spark, d, "region"))
    steps["created"] = ",".join(catalog.list())
    try:
        catalog.create("a", table(spark, d, "region"))
    except Exists:
        steps["again"] = "refused"
    catalog.add_field("a", "extra", F.lit(1))
    there = "extra" in catalog.read("a").columns
    catalog.drop_field("a", "extra")
    steps["field"] = f"{there},{'extra' in catalog.read('a').columns}".lower()
    catalog.index_model("m", "tenders", spark.range(3).withColumnRenamed("id", "topic"))
    steps |= {"corpora": ",".join(catalog.list("corpus")), "models": ",".join(catalog.list("model")), "models of corpus": ",".join(catalog.describe("tenders")["models"])}
    catalog.delete("tenders"), catalog.delete("a")
    steps["deleted"] = ",".join(catalog.list())
    try:
        catalog.read("tenders")
    except Missing:
        steps["missing"] = "refused"
    return spark.createDataFrame(list(steps.items()), "step string, result string")


@query("d8_searchable_rebuilt", "SELECT place_id AS id, CASE WHEN lower(trim(o)) NOT IN ('', 'nan', 'none') THEN o ELSE '' END AS searchable FROM (SELECT place_id, coalesce(max(generated_objective), '') AS o FROM corpus WHERE place_id IS NOT NULL GROUP BY 1)")
def d8(spark, d):
    """Another field becomes the searchable one, and its text is built again."""
    catalog = _catalogue(spark, d)
    catalog.set_searchable("tenders", add=("objective",), remove=("title",))
    return catalog.read("tenders").select("id", "searchable")


@query("q2_metadata_fields", "SELECT * FROM (VALUES ('title'), ('objective')) t(field)")
def q2(spark, d):
    """The fields a corpus displays."""
    return spark.createDataFrame([(f,) for f in _catalogue(spark, d).describe("tenders")["displayed"]], "field string")


@query("a16_model_granularities", "SELECT * FROM (VALUES ('33', 8, 50), ('45', 5, 5), ('72', 10, 120)) t(cpv, low, high)")
def a16(spark, d):
    """The fewest and most topics of the models of each code, as numbers, whatever the order of the names."""
    catalog, topics = _catalogue(spark, d), spark.range(1).withColumnRenamed("id", "topic")
    for name in ("0_33_8_topics", "0_33_50_topics", "0_45_5_topics", "0_72_120_topics", "0_72_15_topics", "0_72_10_topics"):
        catalog.index_model(name, "tenders", topics)
    return catalog.granularities("tenders")


# -- documents' states -----------------------------------------------------------------------------------------

#: States of metadata that is still to come.
PENDING = ("PENDIENTE", "PROCESANDO", "ERROR")


@query("d14_pending_filled", "WITH m AS (SELECT id, document_id, CASE WHEN id % 5 = 0 THEN 'PENDIENTE' ELSE metadata_value END AS v FROM (SELECT DISTINCT id, document_id, metadata_key, metadata_value FROM metadatos)), r AS (SELECT id, original_name FROM (SELECT DISTINCT id, max(original_name) AS original_name FROM uploads GROUP BY 1)) SELECT m.id, CASE WHEN v IN ('PENDIENTE', 'PROCESANDO', 'ERROR') AND r.original_name IS NOT NULL THEN r.original_name ELSE v END AS v FROM m LEFT JOIN r ON r.id = document_id")
def d14(spark, d):
    """Values in a state of waiting take the result that has come for their document; others stay."""
    m = table(spark, d, "metadatos").select("id", "document_id", "metadata_key", "metadata_value").distinct()
    waiting = m.withColumn("v", F.when(F.col("id") % 5 == 0, "PENDIENTE").otherwise(F.col("metadata_value")))
    results = table(spark, d, "uploads").groupBy(F.col("id").alias("document_id")).agg(F.max("original_name").alias("result"))
    return sinks.fill_pending(waiting, results, "document_id", "v", "result", PENDING).select("id", "v")


@query("d14_cascade_delete", "WITH n AS (SELECT min(stored_name) AS n FROM uploads), g AS (SELECT id FROM uploads WHERE stored_name = (SELECT n FROM n)) SELECT 'metadatos' AS part, count(*) AS n FROM metadatos WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'uploads', count(*) FROM uploads WHERE stored_name IS NULL OR stored_name <> (SELECT n FROM n)")
def d14b(spark, d):
    """A stored file deleted: its uploads and the metadata of all of them."""
    uploads, metadata = table(spark, d, "uploads"), table(spark, d, "metadatos")
    first = uploads.agg(F.min("stored_name").alias("stored_name"))
    left, kept = sinks.cascade(uploads, metadata, first, "stored_name", "id", "document_id")
    return kept.agg(F.lit("metadatos").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(left.agg(F.lit("uploads").alias("part"), F.count(F.lit(1)).alias("n")))


# -- descriptors and preprocessing --------------------------------------------------------------------------------


@dataclass
class LogicalCorpus:
    """Which columns of which table play which role."""

    name: str
    table: str
    id: str
    text: list[str]
    lemmas: str | None = None
    embeddings: str | None = None
    description: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> LogicalCorpus:
        return cls(**json.loads(text))


@dataclass
class Training:
    """What a model was trained on and how."""

    corpus: str
    topics: int
    iterations: int = 1000
    alpha: float = 5.0
    interval: int = 10
    steps: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Training:
        return cls(**json.loads(text))


#: Steps of preprocessing by name; more can be added.
STEPS: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "xml": xml_safe,
    "squeeze": lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")),
    "letters": lambda c: F.regexp_replace(c, r"[^\p{L}\s]+", ""),
}


def prepare(df, text: str, steps: list[str], out: str):
    """The steps applied in order; an unknown one is an error."""
    c = F.col(text)
    for step in steps:
        c = STEPS[step](c)
    return df.withColumn(out, c)


@query("d15_descriptors", "SELECT * FROM (VALUES ('corpus', 'tenders'), ('steps', 'lower,letters,squeeze'), ('text', 'title,lemmas'), ('topics', '20')) t(name, value)")
def d15(spark, d):
    """A corpus and a training written as JSON and read again."""
    corpus = LogicalCorpus.from_json(LogicalCorpus("tenders", "corpus", "place_id", ["title", "lemmas"]).to_json())
    training = Training.from_json(Training(corpus.name, 20, steps=["lower", "letters", "squeeze"]).to_json())
    rows = [("corpus", training.corpus), ("text", ",".join(corpus.text)), ("topics", str(training.topics)), ("steps", ",".join(training.steps))]
    return spark.createDataFrame(rows, "name string, value string")


@query("d15_prepared_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\s]+', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def d15b(spark, d):
    return prepare(table(spark, d, "documents").select("doc_id", "text"), "text", ["lower", "letters", "squeeze"], "text")


# -- models behind callables ------------------------------------------------------------------------------------------


@query("m1_memoised_answers", "SELECT place_id, title, CASE WHEN title IS NOT NULL THEN length(title)::VARCHAR || ':' || upper(left(title, 5)) END AS answer FROM corpus")
def m1(spark, d):
    """Equal prompts are asked once, and not again in a second run over the same table of answers."""
    rows, answers = table(spark, d, "corpus").select("place_id", "title"), _folder(spark, "answers")
    N.complete(rows.where("title < 'm'"), "title", lambda prompts: [f"{len(p)}:{p[:5].upper()}" for p in prompts], answers)
    return N.complete(rows, "title", lambda prompts: [f"{len(p)}:{p[:5].upper()}" for p in prompts], answers)


@query("m2_translated_texts", "SELECT DISTINCT place_id, raw_text, CASE WHEN raw_text IS NOT NULL THEN length(replace(upper(raw_text), ' ', '')) + (length(raw_text) > 1536)::INT END AS n FROM pliegos")
def m2(spark, d):
    """Texts through a translator that writes capitals; one of several pieces gets a full stop at its end."""
    rows = table(spark, d, "pliegos").select("place_id", "raw_text").distinct()
    keyed = rows.withColumn("k", F.xxhash64("place_id", "raw_text"))
    out = N.translate(keyed, "k", "raw_text", lambda texts: [t.upper() for t in texts])
    return out.select("place_id", "raw_text", F.length(F.replace("translated", F.lit(" "), F.lit(""))).alias("n"))


@query("m3_named_classifier")
def m3(spark, d):
    """A pipeline of vectoriser and classifier named by their classes, fitted on labelled documents: predictions."""
    rows = table(spark, d, "documents").where("text IS NOT NULL AND lang IN ('es', 'ca', 'en')").select(F.col("doc_id").alias("id"), "text", "lang")
    model = A.pipeline("pyspark.ml.feature.HashingTF", "pyspark.ml.classification.NaiveBayes", "text", "lang", {"numFeatures": 4096}).fit(rows)
    return model.transform(rows).select("id", "lang", F.col("predicted").alias("label"))


@query("f38_lemmas", r"SELECT place_id, CASE WHEN title IS NOT NULL THEN array_to_string(list_transform(list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}_]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '(es|s)$', '')), ' ') END AS lemmas FROM (SELECT DISTINCT place_id, title FROM corpus)")
def f38(spark, d):
    """Lemmas by a callable, here without the plural's ending."""
    import re

    def lemmas(texts):
        return [" ".join(re.sub(r"(es|s)\Z", "", w) for w in re.split(r"[^\w]+", t.lower()) if w) for t in texts]

    return N.complete(table(spark, d, "corpus").select("place_id", "title").distinct(), "title", lemmas, out="lemmas").select("place_id", "lemmas")


_ASK = "criterios de adjudicación y solvencia, condiciones especiales de ejecución"
_R13 = _NODES.replace(f"- {SIZE}, 0", "- 256, 0").replace(f"/ {SIZE - OVERLAP}", "/ 224").replace(f"* {SIZE - OVERLAP} + {SIZE}]", "* 224 + 256]").replace(f"* {SIZE - OVERLAP} + 1", "* 224 + 1")


@query("r13_answered_from_context", f"WITH {_R13}, ql AS (SELECT 0 AS query, '{_ASK}' AS text), {_cells('qc', 'ql', 'query')}, {_cells('nc', 'nodes', 'doc_id, idx')}, ds AS (SELECT doc_id, idx, sum(nc.x * qc.x) AS score FROM nc JOIN qc USING (i) GROUP BY ALL), r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS rank FROM ds JOIN nodes USING (doc_id, idx)), g AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS t FROM r WHERE rank <= 12 GROUP BY 1) SELECT doc_id, array_to_string(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')[1:20], ' ') AS answer FROM g")
def r13(spark, d):
    """A fixed question asked of every document's best twelve chunks; the model is a callable, here it gives
    the first words of its context."""
    nodes = R.chunks(table(spark, d, "documents"), "doc_id", "text", 256, 32).select("doc_id", "idx", "text")
    hits = C.ranked(C.dense(nodes, [_ASK]), ["doc_id"]).where("rank <= 12")
    joined = hits.join(nodes, ["doc_id", "idx"]).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"]), "\n\n").alias("context"))
    return N.complete(joined, "context", lambda prompts: [" ".join(p.split()[:20]) for p in prompts]).select("doc_id", "answer")


# -- joins with hits and files ---------------------------------------------------------------------------------------------


@query("j6_chunk_files", "WITH m AS (SELECT place_id, max(cpv) AS cpv FROM corpus GROUP BY 1) SELECT p.place_id, cpv, p.raw_text IS NOT NULL AS has_text FROM m JOIN (SELECT DISTINCT place_id, raw_text FROM pliegos) p USING (place_id)")
def j6(spark, d):
    """Metadata joined once with all files of a chunked table."""
    out = _folder(spark, "chunks")
    sinks.write_parquet(table(spark, d, "pliegos").select("place_id", "raw_text").distinct(), out, rows_per_file=400)
    metadata = table(spark, d, "corpus").groupBy("place_id").agg(F.max("cpv").alias("cpv"))
    return metadata.join(spark.read.parquet(out), "place_id").select("place_id", "cpv", F.col("raw_text").isNotNull().alias("has_text"))


@query("j8_hits_in_order", "WITH h AS (SELECT place_id, row_number() OVER (ORDER BY md5('1|' || place_id)) AS rank FROM (SELECT DISTINCT place_id FROM corpus) ORDER BY rank LIMIT 50) SELECT rank, h.place_id, title FROM h JOIN (SELECT place_id, max(title) AS title FROM corpus GROUP BY 1) USING (place_id)")
def j8(spark, d):
    """Fifty hits with their documents' columns, in the order of the hits."""
    hits = table(spark, d, "corpus").select("place_id").distinct().orderBy(A.drawn(1, "place_id")).limit(50)
    from pyspark.sql import Window

    numbered = hits.withColumn("rank", F.row_number().over(Window.orderBy(A.drawn(1, "place_id"))).cast("long"))  # a page of hits
    titles = table(spark, d, "corpus").groupBy("place_id").agg(F.max("title").alias("title"))
    return titles.join(F.broadcast(numbered), "place_id").select("rank", "place_id", "title").orderBy("rank")
