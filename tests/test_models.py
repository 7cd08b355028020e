import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.operators import annotation as A
from acervo.operators import models as M


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    words = [[f"{t}{i}" for i in range(8)] for t in "ab"]
    return spark.createDataFrame([(d, [str(w) for w in rng.choice(words[d % 2], 30)]) for d in range(60)], "doc_id int, tokens array<string>").cache()


def test_topics_separate(spark, docs):
    counter, model = M.train_lda(docs, 2, iterations=15)
    weights = {}
    for r in M.infer(docs, counter, model).collect():
        weights.setdefault(r["doc_id"], {})[r["topic"]] = r["w"]
    assert all(sum(w.values()) == pytest.approx(1) for w in weights.values())
    best = [max(weights[d], key=weights[d].get) for d in range(60)]
    assert len({*best[::2]}) == len({*best[1::2]}) == 1 and best[0] != best[1]
    top = M.topic_terms(counter, model, 5)
    tokens = docs.select("doc_id", F.explode("tokens").alias("term"))
    scores = [r["coherence"] for r in M.coherence(tokens, top).collect()]
    assert len(scores) == 2 and min(scores) > 0
    mixed = spark.createDataFrame([(0, 1, "a0"), (0, 2, "b0")], "topic int, rank int, term string")
    assert M.coherence(tokens, mixed).first()["coherence"] < 0
    assert M.coherence(tokens, mixed, "u_mass").first()["coherence"] < 0


def test_sentence_vectors(spark, docs):
    v = M.word_vectors(docs, size=4, min_count=1)
    plain = {r["word"]: np.array(r["v"]) for r in v.collect()}
    extra = docs.select("doc_id", "tokens").limit(3).unionByName(spark.createDataFrame([(-1, ["zzz"])], "doc_id int, tokens array<string>"))
    tokens = {r["doc_id"]: r["tokens"] for r in extra.collect()}
    for r in M.sentence_vectors(extra, v, 4).collect():
        known = [plain[w] for w in tokens[r["doc_id"]] if w in plain]
        assert np.allclose(r["v"], np.mean(known, axis=0) if known else np.zeros(4))


def test_coordinates(spark):
    sim = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 2, 0.1)], "i int, j int, similarity double")
    p = {r["topic"]: np.array([r["x"], r["y"]]) for r in M.coordinates(sim, 3).collect()}
    assert np.linalg.norm(p[0] - p[1]) == pytest.approx(0.1, abs=1e-6) and np.linalg.norm(p[0] - p[2]) == pytest.approx(0.9, abs=1e-6)


def test_annotation_state(spark):
    events = spark.createDataFrame([("u", 1, 1, "A"), ("u", 1, 2, "B"), ("u", 2, 1, "A"), ("u", 2, 2, "")], "user string, id int, t int, label string")
    assert [tuple(r) for r in A.current(events, ["user", "id"], "t", "label").collect()] == [("u", 1, "B")]
    pool = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, quota int")
    got = A.assign(pool, "u", 4)
    assert {r["id"] % 3 for r in got.collect()} == {1, 2} and got.count() == 4
    left = A.take_quota(pool, got)
    assert left.agg(F.sum("quota")).first()[0] == 9 - 4
    kept, back = A.remove_users(got, left, ["u"])
    assert kept.count() == 0 and back.agg(F.sum("quota")).first()[0] == 9
    scored = spark.createDataFrame([(i, i / 50) for i in range(50)], "id int, confidence double")
    places = A.interleave(scored).collect()
    assert sorted(r["place"] for r in places) == list(range(1, 51)) and len({r["id"] for r in places}) == 50


def test_markup_and_times(spark):
    df = spark.createDataFrame([('uno <span schema_label="x">dos <span schema_label="y">tres</span></span>', "Time spent: 1d 2h 3m 4s"), (None, None), ("", "5s")], "m string, t string")
    got = df.select(A.parse_spans(F.col("m")).alias("p"), A.seconds(F.col("t")).alias("s")).collect()
    assert got[0]["p"]["text"] == "uno dos tres" and [tuple(s) for s in got[0]["p"]["spans"]] == [(4, 12, "x"), (8, 12, "y")]
    assert [r["s"] for r in got] == [7384, 0, 5]
