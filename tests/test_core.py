import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.functions import objective as O
from acervo.operators import evaluation as E
from acervo.operators import retrieval as R
from acervo.operators import topics as T
from acervo.operators.latest import latest
from acervo.operators.ranking import bucket_rank
from acervo.operators.search import block_search
from acervo.operators.selection import greedy
from acervo.plans.catalog import Catalog, Exists, Missing, raw_query
from acervo.runtime import cut, discard, materialise, shared_dir
from acervo.sources import readers, sinks


def test_latest_ties_nulls_repeats(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", 2, "z"), ("b", None, "n"), (None, 9, "q")], "k string, t int, v string")
    assert sorted(map(tuple, latest(df, ["k"], ["t"], ["v"]).collect()), key=str) == [("a", 2, "z"), ("b", None, "n")]
    assert latest(df.limit(0), ["k"], ["t"], ["v"]).collect() == []


def test_bucket_rank_equals_row_number(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(v)) for g, v in zip(rng.integers(0, 3, 400) // 2, rng.permutation(400))]
    df = spark.createDataFrame(rows, "g int, v int").withColumn("b", F.floor(F.col("v") / 50))
    got = {(r["g"], r["v"]): r["rank"] for r in bucket_rank(df, ["g"], "b", [F.col("v")]).collect()}
    for g in {g for g, _ in rows}:
        for i, v in enumerate(sorted(v for x, v in rows if x == g), 1):
            assert got[g, v] == i


def test_materialise_and_discard(spark):
    df = materialise(spark.range(10), "t")
    new = cut(df.where("id > 4"), old=df)
    assert new.count() == 5
    with pytest.raises(Exception):
        df.collect()
    discard(new)


def test_keyword_and_raw_query(spark):
    df = spark.createDataFrame([(1, "Obras de la plaza", 2020), (2, "plaza de obras", 2021), (3, None, 2022), (4, "", None)], "id int, text string, y int")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(raw_query(df, 'text:"obras de"')) == [1]
    assert ids(raw_query(df, "text:plaza AND y:[2021 TO *]")) == [2]
    assert ids(raw_query(df, "NOT text:plaza")) == [3, 4]
    assert ids(raw_query(df, "text:*")) == [1, 2, 4]
    assert ids(raw_query(df, "*:*", fq="y:[2020 TO 2022}")) == [1, 2]
    assert [r["id"] for r in raw_query(df, sort="y desc", start=1, rows=2).collect()] == [2, 1]
    for bad in ("nope:x", "(text:a", "text:a )"):
        with pytest.raises(ValueError):
            raw_query(df, bad)
    with pytest.raises(ValueError):
        R.parse_sort("y:down")


def test_year_range_rules(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2020-06-01 00:00:00', timestamp_ntz'2021-01-01 00:00:00')) AS d")
    count = lambda a, b: df.where(R.year_range(F.col("d"), a, b)).count()
    assert (count(2020, None), count(None, 2021), count(2020, 2021), count(None, None)) == (1, 1, 2, 2)
    with pytest.raises(ValueError):
        R.year_range(F.col("d"), 2022, 2021)


def test_chunks_and_greedy(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(500)))), (2, "a b"), (3, ""), (4, None)], "id int, t string")
    got = {(r["id"], r["idx"]): r["text"].split() for r in R.chunks(df, "id", "t").collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0)} and got[1, 2][0] == "384" and got[1, 2][-1] == "499"
    nodes = spark.createDataFrame([(1, 0, 0.9, 10), (1, 1, 0.8, 10), (1, 5, 0.7, 10), (1, 9, 0.1, 10)], "d int, idx int, score double, size int")
    assert [r["idx"] for r in greedy(nodes, "d", 100, 2, 0.5, 1, 3).orderBy("order").collect()] == [0, 5]


def test_bm25_and_fusion(spark):
    df = spark.createDataFrame([(1, "rojo azul azul"), (2, "azul"), (3, "verde"), (4, None)], "id int, text string")
    got = {r["id"]: r["score"] for r in R.bm25(df, ["azul"]).collect()}
    n, avg, idf = 4, 5 / 4, np.log(1 + (4 - 2 + 0.5) / 2.5)
    assert got.keys() == {1, 2} and got[1] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)))
    a, b = spark.createDataFrame([(1, 1)], "id int, rank int"), spark.createDataFrame([(2, 1)], "id int, rank int")
    assert {r["id"]: r["score"] for r in R.fuse(a, b).collect()}[2] == pytest.approx(1 / 61 + 1 / 1000060)


def test_block_search_is_exact(spark):
    x = np.random.default_rng(0).normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, None), (98, [1.0])], "id long, v array<double>")
    got = {(r["query"], r["rank"]): r["id"] for r in block_search(df.where("id < 7"), df, 4, 5).collect()}
    want = np.argsort(-(x[:7] @ x.T), axis=1)[:, :4]
    assert all(got[q, r + 1] == want[q, r] for q in range(7) for r in range(4))


def test_integer_weights_sum(spark):
    df = spark.createDataFrame([(1, 0, 1 / 3), (1, 1, 1 / 3), (1, 2, 1 / 3), (2, 4, 1.0)], "doc_id int, topic int, w double")
    coded = {r["doc_id"]: r["thetas"] for r in T.encode(T.to_integers(df)).collect()}
    assert coded == {1: "t0|334 t1|333 t2|333", 2: "t4|1000"}


def test_overlap_edges(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b", "b"], ["b", "c"])], "a array<string>, b array<string>")
    got = [tuple(round(v, 3) for v in r) for r in df.select(*E.overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [(1, 1, 1), (0, 0, 0), (0.5, 0.5, 0.5)]
    assert E.binomial_p(5, 10) == 1.0 and E.binomial_p(10, 10) == pytest.approx(2 / 1024)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("El presente contrato tiene por objeto la limpieza de los edificios municipales. Otra cosa.", "la limpieza de los edificios municipales"),
        ("tiene por objeto corto.", None), ("nada", None), (None, None), ("Aquest contracte té per objecte el manteniment de les zones verdes; i més", "el manteniment de les zones verdes"),
    ],
)
def test_snippet(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(O.snippet(F.col("t"))).first()[0] == want


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    df = spark.createDataFrame([("a", 1, "uno"), ("b", 2, None)], "place string, id int, title string")
    c.index_corpus("Main", df, {"id": "place"}, ("title",), ("title",))
    assert c.list("corpus") == ["main"] and "id_original" in c.read("main").columns
    with pytest.raises(Exists):
        c.create("main", df)
    c.upsert("main", spark.createDataFrame([("b", "dos")], "id string, title string"))
    assert {r["id"]: r["title"] for r in c.read("main").collect()} == {"a": "uno", "b": "dos"}
    c.set_searchable("main", add=("id",))
    assert c.query("main", "searchable:a").count() == 1
    for k in (5, 20):
        c.index_model(f"0_45_{k}_topics", "main", spark.range(k))
    assert [tuple(r) for r in c.granularities("main").collect()] == [("45", 5, 20)]
    c.add_field("main", "extra", F.lit(1)), c.drop_field("main", "id_original")
    assert "extra" in c.read("main").columns
    c.delete("main")
    assert c.list() == []
    with pytest.raises(Missing):
        c.read("main")


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": {"y": 1}, "z": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": {"y": 1}, "z": 2}\n{"x": null, "z": 3}\n')
    assert readers.json_records(spark, str(tmp_path / "a.json")).count() == 1
    assert [tuple(r) for r in readers.flatten(readers.by_extension(spark, str(tmp_path / "b.jsonl"))).collect()] == [(1, 2), (None, 3)]
    (tmp_path / "w.txt").write_text("uno\n\n dos \nuno\n")
    assert sorted(r[0] for r in readers.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["dos", "uno"]
    (tmp_path / "e.txt").write_text("a:b\nbad\n")
    assert [tuple(r) for r in readers.equivalences(spark, str(tmp_path / "e.txt")).collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        readers.by_extension(spark, "x.xlsx")
    assert shared_dir(spark)
    with pytest.raises(ValueError):
        sinks.partial_update(spark.range(1), spark.range(1), "id", {"id": "nope"})
