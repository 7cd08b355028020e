"""Operators that SQL doesn't express, against plain loops and hand-worked cases."""


import math
import zipfile

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from acervo.functions.stemming import stem
from acervo.operators import chain as C
from acervo.operators import encoders as N
from acervo.operators import evaluation as E
from acervo.operators import models as M
from acervo.operators import pages as G
from acervo.operators.annotation import interleave
from acervo.operators.search import block_search
from acervo.sources import readers, sinks
from acervo.streaming.upserts import Buckets


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rational", "ration"),
        ("digitizer", "digit"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"),
        ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("at", "at"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
@settings(max_examples=200, deadline=None)
def test_common_length(a, b):
    assert E.common_length(a, b) == longest(a, b)


def test_rouge(spark):
    rows = [("the cats were running fast", "the cat is running"), ("", ""), (None, "x"), ("a b c d", "d c b a"), ("ñandú año", "and a o")]
    got = E.rouge(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert (got[0]["p1"], got[0]["r1"]) == (3 / 4, 3 / 5) and got[0]["f1"] == pytest.approx(2 / 3) and got[0]["f2"] == pytest.approx(2 * (1 / 3 * 1 / 4) / (1 / 3 + 1 / 4)) and got[0]["pl"] == 3 / 4
    assert got[1]["f1"] == got[2]["f1"] == 0 and got[3]["f1"] == 1 and got[3]["fl"] == 0.25 and got[4]["r1"] == 1


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=25))
@settings(max_examples=200, deadline=None)
def test_tau(pairs):
    a, b = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    sign = [(np.sign(x[0] - y[0]), np.sign(x[1] - y[1])) for x, y in combinations(pairs, 2)]
    s, x, y = sum(p * q for p, q in sign), sum(abs(p) for p, _ in sign), sum(abs(q) for _, q in sign)
    got = E.tau_b(a, b)
    assert got is None if not x * y else math.isclose(got, s / math.sqrt(x * y), abs_tol=1e-12)


@pytest.mark.parametrize(("wins", "n"), [(0, 0), (5, 10), (0, 12), (11, 12), (300, 1000), (50_000, 100_000), (49_000, 100_000)])
def test_binomial(wins, n):
    masses = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(n + 1)]
    want = min(1.0, sum(m for m in masses if m <= masses[wins] * (1 + 1e-7)))
    assert E.binomial_p(wins, n) == pytest.approx(want, rel=1e-6)


def test_quantile(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 1000), ("b", 1), ("c", 7)) for v in np.round(rng.lognormal(0, 3, n), 1)] + [("d", 5.0)] * 40 + [("e", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.05, 0.5, 0.99, 1.0):
        got = {r["g"]: r["quantile"] for r in E.quantile(df, ["g"], "v", q, 16).collect()}
        by = {g: [v for h, v in rows if h == g and v is not None] for g in ("a", "b", "c", "d", None)}
        assert got == {g: pytest.approx(np.quantile(v, q)) for g, v in by.items()}
    assert E.quantile(df.limit(0), ["g"], "v", 0.5).collect() == [] and E.quantile(df.limit(0), [], "v", 0.5).first()["quantile"] is None


def test_interleave(spark):
    for n, every in ((0, 2), (1, 2), (57, 2), (57, 3)):
        got = interleave(spark.createDataFrame([(i, i / 100 if i % 9 else None) for i in range(n)], "id int, confidence double"), every).collect()
        assert sorted(r["place"] for r in got) == list(range(1, n + 1)) and {r["id"] for r in got} == set(range(n))


def test_block_search_in_passes(spark):
    x = np.random.default_rng(2).normal(size=(90, 5)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 5), (99, [1.0]), (98, None)], "id long, v array<double>")
    one, many = (sorted(tuple(r) for r in block_search(df, df, 7, 5, held).collect()) for held in (1 << 20, 800))
    assert one == many and len(one) == 90 * 7
    s = np.round(x @ x.T, 12)
    assert [r[1] for r in one[:7]] and {r[1] for r in one if r[0] == 3} == set(np.lexsort((np.arange(90), -s[3]))[:7].tolist())
    assert block_search(df.limit(0), df, 3, 5).collect() == [] == block_search(df, df.limit(0), 3, 5).collect()


def test_choose():
    text = lambda n: "x" * n
    node = lambda i, s, n=100, r=False: (i, s, text(n), r)
    assert C.choose([]) == [] and [i for i, _ in C.choose([node(3, 0.2)])] == [3]
    # required ones first, whatever they cost, then by score away from those taken
    got = [i for i, _ in C.choose([node(0, 0.1, 4000, True), node(10, 0.9), node(11, 0.8), node(20, 0.7), node(30, 0.6), node(40, 0.5)], fewest=2)]
    assert got[0] == 0 and 11 not in got and len(got) >= 2
    # fewest are filled up although they are neighbours or weak
    assert len(C.choose([node(i, 1 - i / 10) for i in range(6)], fewest=4)) >= 4
    # never more than most; blank texts and repeated ends don't count
    assert len(C.choose([node(3 * i, 1.0) for i in range(40)], most=9, budget=10**6)) == 9
    assert C.choose([(1, 0.5, "  ", True), (2, 0.4, " a ", False)]) == [(2, "a")]
    # the budget stops the second phase once enough are taken
    assert len(C.choose([node(5 * i, 1.0, 1000) for i in range(9)], fewest=2, budget=3500)) == 3
    long = "Primera frase. " * 100
    assert C.clipped(long, 1200).endswith("frase.") and len(C.clipped(long, 1200)) <= 1200


def test_encoders(spark):
    rows = [("a", "Uno dos dos"), ("b", ""), ("c", None), ("d", "ñandú 7 a_b")]
    df = spark.createDataFrame(rows, "k string, t string")
    cells = {}
    for r in N.hashed_cells(df, ["k"], "t").collect():
        cells.setdefault(r["k"], {})[r["i"]] = r["x"]
    for r in N.encode(df, "t").collect():
        held = {i: x for i, x in enumerate(r["embedding"] or []) if x}
        assert held == pytest.approx(cells.get(r["k"], {}))
    asked = []

    def model(prompts):
        asked.extend(prompts)
        return [p[::-1] for p in prompts]

    got = {r["k"]: r["answer"] for r in N.complete(df, "t", model).collect()}
    assert got == {"a": "sod sod onU", "b": "", "c": None, "d": "b_a 7 údnañ"}


def test_coherence_against_plain_windows(spark):
    rng = np.random.default_rng(3)
    texts = [[str(w) for w in rng.choice(list("abcdefgh"), rng.integers(1, 40))] for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, tokens array<string>")
    words = ["a", "b", "c"]
    top = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "topic int, rank int, term string")
    held = [set(t[i : i + 10]) for t in texts for i in range(max(1, len(t) - 9))]
    p = lambda *w: sum(all(x in h for x in w) for h in held) / len(held)
    pmi = lambda a, b: math.log((p(a, b) + 1e-12) / (p(a) * p(b)))
    got = {m: M.window_coherence(docs, top, m, 10).first()["coherence"] for m in ("c_uci", "c_npmi", "c_v")}
    assert got["c_uci"] == pytest.approx(np.mean([pmi(a, b) for a, b in combinations(words, 2)]))
    npmi = np.array([[pmi(a, b) / -math.log(p(a, b) + 1e-12) for b in words] for a in words])
    assert got["c_npmi"] == pytest.approx(npmi[np.triu_indices(3, 1)].mean())
    whole = npmi.sum(0)
    assert got["c_v"] == pytest.approx(np.mean([row @ whole / np.linalg.norm(row) / np.linalg.norm(whole) for row in npmi]))


def test_matrices_and_sheets(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1.0, 0.0], [0.0, 2.5]]))
    np.savez(tmp_path / "b.npz", indptr=[0, 1, 3], indices=[2, 0, 1], data=[7.0, 8.0, 9.0], shape=[2, 3])
    got = {(r["path"][-5:], r["row"], r["col"]): r["x"] for r in readers.matrix(spark, str(tmp_path)).collect()}
    assert got["a.npy", 1, 1] == 2.5 and len([k for k in got if k[0] == "a.npy"]) == 4
    assert {k[1:]: v for k, v in got.items() if k[0] == "b.npz"} == {(0, 2): 7.0, (1, 0): 8.0, (1, 1): 9.0}
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>4.5</v></c></row><row r="40"><c r="A40"><v>1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>título</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    assert sorted((r["row"], r["col"], r["value"]) for r in readers.spreadsheet(spark, str(tmp_path)).collect()) == [(0, 0, "título"), (0, 27, "4.5")]


def test_files_that_fail(spark):
    rows = spark.createDataFrame([("b", bytearray(b"\xff\xfe")), ("a", bytearray("sí".encode()))], "path string, content binary")
    assert {r["path"]: r["result"] for r in G.map_files(rows).collect()} == {"a": "sí", "b": None}
    assert {r["path"]: r["result"] for r in G.map_files(rows, lambda c: 1 / 0).collect()} == {"a": None, "b": None}


def test_upsert_with_repeated_keys(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    changes = spark.createDataFrame([(1, "y", 2), (1, "z", 1), (3, "a", 1), (3, "a", 1), (None, "n", 1)], "k int, v string, t int")
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(base, changes, "k", "t").collect()) == [(1, "y"), (2, "y"), (3, "a")]
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(base, changes.drop("t"), "k").collect()) == [(1, "z"), (2, "y"), (3, "a")]


def test_buckets(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), "k", "at", 4)
    assert table.read() is None
    kind = "k int, at int, v string"
    table.merge(spark.createDataFrame([(i, 1, "a") for i in range(40)], kind), 1)
    late = spark.createDataFrame([(3, 2, "new"), (3, 2, "new"), (5, 0, "old")], kind)
    table.merge(late, 2)
    once = sorted(tuple(r) for r in table.read().collect())
    table.merge(late, 2)  # a batch that is run again
    assert once == sorted(tuple(r) for r in table.read().collect()) and len(once) == 40
    got = {k: v for k, _, v in once}
    assert got[3] == "new" and got[5] == "a"
    assert len({v for v in table._versions().values()}) == 2  # untouched buckets keep their version


def test_late_rows_are_left_out(spark, tmp_path):
    """Append mode: a window the watermark has passed takes no more rows."""
    import datetime

    from acervo.streaming.upserts import run_windows

    at = lambda h, m=0: datetime.datetime(2025, 1, 1, h, m)
    source, out, stamps = (str(tmp_path / n) for n in ("in", "out", "stamps"))
    for rows in ([(at(1), "a", 1.0), (at(5), "a", 1.0)], [(at(1, 30), "a", 9.0), (at(9), "a", 1.0)], [(at(20), "a", 1.0)]):
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(source)
        run_windows(spark, source, out, stamps)
    got = {r["start"].hour: (r["n"], r["total"]) for r in spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out).collect()}
    assert got[1] == (1, 1.0) and got[5] == (1, 1.0) and 20 not in got




def test_by_example_moves_vectors_once(spark):
    """Rows of the same key count as one text; chunks that share no place, null keys and null texts have no score; the
    chunks' words don't leave their task."""
    nodes = spark.createDataFrame([(1, 0, "a b b"), (1, 0, "c"), (1, 1, "z"), (2, 0, "a"), (3, 0, None), (None, 0, "a")], "doc_id long, idx int, text string")
    examples = spark.createDataFrame([(1, "a b"), (1, "c"), (2, ""), (3, "a"), (None, "a")], "doc_id long, text string")
    out = C.by_example(nodes, examples)
    x, y = N.hashing(["a b b c", "a b c"])
    z = N.hashing(["z"])[0]
    want = {(1, 0): x @ y} | ({(1, 1): z @ y} if (z * y).any() else {})
    assert {(r["doc_id"], r["idx"]): r["score"] for r in out.collect()} == pytest.approx(want)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_files_in_pieces(spark, tmp_path):
    """A file's text comes in pieces, and has the length it has in one."""
    from acervo.functions import objective as O
    from acervo.operators.pages import extracted_lengths, file_pieces

    texts = ["  \n objeto del contrato ¡y más!\n\n  obras … %% públicas\t \n", "x" * 50 + " ¿? " + "yé" * 40, "corto", "", " \n ", "¿ ¡ " * 20, "a " * 30 + "un error de\nacceso " + "b " * 30, "a " * 30 + "un error de acceso " + "b " * 30]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(text.encode())
    (tmp_path / "8.txt").write_bytes(b"texto " * 20 + b"\xff")
    files = readers.files(spark, f"file://{tmp_path}", "*.txt")
    want = {r["path"]: r["n"] for r in G.map_files(files).selectExpr("path", "result").select("path", F.length(O.extracted(F.col("result"))).cast("long").alias("n")).collect()}
    pieces = file_pieces(files, piece=16)
    assert pieces.groupBy("path").count().agg({"count": "max"}).first()[0] > 5
    assert {r["path"]: r["n"] for r in extracted_lengths(pieces).collect()} == want and len(want) == 8  # an empty file isn't listed
    assert {r["path"]: r["n"] for r in extracted_lengths(file_pieces(files)).collect()} == want
