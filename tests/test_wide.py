from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from acervo.functions.clean import TYPES
from acervo.operators.wide import cells, widen

KEYS = [("cpv", "CPV", "cpv"), ("importe", "Importe base", "decimal"), ("limite", "Fecha límite", "date"), ("nota", "Nota", "text"), ("ue", "Financiación europea", "boolean")]


def tables(spark, rows, uploads=(1, 2)):
    eav = spark.createDataFrame(rows, "id long, document_id long, metadata_key string, metadata_value string, value string")
    return eav, spark.createDataFrame(KEYS, "attribute string, label string, value_type string"), spark.createDataFrame([(u, "x") for u in uploads], "id long, cpv string")


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [
        ("cpv", "3182700.0", "03182700"), ("cpv", "59567200-0", "59567200"), ("cpv", "123", None), ("postal", "2775", "02775"), ("postal", "34720.0", "34720"), ("postal", "99999", None),
        ("integer", " +3 ", "3"), ("integer", "044", "44"), ("integer", "45 meses", "45"), ("integer", "19 uds.", "19"), ("integer", "varios", None), ("integer", "000", "0"),
        ("decimal", "83.457,90", "83457.90"), ("decimal", "7,463.43", "7463.43"), ("decimal", "5 987,77", "5987.77"), ("decimal", "EUR 3550371,46", "3550371.46"), ("decimal", "1.750.616,05 €", "1750616.05"), ("decimal", "€", None),
        ("date", "17 de agosto de 2025", "2025-08-17"), ("date", "1-2-2024", "2024-02-01"), ("date", "20221205", "2022-12-05"), ("date", "2024-10-03T14:00:00Z", "2024-10-03"), ("date", "31/02/2024", None), ("date", "2023-13-05", None),
        ("boolean", "Sí", "true"), ("boolean", "0", "false"), ("boolean", "quizá", None), ("text", " a \n b c ", "a b c"), ("text", None, None),
    ],
)
def test_types(spark, kind, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string").select(TYPES[kind][0](F.col("raw")).alias("v"))
    assert df.first()["v"] == want


def test_newest_valid_wins_and_failures_stay(spark):
    rows = [
        (1, 1, "cpv", "11111111", "x"), (2, 1, " C.P.V: ", "22222222", "x"), (3, 1, "cpv", "bad", "x"), (4, 1, "CPV", "SOLICITADO", "x"),
        (5, 1, "IMPORTE BASE", "1.000,50", None), (6, 1, "Fecha limite", "2024-01-02", None), (7, 1, "unknown", "y", None), (8, 1, None, "y", None), (9, 1, "nota", None, None),
        (10, None, "nota", "z", None), (11, 9, "nota", "deleted upload", None), (12, 2, "nota", "n/d", None), (13, 1, "ue", "SI", None), (13, 1, "ue", "SI", None),
    ]
    out = {r["document_id"]: r for r in widen(*tables(spark, rows)).collect()}
    assert set(out) == {1}
    r = out[1]
    assert (r["cpv"], r["importe"], str(r["limite"]), r["nota"], r["ue"], r["failures"]) == ("22222222", Decimal("1000.50"), "2024-01-02", None, True, {"cpv": "bad"})


def test_ties_and_cells(spark):
    rows = [(1, 1, "nota", "a", None), (1, 1, "nota", "b", None)]
    assert [tuple(r) for r in cells(widen(*tables(spark, rows))).collect()] == [(1, "nota", "b")]


def test_empty(spark):
    assert widen(*tables(spark, [])).collect() == []
    assert widen(*tables(spark, [(1, 1, "nota", "a", None)], uploads=())).collect() == []
