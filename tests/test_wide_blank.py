from acervo import catalogue

EAV = "id long, document_id long, metadata_key string, metadata_value string"


def test_every_upload_with_rows_has_one(spark, tmp_path):
    """Placeholders, unknown keys and null values leave a row of nulls; no rows, no row."""
    rows = [(1, 1, "nota", "x"), (2, 2, "nota", "n/d"), (3, 3, "unknown", "y"), (4, 4, "nota", None), (5, 5, "importe", "bad"), (6, 9, "nota", "n/d"), (7, None, "nota", "z"), (2, 2, "nota", "n/d")]
    spark.createDataFrame(rows, EAV).write.parquet(f"{tmp_path}/metadatos.parquet")
    spark.createDataFrame([("nota", "Nota", "text"), ("importe", "Importe", "decimal")], "attribute string, label string, value_type string").write.parquet(f"{tmp_path}/metadata_keys.parquet")
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 2)], "id long").write.parquet(f"{tmp_path}/uploads.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["p4_wide"](spark, str(tmp_path)).select("document_id", "nota", "importe", "failures").collect())
    assert got == [(1, "x", None, {}), (2, None, None, {}), (3, None, None, {}), (4, None, None, {}), (5, None, None, {"importe": "bad"})]
    found = catalogue.queries()["p4_found"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(1, "nota", "x")]
