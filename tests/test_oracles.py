"""Every core query with a statement gives DuckDB's rows; the others run."""

import glob
from pathlib import Path

import duckdb
import pytest

from acervo import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, tmp_path, name):
    QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    if name not in SQL:
        return
    duck.execute(f"CREATE OR REPLACE TABLE want AS {SQL[name]}")
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    cols = sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    assert cols == sorted(r[0] for r in duck.execute("DESCRIBE got").fetchall())
    names = ", ".join(f'"{c}"' for c in cols)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []
