"""Every query of the node engine and the function library against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from nodeloom.queries import expressions, library, paths, stylesheets, transforms, values

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = {**paths.QUERIES, **library.QUERIES, **values.QUERIES, **transforms.QUERIES, **expressions.QUERIES, **stylesheets.QUERIES}, {**paths.ORACLE, **library.ORACLE, **values.ORACLE, **transforms.ORACLE, **expressions.ORACLE, **stylesheets.ORACLE}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(row):
    return tuple(round(x, 5) if isinstance(x, float) and not math.isnan(x) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLE:
        assert got.num_rows
        return
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    rows = db.sql(f"select {columns} from got").fetchall()
    want = db.sql(f"select {columns} from ({ORACLE[name]})").fetchall()
    assert sorted(map(plain, rows), key=str) == sorted(map(plain, want), key=str)
