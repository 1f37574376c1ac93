"""Every query of the subpackage with SQL gives what the SQL gives, over the whole of the smallest tables."""

from pathlib import Path

import pytest
from keystrata.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rel = duck.execute(ORACLE[name])
    have = [c[0] for c in rel.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    assert QUERIES[name](spark, str(DATA)).count() > 0
