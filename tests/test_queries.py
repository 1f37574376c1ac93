"""Every query with SQL gives what the SQL gives, over the whole of the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from keystrata.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = catalogue.QUERIES, catalogue.ORACLE


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


def test_entry_has_rows(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(ORACLE) <= set(QUERIES)


def test_the_optional_subpackage_may_fail_to_import(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "keystrata.llm", None)
    assert set(contract.queries()) == set(QUERIES) and set(contract.oracle_sql()) == set(ORACLE)


def test_reading_the_change_log_starts_no_job_before_its_sink(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        for name in ("get_committed_all", "multi_get", "ordered_scan", "wal_dedupe", "l0_flush", "merge_precedence", "compact_l0_to_sr", "layered_get", "state_after_compaction", "space_amplification"):
            QUERIES[name](spark, str(DATA))
        jobs = list(tracker.getJobIdsForGroup("building"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the only jobs are those that read the schema of a table's file
    assert not [j for j in jobs if (info := tracker.getJobInfo(j)) and any((st := tracker.getStageInfo(s)) and st.numTasks > 1 for s in info.stageIds)]
