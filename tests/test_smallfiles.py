import posixpath
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from keystrata.functions.hilbert import hilbert_codes
from keystrata.functions.paths import clean_path
from keystrata.operators import smallfiles
from keystrata.operators.smallfiles import assign_targets, consolidate_rows, plan_consolidation, row_digest, small_objects
from pyspark.sql import functions as F

LISTING = "object_id bigint, store_id bigint, location string, last_modified timestamp_ntz, size_bytes bigint, config_id int, path string, folder string"
CONFIG = "config_id int, block_size bigint"


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = [g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")]
        codes = hilbert_codes(grid, bits)
        order = np.argsort(codes)
        points = np.stack(grid, 1)[order]
        assert sorted(codes.tolist()) == list(range(1 << bits * n))
        assert np.abs(np.diff(points, axis=0)).sum(1).max() == 1


def test_paths_are_cleaned_below_the_root(spark):
    cases = ["wal/1.sst", "/wal//1.sst", "./wal/./1.sst", "wal/../wal/1.sst", "wal/old/../1.sst/", "../wal/1.sst", "a/../../b", "", "..", "/", "wal/..", "a/b/../../.."]
    got = [r.p for r in spark.createDataFrame([(c,) for c in cases], "c string").select(clean_path(F.col("c")).alias("p")).collect()]
    for case, path in zip(cases, got):
        want = posixpath.normpath(posixpath.join("r", *[p for p in [case.strip("/")] if p]) if case.strip("/") else "r")
        if want == "r" or want.startswith("r/"):
            assert path == want[2:], case
        else:
            assert path.startswith(".."), case


def test_only_the_latest_listing_of_small_data_objects_counts(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (1, 1, "wal/1.sst", t, 10, 1),
        (2, 1, "/wal/x/../1.sst", t + timedelta(1), 20, 1),  # later
        (3, 1, "wal/2.sst", t, 10, 1),
        (4, 1, "wal//2.sst", t, 30, 1),  # tie: the smaller id
        (5, 1, "wal/3.sst", t, 10, 1),
        (6, 1, "./wal/3.sst", t + timedelta(1), None, 1),  # gone since
        (7, 1, "wal/4.SST", t, 10, 1),
        (8, 1, "wal/a/5.sst", t, 10, 1),
        (9, 1, "compacted/6.sst", t, 100, 1),  # not below the block size
        (10, 1, "compacted/7.sst", t, 99, 1),
        (11, 1, "wal/8.sst", t, 0, 1),
        (12, 1, "wal/9.sst", t, 10, 5),  # unknown configuration
        (13, 1, None, t, 10, 1),
        (14, 2, "wal/1.sst", None, 10, 1),
        (15, 1, "wal/10.sst.tmp", t, 10, 1),
        (16, 1, "../wal/11.sst", t, 10, 1),
    ]
    listing = spark.createDataFrame([(*r, "clash", "clash") for r in rows], LISTING)
    config = spark.createDataFrame([(1, 100), (2, None)], CONFIG)
    assert sorted(r.object_id for r in small_objects(listing, config).collect()) == [2, 3, 10, 14]
    assert sorted(r.object_id for r in plan_consolidation(listing, config).collect()) == [2, 3, 10, 14]
    assert plan_consolidation(listing.limit(0), config).count() == 0


@pytest.mark.parametrize("way", [assign_targets, lambda *a: smallfiles._row_targets(*a)[0]])
@pytest.mark.parametrize("boundaries", [1000, 5])
def test_targets_are_balanced_even_where_a_third_of_rows_is_equal(spark, monkeypatch, boundaries, way):
    monkeypatch.setattr(smallfiles, "MAX_BOUNDARIES", boundaries)
    rng = random.Random(4)
    rows = [(1, 7, 7, 10, 400) for _ in range(1000)] + [(g, rng.randrange(1000), rng.randrange(1000), rng.randrange(1, 20), 400) for g in (1, 2) for _ in range(1000)] + [(1, None, None, 5, 400)]
    df = spark.createDataFrame(rows, "g int, x int, y int, bytes int, target int").selectExpr("*", "'c' as curve", "0 as code", "monotonically_increasing_id() as row")
    out = way(df, ["g"], ["x", "y"], "bytes", "target", "row").collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.g, r.target_no] += r.bytes
    assert max(sizes.values()) < 1.5 * 400 and min(sizes.values()) > 0.5 * 400
    assert len(sizes) <= sum(r[3] for r in rows) / 400 + 3


def test_outliers_take_no_room_on_the_curve(spark):
    from keystrata.operators.smallfiles import _coded

    rows = [(i, i) for i in range(5000)] + [(10**15, -(10**15)), (None, 3)]
    codes = [r.c for r in _coded(spark.createDataFrame(rows, "x bigint, y bigint"), ["x", "y"]).selectExpr("curve_code as c").collect()]
    assert len(set(codes)) > 4000
    assert len({r.c for r in _coded(spark.createDataFrame([(7, None)] * 3, "x bigint, y bigint"), ["x", "y"]).selectExpr("curve_code as c").collect()}) == 1


def test_a_plan_that_lost_an_object_fails(spark, monkeypatch):
    listing = spark.createDataFrame([(i, 1, f"wal/{i:020d}.sst", datetime(2024, 1, 1) + timedelta(i), 10, 1, "p", "f") for i in range(50)], LISTING)
    config = spark.createDataFrame([(1, 100)], CONFIG)
    plan = plan_consolidation(listing, config)
    assert plan.count() == 50 and "curve_code" in plan.select("object_id")._jdf.queryExecution().executedPlan().toString()
    made = smallfiles.assign_targets
    monkeypatch.setattr(smallfiles, "assign_targets", lambda *a: made(*a).filter("object_id <> 7"))
    with pytest.raises(Exception, match="does not hold"):
        plan_consolidation(listing, config).collect()


def test_consolidated_rows_have_equal_digests(spark, tmp_path):
    rows = [(i % 3, bytes([i % 7]) if i % 5 else None, i, 20, 200) for i in range(500)] * 2
    df = spark.createDataFrame(rows, "g int, key binary, seq bigint, size int, target int")
    out = consolidate_rows(df, ["g"], ["seq"], "size", "target", "seq", f"file://{tmp_path}/out")
    columns = ["g", "key", "seq"]
    assert sorted(map(tuple, row_digest(df, columns, ["g"]).collect())) == sorted(map(tuple, row_digest(out, columns, ["g"]).collect()))
    lost = out.filter("seq <> 3")
    assert sorted(map(tuple, row_digest(df, columns, ["g"]).collect())) != sorted(map(tuple, row_digest(lost, columns, ["g"]).collect()))


def test_every_target_is_a_file_of_its_own(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.randrange(1000), i, rng.randrange(5, 20), 200) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, x int, seq bigint, size int, target int")
    out = consolidate_rows(df, ["g"], ["x", "seq"], "size", "target", "seq", f"file://{tmp_path}/out").collect()
    assert sorted((r.g or 0, r.x, r.seq) for r in out) == sorted((r[0] or 0, r[1], r[2]) for r in rows)
    files = defaultdict(list)
    for r in out:
        files["/" + r.file_path.removeprefix("file:").lstrip("/")].append(r)
    on_disk = {str(p): p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet")}
    assert on_disk == {path: of[0].file_bytes for path, of in files.items()}
    assert len(files) == len({(r.g, r.target_no) for r in out}) > 100
    assert all(len({(r.g, r.target_no) for r in of}) == 1 and sum(r.size for r in of) < 2 * 200 for of in files.values())
    stretches = sorted((of[0].g or 0, min(r.curve_code for r in of), max(r.curve_code for r in of)) for of in files.values())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(stretches, stretches[1:]))


@pytest.mark.parametrize("boundaries", [5000, 5])
def test_one_code_fills_more_than_a_thousand_targets(spark, monkeypatch, boundaries):
    monkeypatch.setattr(smallfiles, "MAX_BOUNDARIES", boundaries)
    df = spark.range(60000).selectExpr("1 as g", "cast(null as int) as x", "7 as y", "10 as bytes", "200 as target", "id as row")
    sizes = [r.b for r in smallfiles._row_targets(df, ["g"], ["x", "y"], "bytes", "target", "row")[0].groupBy("target_no").agg(F.sum("bytes").alias("b")).collect()]
    assert sum(sizes) == 600000 and len(sizes) > 2900 and max(sizes) < 3 * 200
