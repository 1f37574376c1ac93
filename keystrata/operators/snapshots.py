"""What changed between full snapshots.

Every snapshot is unpivoted into signed cells: +1 in the pair (previous, this) where it is the newer side
and -1 in the pair (this, next) where it is the older one. A record gives one presence marker and one
cell for each attribute. Cells whose signs cancel are equal on both sides; what is left classifies the
record (presence +1 added, -1 removed, 0 with other cells left changed) and names the changed fields.

A record travels once: it is sent to the stretch of versions its pairs lie in, and gets its signs there.
Only at the edge of two stretches it goes to both. Whole records that are equal on both sides are
cancelled, by the same signed sum over all attributes at once, before they are spread into cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from keystrata.operators.ordering import with_previous

#: Attributes of one file handle, apart from its position in a list.
HANDLE_FIELDS = ["first_key", "index_offset", "index_len", "filter_offset", "filter_len", "codec"]
PRESENCE = "__present"
#: Versions whose records of one key meet in one task.
STRETCH = 64


def counted_snapshots(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """The snapshots that count: their store and location stand in ``manifests`` with an id that is not null.

    Snapshots without store, manifest id or location never count.
    """
    listed = manifests.filter("id is not null").select("store_id", "location").distinct()
    return snapshots.select("store_id", "manifest_id", "location", "l0", "compacted").filter("manifest_id is not null").join(listed, ["store_id", "location"], "left_semi").drop("location")


def handle_records(snapshots: DataFrame) -> DataFrame:
    """One row per file a snapshot lists, with the attributes of its handle; the other columns stay.

    Level 0 and runs are told apart by ``layer`` and ``run_id``. Handles without an id are left out; null
    and empty lists hold no record. A snapshot is read once, whatever its lists.
    """
    keep = [c for c in snapshots.columns if c not in ("l0", "compacted")]
    none = F.lit(None).cast("bigint")
    entry = lambda layer, run: lambda s: F.struct(F.lit(layer).alias("layer"), run.alias("run_id"), s["sst_id"].alias("sst_id"), *[s[c].alias(c) for c in HANDLE_FIELDS])
    level0 = F.transform("l0", entry("l0", none))
    runs = F.flatten(F.transform("compacted", lambda r: F.coalesce(F.transform(r["ssts"], entry("run", r["id"])), F.array())))
    both = F.concat(F.coalesce(level0, F.array()), F.coalesce(runs, F.array()))
    return snapshots.select(*keep, F.explode(both).alias("s")).select(*keep, "s.*").filter("sst_id is not null")


def snapshot_pairs(versions: DataFrame, group: str, version: str) -> DataFrame:
    """Where the rows of every version go: ``group, version, stretch, newer, before_newer, older_of``.

    A version is the newer side of the pair that ends with it (``newer`` is its own number and
    ``before_newer`` the one before) and the older side of the next pair (``older_of`` is the number that
    ends it). One row per stretch of pairs it takes part in: one, or two at an edge. A version alone in
    its group takes part in none.
    """
    steps = with_previous(versions, [group], [version], [version], F.floor(F.col(version) / 4096), "p").filter("p is not null")
    steps = steps.select(group, F.col(version).alias("__to"), F.col(f"p.{version}").alias("__prev"))
    none = F.lit(None).cast("bigint")
    newer = steps.select(group, F.col("__to").alias(version), F.col("__to").alias("newer"), F.col("__prev").alias("before_newer"), none.alias("older_of"), F.floor(F.col("__to") / STRETCH).alias("stretch"))
    older = steps.select(group, F.col("__prev").alias(version), none.alias("newer"), none.alias("before_newer"), F.col("__to").alias("older_of"), F.floor(F.col("__to") / STRETCH).alias("stretch"))
    return newer.unionByName(older).groupBy(group, version, "stretch").agg(*[F.max(c).alias(c) for c in ("newer", "before_newer", "older_of")])


def _shown(value: Column, kind) -> Column:
    return F.hex(value) if isinstance(kind, BinaryType) else value.cast("string")


def snapshot_changes(records: DataFrame, group: str, version: str, key: str) -> DataFrame:
    """Changes between consecutive versions of every group, by signed cells.

    ``records``: one row per record of a version, joined with ``snapshot_pairs``; ``group``, ``version``
    and ``key`` with any attribute columns of plain types (null is a value of its own, repeated rows count
    once). Versions are integers, consecutive in ascending order, also where numbers are missing between
    them. The first version of a group gives no rows. A version without records removes all of the one
    before. Several differing rows of a key in one version count as a set of cells per attribute.

    Returns ``group, prev_<version>, <version>, key, change_kind, changed_fields``.
    """
    pair = ["stretch", "newer", "before_newer", "older_of"]
    fields = [c for c in records.columns if c not in (group, version, key, *pair)]
    kinds = {f.name: f.dataType for f in records.schema}
    record = [group, key, "stretch"]
    # one shuffle by record; every grouping below refines it and stays where the rows are
    placed = records.repartition(*record)
    side = lambda to, prev, sign: F.struct(F.col(to).alias("to"), F.col(prev).alias("prev"), F.lit(sign).alias("sign"))
    signed = placed.select(*record, *fields, F.explode(F.array(side("newer", "before_newer", 1), side("older_of", version, -1))).alias("x")).filter("x.to is not null").select(*record, *fields, "x.*")
    plus, minus = F.greatest(F.col("sign"), F.lit(0)), F.least(F.col("sign"), F.lit(0))
    at = [*record, "to", "prev"]
    rows = signed.groupBy(*at, *fields).agg(F.max(plus).alias("__plus"), F.min(minus).alias("__minus"))
    marker = F.struct(F.lit(PRESENCE).alias("field"), F.lit(None).cast("string").alias("value"))
    cells = F.array(marker, *[F.struct(F.lit(c).alias("field"), _shown(F.col(c), kinds[c]).alias("value")) for c in fields])
    spread = rows.select(*at, "__plus", "__minus", F.explode(F.when(F.col("__plus") + F.col("__minus") != 0, cells).otherwise(F.array(marker))).alias("c")).select(*at, "c.field", "c.value", "__plus", "__minus")
    # the cells of a side are a set: a value that several rows of a side share weighs once
    sums = spread.groupBy(*at, "field", "value").agg((F.max("__plus") + F.min("__minus")).alias("__sum"))
    present = F.max(F.when(F.col("field") == PRESENCE, F.col("__sum")))
    changed = F.array_sort(F.collect_set(F.when((F.col("field") != PRESENCE) & (F.col("__sum") != 0), F.col("field"))))
    out = sums.groupBy(*at).agg(present.alias(PRESENCE), changed.alias("changed_fields")).filter((F.col(PRESENCE) != 0) | (F.size("changed_fields") > 0))
    kind = F.when(F.col(PRESENCE) > 0, "added").when(F.col(PRESENCE) < 0, "removed").otherwise("changed")
    return out.select(group, F.col("prev").alias(f"prev_{version}"), F.col("to").alias(version), key, kind.alias("change_kind"), "changed_fields")


def compare_snapshots(versions: DataFrame, records: DataFrame, group: str, version: str, key: str) -> DataFrame:
    """``snapshot_changes`` of plain tables: ``versions`` has a row per version, ``records`` one per record."""
    pairs = snapshot_pairs(versions.select(group, version).dropna().distinct(), group, version)
    return snapshot_changes(records.join(pairs, [group, version]), group, version, key)


def handle_changes(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """Changes of file handles between consecutive manifests of every store.

    The pairs are put to the snapshots while their lists are still lists.
    """
    counted = counted_snapshots(snapshots, manifests)
    pairs = snapshot_pairs(counted.select("store_id", "manifest_id").distinct(), "store_id", "manifest_id")
    return snapshot_changes(handle_records(counted.join(pairs, ["store_id", "manifest_id"])), "store_id", "manifest_id", "sst_id")
