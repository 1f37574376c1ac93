"""Consolidation of many small objects into few well-sized ones.

Rows (or objects) get a Hilbert code over several dimensions, an exact histogram of bytes per code is
summed along the curve, and every target file takes the next stretch of the curve that fills it. The
shuffle by target file is a range shuffle whose boundaries come from the exact histogram, not a sample,
and every target becomes a file of its own. Source and destination are compared by row digests before a
result counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.hilbert import hilbert_code
from keystrata.functions.paths import clean_segments, extension
from keystrata.operators.ordering import with_running_total
from keystrata.sources.scratch import sent_if_small, written

DATA_FOLDERS = ("wal", "compacted")
CODE_BITS = 16
#: Parts of equal weight that each axis is cut into before it is laid on the curve's grid.
QUANTILES = 256
#: Slots of the items of one code: the most files that a code can be spread over.
SLOTS = 1 << 31
#: File boundaries sent to the tasks; more are joined.
MAX_BOUNDARIES = 250_000
#: Bytes that one task writes, and bytes that opening a file counts for in that.
TASK_BYTES = 16 << 20
FILE_COST = 32 << 10


def living_objects(listing: DataFrame) -> DataFrame:
    """Latest listing of every object: ``store_id, folder, name, depth`` and the listing's own columns.

    Locations name the same object if they are equal after cleaning. The greatest ``last_modified`` wins
    (null is older than any time), on a tie the smaller ``object_id``. Null locations name no object.
    """
    path = clean_segments(F.col("location"))
    rows = listing.filter("location is not null").select("store_id", F.array_join(path, "/").alias("path"), F.struct("last_modified", (-F.col("object_id")).alias("__neg"), "object_id", "size_bytes", "config_id").alias("s"))
    latest = rows.groupBy("store_id", "path").agg(F.max("s").alias("s"))
    parts = F.split("path", "/")
    return latest.select("store_id", "path", F.element_at(parts, 1).alias("folder"), F.element_at(parts, -1).alias("name"), F.size(parts).alias("depth"), "s.object_id", "s.last_modified", "s.size_bytes", "s.config_id")


def small_objects(listing: DataFrame, config: DataFrame) -> DataFrame:
    """Living data objects below the block size of their configuration, with ``block_size``.

    Data objects are files with exactly the extension ``.sst`` directly in a data folder. Objects gone
    (null size) or empty, and objects whose configuration is unknown, are no candidates.
    """
    alive = living_objects(listing).filter(F.col("folder").isin(*DATA_FOLDERS) & (F.col("depth") == 2) & (extension(F.col("name")) == ".sst") & (F.col("size_bytes") > 0))
    known = config.groupBy("config_id").agg(F.max("block_size").alias("block_size"))
    return alive.join(known, "config_id").filter("size_bytes < block_size")


def assign_targets(items: DataFrame, group: list[str], axes: list[str], size: str, target: str, tie: str) -> DataFrame:
    """Give every item a target file: columns ``curve_code`` and ``target_no``, counted from 0 per ``group``.

    ``axes`` are integer columns laid on the curve's grid by their quantiles over the whole input; ``size``
    is a positive number, ``target`` the wanted size of the item's group, ``tie`` a column that differs
    between items and is the same whenever the input is read. Files of a group are equal stretches of the
    curve in bytes, as many as come nearest to ``target``. All items of a code go to the file in which the
    middle of the code lies; a code heavier than a file is spread by the digest of ``tie`` over the
    stretch it fills, so over as many files as that has. No item is dropped; null axes count as the
    lowest value. Meant for items that weigh something against a file: they are joined to the histogram.
    """
    coded = _coded(items, axes)
    return _joined_targets(coded.withColumn("__ks_slot", F.pmod(F.xxhash64(tie), F.lit(SLOTS))), _histogram(coded, group, axes, size, target), group)


def _coded(items: DataFrame, axes: list[str]) -> DataFrame:
    """Items with their place on the curve; the quantiles of the axes, one row, are taken first."""
    at = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    spread = items.agg(*[F.percentile_approx(F.col(a).cast("bigint"), at, F.lit(20 * QUANTILES)) for a in axes]).first()
    return items.withColumn("curve_code", hilbert_code([F.col(a) for a in axes], CODE_BITS, list(spread)))


def _histogram(coded: DataFrame, group: list[str], axes: list[str], size: str, target: str) -> DataFrame:
    """Exact bytes of every code, those before it on the curve, and the size of a file of its group."""
    histogram = coded.groupBy(*group, "curve_code").agg(F.sum(size).alias("__ks_bytes"), F.max(target).alias("__ks_wanted"))
    shift = max(0, CODE_BITS * len(axes) - 20)
    placed = written(with_running_total(histogram, group, "curve_code", "__ks_bytes", F.shiftright("curve_code", shift), "__ks_before"), "histogram")
    totals = placed.groupBy(*group).agg(F.sum("__ks_bytes").alias("__ks_total"), F.max("__ks_wanted").alias("__ks_wanted"))
    files = F.greatest(F.ceil(F.col("__ks_total") / F.col("__ks_wanted") - 0.2), F.lit(1))  # a last file of under a fifth is shared out
    totals = totals.select(*[F.col(g).alias(f"__ks_g{i}") for i, g in enumerate(group)], (F.col("__ks_total") / files).alias("__ks_target"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__ks_g{i}"))
    return placed.drop("__ks_wanted").join(totals, on).drop(*[f"__ks_g{i}" for i in range(len(group))])


def _row_targets(rows: DataFrame, group: list[str], axes: list[str], size: str, target: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """``assign_targets`` for rows that weigh nothing against a file, and the histogram it was cut from.

    Rows of one code are spread by the digest of ``tie`` over the stretch they fill. Where files begin on
    the curve is one row per file; up to ``MAX_BOUNDARIES`` they go to the tasks that compute the codes and
    rows are not shuffled here; beyond, rows are joined to the histogram.
    """
    coded = _coded(rows, axes)
    slot = F.pmod(F.xxhash64(tie), F.lit(SLOTS))
    placed = written(_histogram(coded, group, axes, size, target), "places")
    begins = F.ceil(F.col("__ks_before") / F.col("__ks_target"))
    ends = F.ceil((F.col("__ks_before") + F.col("__ks_bytes")) / F.col("__ks_target")) - 1
    starts = placed.filter(ends >= begins).withColumn("__ks_no", F.explode(F.sequence(begins, ends)))
    at = F.ceil((F.col("__ks_no") * F.col("__ks_target") - F.col("__ks_before")) / F.col("__ks_bytes") * SLOTS)
    starts = starts.select(F.to_json(F.struct(*group)).alias("g"), F.col("curve_code").alias("code"), at.alias("slot"))
    known = starts.limit(MAX_BOUNDARIES + 1).toPandas()
    if len(known) > MAX_BOUNDARIES:
        return _joined_targets(coded.withColumn("__ks_slot", slot), placed, group, spread=True), placed
    cuts = {}
    for g, x in known.groupby("g"):
        codes, rank = np.unique(x["code"].to_numpy(np.int64), return_inverse=True)
        cuts[g] = codes, np.sort(rank * 2 * SLOTS + x["slot"].to_numpy(np.int64))
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def number(groups: pd.Series, codes: pd.Series, slots: pd.Series) -> pd.Series:
        names, kinds = pd.factorize(groups)
        out, code, slot = np.empty(len(codes), np.int64), codes.to_numpy(np.int64), slots.to_numpy(np.int64)
        for i, g in enumerate(kinds):
            of = names == i
            begun, places = shared.value[g]
            rank = np.searchsorted(begun, code[of])
            own = begun[np.minimum(rank, len(begun) - 1)] == code[of]  # else the code is within one file
            out[of] = np.searchsorted(places, rank * 2 * SLOTS + np.where(own, slot[of], -1), side="right") - 1
        return pd.Series(out)

    return coded.withColumn("target_no", number(F.to_json(F.struct(*group)), F.col("curve_code"), slot)), placed


def _joined_targets(coded: DataFrame, placed: DataFrame, group: list[str], spread: bool = False) -> DataFrame:
    """Targets by a join of the items with the running totals of the histogram."""
    cols = [c for c in coded.columns if c not in ("curve_code", "__ks_slot")]
    placed = placed.select(*[F.col(g).alias(f"__ks_g{i}") for i, g in enumerate(group)], F.col("curve_code").alias("__ks_code"), "__ks_before", "__ks_bytes", "__ks_target")
    on = F.col("curve_code") == F.col("__ks_code")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__ks_g{i}"))
    share = F.col("__ks_slot") / SLOTS if spread else F.when(F.col("__ks_bytes") > F.col("__ks_target"), F.col("__ks_slot") / SLOTS).otherwise(0.5)
    position = F.col("__ks_before") + F.floor(F.col("__ks_bytes") * share)
    return coded.join(placed, on).select(*cols, "curve_code", F.floor(position / F.col("__ks_target")).alias("target_no"))


def name_number(name: Column) -> Column:
    """Position of an object in its folder's name order: the WAL id, or the time part of a sortable id."""
    digits = F.regexp_extract(name, r"^([0-9]{1,18})[0-9]*\.", 1)
    wal = F.regexp_extract(name, r"^0*([0-9]{1,18})\.sst$", 1)
    text = F.conv(F.substring(F.hex(F.substring(name, 1, 10)), 5, 14), 16, 10)
    return F.coalesce(F.nullif(wal, F.lit("")).try_cast("bigint"), F.nullif(digits, F.lit("")).try_cast("bigint"), text.try_cast("bigint"))


def plan_consolidation(listing: DataFrame, config: DataFrame) -> DataFrame:
    """Every small object with the target object it is gathered into.

    Objects are gathered per store, configuration and folder, along a Hilbert curve over their time and
    their place in the name order. Returns ``object_id, store_id, config_id, folder, path, size_bytes,
    block_size, curve_code, target_no``; each candidate stands in exactly one row. The plan is written, and
    whoever reads it compares it with the candidates: the objects and bytes that stand in a target, by
    count, digests and sum. A plan that lost, doubled or altered one fails the read.
    """
    small = written(small_objects(listing, config), "small-objects")
    timed = small.withColumn("__time", F.unix_micros(F.col("last_modified").cast("timestamp"))).withColumn("__name", name_number(F.col("name")))
    placed = assign_targets(timed, ["store_id", "config_id", "folder"], ["__time", "__name"], "size_bytes", "block_size", "object_id")
    plan = written(placed.select("object_id", "store_id", "config_id", "folder", "path", "size_bytes", "block_size", "curve_code", "target_no"), "plan").filter("curve_code is not null and target_no >= 0")
    whole = lambda df: row_digest(df, ["object_id", "size_bytes"], []).select(F.struct("rows", "xor_hash", "sum_hash").alias("d")).scalar()
    same = F.assert_true(whole(small).eqNullSafe(whole(plan)), F.lit("the plan does not hold the small objects"))
    return plan.filter(same.isNull())


def row_digest(df: DataFrame, columns: list[str], group: list[str], *more: Column) -> DataFrame:
    """Order-independent digest of rows: count, xor and sum of 64-bit row hashes, per ``group``.

    Equal multisets of rows give equal digests; a row lost, doubled or altered changes the count or one
    of the two hash folds. Nulls and empty values hash differently. ``more``: further aggregates.
    """
    h = F.xxhash64(*[x for c in columns for x in (F.col(c), F.isnull(c))])
    return df.withColumn("__h", h).groupBy(*group).agg(F.count("*").alias("rows"), F.bit_xor("__h").alias("xor_hash"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("sum_hash"), *more)


def consolidate_rows(rows: DataFrame, group: list[str], axes: list[str], size: str, target: str, tie: str, path: str) -> DataFrame:
    """Write rows as balanced, curve-clustered files below ``path`` and read them back.

    Every target is one file, whatever the number of tasks. A task takes consecutive targets of the curve,
    as many as fill ``TASK_BYTES`` when each file costs ``FILE_COST`` besides; where it begins follows from
    the exact histogram. Rows of a file stand in curve order; ``target_no`` and ``curve_code`` stay as
    columns so that a reader can verify the balance of the targets. Added when read back: ``file_path``
    and ``file_bytes``, the file a row was read from and its length.
    """
    spark = rows.sparkSession
    placed, histogram = _row_targets(rows, group, axes, size, target, tie)
    totals = histogram.groupBy(*group).agg(F.sum("__ks_bytes").alias("__ks_bytes"), F.max("__ks_target").alias("__ks_target"))
    totals = totals.withColumn("__ks_files", F.round(F.col("__ks_bytes") / F.col("__ks_target")).cast("bigint")).withColumn("__ks_load", F.least(F.ceil("__ks_target") + FILE_COST, F.lit(TASK_BYTES)).cast("bigint"))
    earlier = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)  # one row per group
    first = [F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(n) for x, n in ((F.col("__ks_files"), "__ks_first"), (F.col("__ks_files") * F.col("__ks_load"), "__ks_begin"))]
    named = [F.col(g).alias(f"__ks_g{i}") for i, g in enumerate(group)]
    begins = written(totals.select(*named, "__ks_files", "__ks_load", *first), "file-begins")
    load = begins.agg(F.sum(F.col("__ks_files") * F.col("__ks_load"))).first()[0] or 0
    tasks = load // TASK_BYTES + 1
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__ks_g{i}"))
    # numbers, so that no value of the data becomes the name of a folder
    part = F.floor((F.col("__ks_begin") + F.col("target_no") * F.col("__ks_load")) / TASK_BYTES).cast("int")
    out = placed.join(sent_if_small(begins.drop("__ks_files")), on).select(*placed.columns, part.alias("ks_part"), (F.col("__ks_first") + F.col("target_no")).alias("ks_file"))
    out = out.repartitionById(tasks, "ks_part").sortWithinPartitions("ks_part", "ks_file", "curve_code")
    out.write.mode("overwrite").partitionBy("ks_part", "ks_file").parquet(path)
    # as many tasks as wrote: Spark would read a few small files in each
    back = spark.read.schema(out.schema).parquet(path).select(*placed.columns, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_bytes"))
    return back.coalesce(tasks)
