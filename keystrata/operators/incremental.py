"""Processing only new or changed records.

A table version is a manifest of immutable files. The difference of two manifests (files added, files
removed, files whose content was replaced, which is a removal and an addition under one name, files with
another deletion vector) is what a run has to process, as files or as inserted and deleted records.
``visible_changes`` computes that difference for a whole log of consumer runs at once;
``IncrementalTable`` performs runs and keeps the processed version inside the commit of their output.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.operators.ordering import week, with_next_event, with_previous
from keystrata.sources.objects import ObjectFolder

#: Every so many commits one holds all before it.
CHECKPOINT = 50
#: WAL ids are joined to run intervals through ranges of this many ids.
ID_RANGE = 256


def visible_changes(files: DataFrame, runs: DataFrame) -> DataFrame:
    """File deltas that every committed run has to process.

    ``files``: ``store_id, id, last_modified, checksum``, one row per stored version of a file; repeated
    rows count once, rows without store, id or time never. ``runs``: ``run_id, store_id, started_at,
    status, next_wal_sst_id``; repeated rows count once and only committed runs with a start count, in the
    order of (started_at, run_id). A run sees of each id below its ``next_wal_sst_id`` (none when it is
    null) the version with the greatest ``last_modified`` not after its start; of several versions at one
    time the greatest checksum. A null checksum equals only a null checksum.

    What a run sees is its manifest. The manifests of a run and of the store's previous committed run are
    built for the names they can differ in (ids between the two counters, and ids with a version that
    arrived between the two starts) and diffed by ``signed_delta``, all runs at once.

    Returns ``store_id, run_id, wal_id, change``: ``added`` (not seen by the store's previous committed
    run), ``replaced`` (seen with another checksum) or ``removed`` (seen by that run and no longer), each
    at most once per run and id. A store's first committed run has an empty manifest before it.
    """
    versions = files.select("store_id", F.col("id").alias("wal_id"), "last_modified", "checksum").dropna(subset=["store_id", "wal_id", "last_modified"]).distinct()
    done = runs.filter("status = 'committed'").select("store_id", "run_id", "started_at", F.col("next_wal_sst_id").alias("upto")).dropna(subset=["store_id", "started_at"]).distinct()
    done = with_previous(done, ["store_id"], ["started_at", "run_id"], ["started_at", "upto"], week(F.col("started_at")), "before")
    done = done.select("store_id", "run_id", "started_at", "upto", F.col("before.started_at").alias("before_at"), F.coalesce(F.col("before.upto"), F.lit(-(2**62)).cast("bigint")).alias("before_upto"))

    # (1) ids that come into sight or leave it: those between the two runs' counters, clipped to ids that exist
    extent = versions.groupBy("store_id").agg(F.min("wal_id").alias("lo"), F.max("wal_id").alias("hi"))
    least = F.lit(-(2**62)).cast("bigint")
    moved = done.select("store_id", "run_id", F.least(F.coalesce("upto", least), "before_upto").alias("from"), F.greatest(F.coalesce("upto", least), "before_upto").alias("to"))
    opened = moved.join(extent, "store_id").select("store_id", "run_id", F.greatest("from", "lo").alias("lo"), F.least(F.col("to") - 1, F.col("hi")).alias("hi")).filter("hi >= lo")
    opened = opened.withColumn("__range", F.explode(F.sequence(F.floor(F.col("lo") / ID_RANGE), F.floor(F.col("hi") / ID_RANGE))))
    ids = versions.select("store_id", "wal_id", F.floor(F.col("wal_id") / ID_RANGE).alias("__range")).distinct()
    in_sight = opened.join(ids, ["store_id", "__range"]).filter("wal_id between lo and hi").select("store_id", "run_id", "wal_id")

    # (2) content that arrived: the first committed run that starts at or after it
    arrived = with_next_event(versions.select("store_id", "wal_id", "last_modified"), "last_modified", done, "started_at", ["store_id"], ["run_id"], week, "run").select("store_id", F.col("run.run_id").alias("run_id"), "wal_id").filter("run_id is not null")

    # the two manifests of every run, without the names for which both say the same anyway
    touched = in_sight.unionByName(arrived).distinct().join(done, ["store_id", "run_id"])
    entry = F.struct("last_modified", "checksum")
    listed = touched.join(versions, ["store_id", "wal_id"]).groupBy("store_id", "run_id", "wal_id").agg(
        F.max(F.when((F.col("last_modified") <= F.col("before_at")) & (F.col("wal_id") < F.col("before_upto")), entry)).alias("was"),
        F.max(F.when((F.col("last_modified") <= F.col("started_at")) & (F.col("wal_id") < F.col("upto")), entry)).alias("now"),
    )
    side = lambda sign, e: F.struct(F.lit(sign).alias("sign"), e.isNotNull().alias("stands"), e["checksum"].alias("checksum"))
    manifests = listed.select("store_id", "run_id", "wal_id", F.explode(F.array(side(-1, F.col("was")), side(1, F.col("now")))).alias("m")).select("store_id", "run_id", "wal_id", "m.*").filter("stands")
    return signed_delta(manifests, ["store_id", "run_id", "wal_id"], "checksum")


def signed_delta(manifests: DataFrame, name: list[str], version: str, vector: Column | None = None) -> DataFrame:
    """Differences of any number of pairs of manifests: ``name, change``.

    One row per file of a manifest: ``name`` (with whatever tells the pairs apart), ``version`` and ``sign``,
    -1 in the manifest before and 1 in the one after. ``vector`` gives the deletion vector. Repeated rows
    count once; files equal on both sides give no row.
    """
    item = F.struct(F.col(version).alias("v"), (vector if vector is not None else F.array().cast("array<bigint>")).alias("d"))
    both = manifests.groupBy(*name).agg(F.max(F.when(F.col("sign") < 0, item)).alias("__was"), F.max(F.when(F.col("sign") > 0, item)).alias("__now"))
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__now").isNull(), "removed").when(~F.col("__was.v").eqNullSafe(F.col("__now.v")), "replaced").when(F.col("__was.d") != F.col("__now.d"), "masked")
    return both.select(*name, change.alias("change")).filter("change is not null")


def manifest_delta(before: DataFrame, after: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Difference of two manifests (one row per file): ``name, change`` with added, removed, replaced or masked.

    ``masked`` means the same content with another deletion vector (optional column ``deleted_rows``,
    an array of row positions). Unchanged files give no row; repeated rows count once.
    """
    none = F.array().cast("array<bigint>")
    side = lambda m, sign: m.select(name, version, F.array_sort(F.coalesce(F.col("deleted_rows"), none) if "deleted_rows" in m.columns else none).alias("__d"), F.lit(sign).alias("sign"))
    return signed_delta(side(before, -1).unionByName(side(after, 1)), [name], version, F.col("__d"))


def record_delta(before: DataFrame, after: DataFrame, records, name: str = "name", version: str = "version", position: str = "position") -> DataFrame:
    """Records inserted and deleted between two manifests: the columns of the records and ``change``.

    ``records(files)`` reads files given by ``name, version`` (those that changed, each once) and returns
    their records with ``name, version, position`` and any others; ``position`` is the row's place in its
    file, which the deletion vectors name. A record counts where its file stands in the manifest and its
    vector does not name it. ``change`` is ``inserted`` or ``deleted``; of a masked file only records whose
    mark differs are returned. Records of a replaced file that are equal but for version and position
    cancel, copy by copy. The other columns must be of types that can be grouped.
    """
    changed = manifest_delta(before, after, name, version).select(F.col(name).alias("__n"))

    def side(manifest: DataFrame, sign: int) -> DataFrame:
        vector = F.coalesce(F.col("deleted_rows"), F.array().cast("array<bigint>")) if "deleted_rows" in manifest.columns else F.array().cast("array<bigint>")
        rows = manifest.select(F.col(name).alias("__n"), F.col(version).alias("__v"), F.array_sort(vector).alias("__gone"), F.lit(sign).alias("__sign")).distinct()
        return rows.join(changed.distinct(), "__n")

    sides = side(before, -1).unionByName(side(after, 1))
    rows = records(sides.select(F.col("__n").alias(name), F.col("__v").alias(version)).distinct())
    here = (F.col(name) == F.col("__n")) & F.col(version).eqNullSafe(F.col("__v"))
    standing = rows.join(sides.groupBy("__n", "__v").agg(F.sum("__sign").alias("__sign")), here).drop("__n", "__v")
    gone = sides.select("__n", "__v", F.explode(F.array_distinct("__gone")).alias("__p"), "__sign").groupBy("__n", "__v", "__p").agg(F.sum("__sign").alias("__less"))
    standing = standing.join(gone, here & (F.col(position) == F.col("__p")), "left").withColumn("__sign", F.col("__sign") - F.coalesce("__less", F.lit(0))).filter("__sign <> 0")
    content = [name, *[c for c in rows.columns if c not in (name, version, position)]]
    copies = standing.withColumn("__copy", F.row_number().over(Window.partitionBy(*content, "__sign").orderBy(position)))
    net = copies.groupBy(*content, "__copy").agg(F.sum("__sign").alias("__sign"), F.first(version).alias(version), F.first(position).alias(position)).filter("__sign <> 0")
    return net.select(*rows.columns, F.when(F.col("__sign") > 0, "inserted").otherwise("deleted").alias("change"))


class IncrementalTable:
    """Output table of an incremental job: data folders plus a numbered commit log.

    A run writes its rows to a folder of its own and the manifest it processed beside it, then creates
    the next commit, one small file naming both. Creation fails if the number is taken, so of two runs at
    once one wins. A run that dies before its commit leaves folders no commit names; readers and the next
    run never look at them, so nothing is skipped and nothing is applied twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = ObjectFolder(spark, f"{self.root}/_commits")

    def commits(self) -> list[dict]:
        """All commits in order. Every ``CHECKPOINT``-th holds those before it, so few objects are read."""
        names = [n for n in sorted(self.log.names()) if n.endswith(".json")]
        whole = [n for n in names if int(n[:20]) % CHECKPOINT == 0]
        out: list[dict] = []
        for n in [x for x in names if not whole or x >= whole[-1]]:
            commit = json.loads(self.log.read(n))
            out += commit.pop("earlier", []) + [commit]
        return out

    def run(self, manifest: DataFrame, process, run_id: str, records=None) -> DataFrame | None:
        """Process what changed since the last commit; returns the delta, or None if nothing changed.

        ``manifest``: ``name, version`` and optionally ``deleted_rows``. ``process(delta)`` returns the
        output rows for the changed files. A ``run_id`` already committed is not run again.

        With ``records`` (see ``record_delta``) ``process`` gets the inserted and deleted records instead.
        It must make each row from one record, always the same, and keep ``change``: the rows it makes of
        a deleted record take back those made when it was inserted. Without, no output is ever taken back.
        """
        done = self.commits()
        if any(c["run_id"] == run_id for c in done):
            return None
        here = f"{self.root}/_versions/{run_id}"
        manifest.write.mode("overwrite").parquet(here)
        now = self.spark.read.parquet(here)
        before = self.spark.read.parquet(f"{self.root}/{done[-1]['version']}") if done else now.limit(0)
        delta = manifest_delta(before, now)
        if delta.isEmpty():
            return None
        process(delta if records is None else record_delta(before, now, records)).write.mode("overwrite").parquet(f"{self.root}/data/{run_id}")
        number = len(done) + 1
        commit = {"number": number, "run_id": run_id, "version": f"_versions/{run_id}", "data": f"data/{run_id}", "signed": records is not None}
        self.log.create(f"{number:020d}.json", json.dumps({**commit, "earlier": done} if number % CHECKPOINT == 0 else commit))
        return delta

    def read(self) -> DataFrame | None:
        """Output of all commits; rows of runs over records without those deleted since, and without ``change``."""
        commits = self.commits()
        plain = [f"{self.root}/{c['data']}" for c in commits if not c.get("signed")]
        signed = [f"{self.root}/{c['data']}" for c in commits if c.get("signed")]
        out = self.spark.read.parquet(*plain) if plain else None
        if signed:
            rows = self.spark.read.parquet(*signed)
            columns = [c for c in rows.columns if c != "change"]
            net = rows.groupBy(*columns).agg(F.sum(F.when(F.col("change") == "inserted", 1).otherwise(-1)).alias("__n")).filter("__n > 0")
            net = net.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), "__n"))).select(*columns)
            out = net if out is None else out.unionByName(net, allowMissingColumns=True)
        return out
