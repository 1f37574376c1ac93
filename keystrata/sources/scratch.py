"""Folders shared by driver and executors, for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Memory that a table sent to every task may take.
SENT_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent on a single machine a temporary folder is made once per session and
    remembered in the session's runtime configuration. On a cluster its absence is an error: a folder of
    one machine would hold only the part of a table that this machine wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = f"file://{tempfile.mkdtemp(prefix='keystrata-')}"
        _path(spark, named)[0].deleteOnExit(_path(spark, named)[1])
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one, deleted when the application ends."""
    name = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = _path(spark, name)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return name


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends at files every executor reaches.

    The files last until the application ends: whoever reads the result may run again after a loss.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark, label)}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame):
    """Upper bound of the bytes of a row in memory: eight for every column and the row's own, and what varies."""
    varies = [c.name for c in df.schema if isinstance(c.dataType, (StringType, BinaryType))]
    if any(isinstance(c.dataType, (ArrayType, MapType, StructType)) for c in df.schema):
        raise ValueError("only plain columns have a known width")
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) + 8 for c in varies), F.lit(8 * (len(df.columns) + 4)))


def sent_if_small(df: DataFrame, max_bytes: int = SENT_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its rows take at most ``max_bytes``; else as it is.

    The bytes are those of all rows in memory, counted; a larger table is joined by a shuffle.
    """
    size = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
