"""``python -m keystrata``: put, get and delete a key in a table in a temporary folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from keystrata.sources.store import KeyedTable


def main() -> None:
    spark = SparkSession.builder.appName("keystrata").getOrCreate()
    schema = "key binary, kind tinyint, value binary, seq bigint"
    table = KeyedTable(spark, f"file://{tempfile.mkdtemp()}/demo")
    table.write(spark.createDataFrame([(b"key1", 0, b"value1", 1)], schema))
    print("put:", table.get(b"key1"))
    table.write(spark.createDataFrame([(b"key1", 1, None, 2)], schema))
    print("deleted:", table.get(b"key1"))
    table.close()


if __name__ == "__main__":
    main()
