"""Index tables filed by (dir, name): rows of a path are always in the same bucket and sorted there.

Joins of such a table on its key read it as it lies; only what it is joined with is dealt out by the key. The
number of buckets is fixed when a table is written; a bucket should hold some hundreds of megabytes. Files of a bucket
tell its number by their names, so a table can be opened by any session that knows folder, columns and buckets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["dir", "name"]
BUCKETS = 16


def _name(path: str) -> str:
    return f"lumidex_index_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def save(index: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write an index to a folder of its own and open it. Each bucket is one sorted file."""
    spark = index.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    dealt = index.repartition(buckets, *KEY)
    dealt.write.mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(_name(path))
    return spark.table(_name(path))


def load(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """Open an index that another session has written."""
    if not spark.catalog.tableExists(_name(path)):
        spark.sql(f"CREATE TABLE {_name(path)} ({schema}) USING parquet CLUSTERED BY (dir, name) SORTED BY (dir, name) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))


def forget(spark: SparkSession, path: str) -> None:
    """Close a table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")


def changes(path: str, records: DataFrame, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """dir, name and change of a listing against a stored index (see `operators.tables.difference`)."""
    from ..operators import tables

    return tables.difference(load(records.sparkSession, path, schema, buckets), records.select(*KEY, F.col("size"), F.col("mtime")))
