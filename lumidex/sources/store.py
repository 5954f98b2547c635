"""A store of vectors by model and content key, and of what couldn't be read, as Parquet folders by model.

Defined results: a key that is put again keeps its newest vector; a key that was skipped is not asked for
again until it is put; an empty or missing store gives an empty table; other models' vectors are never read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "key string, embedding array<float>, at timestamp"


def put(found: DataFrame, root: str, model: str) -> None:
    """Add (key, embedding); a null embedding says that the file can't be read."""
    rows = found.select("key", F.col("embedding").cast("array<float>").alias("embedding"), F.current_timestamp().alias("at"))
    rows.write.mode("append").parquet(f"{root}/model={model}")


def get(spark: SparkSession, root: str, model: str) -> DataFrame:
    """(key, embedding), the newest of each key; embedding is null where the file couldn't be read."""
    try:
        rows = spark.read.schema(VECTORS).parquet(f"{root}/model={model}")
    except AnalysisException:
        return spark.createDataFrame([], "key string, embedding array<float>")
    return rows.groupBy("key").agg(F.max_by("embedding", F.struct(F.col("at"), F.col("embedding").isNotNull().alias("there"))).alias("embedding"))


def missing(files: DataFrame, root: str, model: str) -> DataFrame:
    """The files of which the store knows nothing yet, newest first."""
    return files.join(get(files.sparkSession, root, model).select("key"), "key", "left_anti").orderBy(F.desc("mtime"), "key")


def forget_others(spark: SparkSession, root: str, model: str) -> list[str]:
    """Remove all vectors of other models; gives the names of those removed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs, gone = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for s in fs.listStatus(path) if fs.exists(path) else []:
        name = s.getPath().getName()
        if name.startswith("model=") and name != f"model={model}":
            fs.delete(s.getPath(), True)
            gone.append(name[6:])
    return gone
