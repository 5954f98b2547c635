"""Small helpers that several text operators use."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_dir

__all__ = ["cut", "fresh", "held_out", "labelled", "numbered", "shared_dir", "stored", "table"]


def fresh(spark: SparkSession, name: str, ending: str = ".parquet") -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}{ending}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder once and read it back."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Numbered:
    """Rows under names of their own, c0, c1 and so on, with a number `row`, so that no column of the input can clash with another."""

    rows: DataFrame
    columns: list[str]

    def at(self, column: str) -> Column:
        return F.col(f"c{self.columns.index(column)}")

    def back(self, rows: DataFrame) -> DataFrame:
        """Some of the rows, as they were."""
        return rows.select(*[f"c{k}" for k in range(len(self.columns))]).toDF(*self.columns)


def numbered(docs: DataFrame, name: str) -> Numbered:
    """Write a table once, with a number for each row: ids may repeat or be null."""
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).withColumn("row", F.monotonically_increasing_id())
    return Numbered(stored(own, name), list(docs.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, parts: int, remainder: int):
    """Whether crc32 of the id's decimal text leaves `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == remainder, F.lit(False))


def labelled(spark: SparkSession, sf_dir: str, label: str, parts: int, remainder: int, most: int, most_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, text, y, held) of `most` documents and about `most_bytes` bytes of text at most: those that have the label and aren't held out.

    Which ones is decided by a hash of the id; repeated labels of an id count once, by their maximum, repeated documents of
    an id by their least text, so `most` bounds the rows as well.
    The list of ids is bounded by `most`, so it is broadcast to the documents. `held` marks one row in five for calibration.
    The rows are written to the shared folder once, and read from there however often they are used.
    """
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), parts, remainder))
    labels = labels.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    mark, n = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), labels.count()
    upto = min(1 << 30, int(0.95 * most / n * (1 << 30))) if n > most else 1 << 30
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    some = docs.join(F.broadcast(labels.where(mark < upto).limit(most)), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    some = some.select("doc_id", "text", "y", (F.crc32(F.concat(F.lit("h"), F.col("doc_id").cast("string"))) % 5 == 0).alias("held"))
    some = stored(some, f"labelled-{label}")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return some.where(mark < int(upto * most_bytes / size)) if size > most_bytes else some
