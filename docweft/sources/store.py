"""Content-addressed documents: puts without duplicates, reads with re-verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_uploads(uploads: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """Uploads with their hash and whether they are already there: in the store, or earlier in the batch (by `position`)."""
    rows = uploads.withColumn("source_hash", F.sha2(content, 256))
    first = rows.groupBy("source_hash").agg(F.min("position").alias("_first"))
    rows = rows.join(first, "source_hash").join(stored.select("source_hash", F.lit(True).alias("_there")).distinct(), "source_hash", "left")
    return rows.withColumn("deduplicated", F.coalesce("_there", F.lit(False)) | (F.col("position") > F.col("_first"))).drop("_first", "_there")


def distinct_contents(df: DataFrame, key: str, content: str) -> DataFrame:
    """(source_hash, first, copies): content hashes with their smallest key; partial sums before the shuffle."""
    return df.groupBy(F.sha2(F.col(content), 256).alias("source_hash")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def write_store(new: DataFrame, path: str) -> None:
    """Appends contents under their hash's first two digits; Spark's commit makes the append atomic."""
    new.withColumn("prefix", F.substring("source_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def verified(stored: DataFrame, content: str = "content") -> DataFrame:
    """Adds intact: does the content still have the hash it is stored under?"""
    return stored.withColumn("intact", F.sha2(content, 256) == F.col("source_hash"))


def safe_relative(path: Column) -> Column:
    """A path that stays inside its root: relative, without parent steps or backslashes."""
    return F.coalesce(~path.rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)|\\"), F.lit(False))
