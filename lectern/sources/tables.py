"""Table sinks: append what is absent, replace what is touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import scratch_path


def replaced_rows(stored: DataFrame, fresh: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of the touched keys swapped for fresh ones."""
    return stored.join(touched.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*stored.columns))


def append_absent(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str]) -> None:
    """Append rows whose keys are not stored yet. A repeated run changes nothing."""
    if _has_data(spark, path):
        stored = spark.read.parquet(path).select(*keys)
        incoming = incoming.join(stored, keys, "left_anti")
    incoming.dropDuplicates(keys).write.mode("append").parquet(path)


def replace_in_partitions(
    spark: SparkSession, path: str, fresh: DataFrame, touched: DataFrame, key: str, partition: str
) -> None:
    """Rewrite only the partitions that hold touched keys.

    The input is also the output, so the new rows are staged in the shared
    folder first. Untouched partitions are neither read nor written.
    """
    stored = spark.read.parquet(path)
    parts = touched.select(partition).distinct()
    affected = stored.join(parts, partition, "left_semi")
    staged = scratch_path(spark, "replace")
    replaced_rows(affected, fresh, touched, key).write.mode("overwrite").parquet(staged)
    (
        spark.read.schema(stored.schema).parquet(staged).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )


def _has_data(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop.Path(path, "_SUCCESS")) or (fs.exists(target) and len(fs.listStatus(target)) > 0)


def bucket_of(key, buckets: int):
    """Partition column for tables keyed by document."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
