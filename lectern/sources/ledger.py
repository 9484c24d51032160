"""A store of tables that grows by batches, with a ledger that says which batches count.

A table lies in folders by ``bucket`` of its key and, in each, by ``batch``. A batch
writes its rows of all tables first and its ledger row last; readers see only batches
with a ledger row, so a batch is in all tables or in none. A batch that broke off is run
again under its number and overwrites what it had left. One that counts already is not
run again.

An append looks for known keys in the buckets it touches and lists and reads no other
folder. With ``buckets`` set to the store's expected keys over some thousands, what a
batch costs does not depend on what is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import _has_data, bucket_of

BUCKETS = 64


def counts(spark: SparkSession, store: str, batch: int) -> bool:
    return _has_data(spark, f"{store}/ledger/batch={batch}")


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """One row for each batch that counts (batch and the caller's own columns)."""
    return spark.read.option("basePath", f"{store}/ledger").parquet(f"{store}/ledger")


def stored_rows(spark: SparkSession, store: str, table: str, buckets: list[int] | None = None) -> DataFrame | None:
    """Rows of the batches that count, of all or of given buckets; None where there is no such folder."""
    root = f"{store}/{table}"
    if not _has_data(spark, f"{store}/ledger"):
        return None
    folders = [root] if buckets is None else [f"{root}/bucket={b}" for b in buckets]
    folders = [f for f in folders if _has_data(spark, f)]
    if not folders:
        return None
    rows = spark.read.option("basePath", root).parquet(*folders)
    # Both columns are folders: batches without a ledger row are not even opened.
    return rows.join(ledger(spark, store).select("batch"), "batch", "left_semi")


def unknown_rows(incoming: DataFrame, store: str, table: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Incoming rows whose key is not stored, from the touched buckets alone."""
    spark = incoming.sparkSession
    # At most ``buckets`` numbers.
    touched = [r[0] for r in incoming.select(bucket_of(key, buckets)).distinct().collect()]
    known = stored_rows(spark, store, table, touched)
    return incoming if known is None else incoming.join(known.select(key), key, "left_anti")


def write_rows(rows: DataFrame, store: str, table: str, key: str, batch: int, buckets: int = BUCKETS) -> None:
    """A batch's rows of one table; a second run of the batch replaces those of the first."""
    placed = rows.withColumns({"bucket": bucket_of(key, buckets), "batch": F.lit(batch)})
    (
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "batch").parquet(f"{store}/{table}")
    )


def run_batch(spark: SparkSession, store: str, batch: int, write: Callable[[], DataFrame]) -> bool:
    """Run ``write``, which writes a batch's tables and returns its ledger row; False if the batch counts already."""
    if counts(spark, store, batch):
        return False
    # One file, put in place by a rename: the batch counts from here on.
    write().coalesce(1).write.mode("overwrite").parquet(f"{store}/ledger/batch={batch}")
    return True
