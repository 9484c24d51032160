"""Row updates expressed as new result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed


def requeue_by_name(catalog: DataFrame, chunks: DataFrame, fragment: str) -> DataFrame:
    """Queue again every document whose name holds the fragment; report its old chunks."""
    chosen = catalog.filter(F.col("doc_name").ilike(f"%{fragment}%"))
    counts = (
        chunks.select("doc_id").join(chosen.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    )
    return chosen.join(counts, "doc_id", "left").select(
        "doc_id", F.lit("QUEUED").alias("status"), F.col("status").alias("old_status"),
        F.coalesce("n", F.lit(0)).alias("old_chunk_count"),
    )


def latest_status(events: DataFrame, key: str, time: str, status: str, tie: str) -> DataFrame:
    """Current status per document: the newest event, larger ``tie`` first among equals."""
    newest = F.max_by(F.struct(F.col(status).alias("status"), F.col(time).alias("at")), F.struct(time, tie))
    return events.groupBy(key).agg(newest.alias("r"), F.count(F.lit(1)).alias("events")).select(
        key, "r.status", "r.at", "events"
    )


def retry_decision(events: DataFrame, key: str, failed: Column, max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Attempts per document and whether it is queued again."""
    return events.groupBy(key).agg(F.count_if(failed).alias("attempts")).withColumn(
        "decision",
        F.when(F.col("attempts") == 0, "none").when(F.col("attempts") < max_attempts, "QUEUED").otherwise("FAILED"),
    )


def stalled(events: DataFrame, key: str, time: str, status: str, tie: str, terminal: list[str], as_of: Column) -> DataFrame:
    """Documents in a non-terminal status without an event for 15 minutes."""
    current = latest_status(events, key, time, status, tie)
    late = F.col("at") < as_of - F.expr(f"interval {fixed.STALL_MINUTES} minutes")
    return current.filter(~F.col("status").isin(terminal) & late)


def partial_update(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Apply changes (one row per key); a field left null is not changed."""
    new = changes.select(key, *[F.col(f).alias(f"__n_{f}") for f in fields])
    joined = rows.join(new, key, "left")
    merged = {f: F.coalesce(F.col(f"__n_{f}"), F.col(f)) for f in fields}
    return joined.withColumns(merged).drop(*[f"__n_{f}" for f in fields])


def next_versions(updates: DataFrame, lineage: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """Version number of each appended row in its lineage, from 1."""
    from lectern.operators.split_windows import positions

    return positions(updates, lineage, order, bucket, "version")
