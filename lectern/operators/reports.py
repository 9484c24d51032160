"""Catalog counts and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_counts(catalog: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row of counts; each table is read once and reduced before anything meets."""
    zero = F.lit(0).cast("bigint")
    docs = catalog.agg(
        F.count(F.lit(1)).alias("documents"), zero.alias("chunks"), zero.alias("embeddings"),
        F.count_if(F.col("status") == "READY").alias("ready"),
        F.count_if(~F.col("status").isin("READY", "FAILED")).alias("pending"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
    )

    def counted(df: DataFrame, name: str) -> DataFrame:
        names = ["documents", "chunks", "embeddings", "ready", "pending", "failed"]
        return df.agg(*[(F.count(F.lit(1)) if n == name else F.max(zero)).alias(n) for n in names])

    parts = docs.unionByName(counted(chunks, "chunks")).unionByName(counted(embeddings, "embeddings"))
    return parts.agg(*[F.sum(F.coalesce(c, zero)).alias(c) for c in parts.columns])


def joined_text(chunks: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Each document's chunks as one text. A document is bounded by the upload limit."""
    return chunks.groupBy(key).agg(
        F.expr(f"listagg({content}, '\\n\\n') WITHIN GROUP (ORDER BY {order})").alias("text"),
        F.sum(F.length(content)).cast("bigint").alias("n_chars"),
    )


def section_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per document and section (``metadata`` as made by the chunker)."""
    section = F.coalesce("metadata.section_number", "metadata.section_title", F.lit("(unsectioned)"))
    return chunks.groupBy("doc_id", section.alias("section")).agg(F.count(F.lit(1)).alias("chunks"))


def latency_report(events: DataFrame, keys: list[str], success: Column, value: Column) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count_if(success).alias("successes"), F.round(F.avg(value), 6).alias("mean_value"), F.max(value).alias("max_value")
    )


def missing_names(found: DataFrame, key: str, name: str, required: list[str]) -> DataFrame:
    """Required names that a group lacks. Only required names are kept while grouping."""
    wanted = F.array(*[F.lit(r) for r in required])
    have = F.collect_set(F.when(F.col(name).isin(required), F.col(name)))
    return found.groupBy(key).agg(F.array_join(F.sort_array(F.array_except(wanted, have)), ",").alias("missing"))
