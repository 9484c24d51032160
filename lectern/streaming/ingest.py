"""Incremental corpus ingest: new files become documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog as C
from lectern.operators.chunking import chunk_documents
from lectern.operators.embed import embed_pending
from lectern.session import kept
from lectern.sources import ledger
from lectern.sources.files import file_texts

MODEL, VERSION = "word-hash", "1"


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files under a folder as rows."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    )


def ingest_batch(files: DataFrame, store: str, org: str, embed, batch: int, buckets: int = ledger.BUCKETS) -> bool:
    """Validate, deduplicate, extract by type, chunk, embed and append one batch of files.

    A document is READY with at least one chunk, else FAILED; a damaged file is a
    FAILED row and stops nothing. The batch's ledger row is written last: a batch that
    broke off counts for nothing until it is run again under its number.
    """
    return ledger.run_batch(files.sparkSession, store, batch, lambda: _write_batch(files, store, org, embed, batch, buckets))


def _write_batch(files: DataFrame, store: str, org: str, embed, batch: int, buckets: int) -> DataFrame:
    def write(rows: DataFrame, table: str, key: str) -> None:
        ledger.write_rows(rows, store, table, key, batch, buckets)

    named = files.select(
        F.col("path").alias("raw_name"), "path", F.col("content").alias("bytes"), F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), F.lit(org).alias("org_id"), F.lit(None).cast("string").alias("declared_mime"),
    )
    checked = C.checked_uploads(named)
    rejected = checked.filter("not accepted").select("path", "name", F.array_join("errors", "; ").alias("reason"))
    accepted = checked.filter("accepted")
    first = accepted.groupBy("org_id", "sha256").agg(F.min("path").alias("path"))
    # A tenant and a content make the id, so known contents are known ids.
    first = first.withColumn("id", C.document_id(F.col("org_id"), F.col("sha256")))
    first = ledger.unknown_rows(first, store, "documents", "id", buckets)
    # Read four times below; the bytes are fetched and hashed once.
    fresh = kept(accepted.join(first.select("path", "sha256").distinct(), ["path", "sha256"], "left_semi").dropDuplicates(["path"]), "fresh")
    rows = C.document_rows(fresh)
    # No filter on texts: it would be pushed into their making and make them twice. A null text has no chunk.
    texts = file_texts(fresh.select("name", "bytes", C.document_id(F.col("org_id"), F.col("sha256")).alias("doc_id")))
    chunks = kept(chunk_documents(texts), "chunks")
    write(chunks, "chunks", "doc_id")
    # A file without a chunk was not read: its status says so.
    read = chunks.select(F.col("doc_id").alias("id")).distinct().withColumn("status", F.lit("READY"))
    done = rows.drop("status").join(read, "id", "left").withColumn("status", F.coalesce("status", F.lit("FAILED")))
    write(embed_pending(chunks, None, MODEL, VERSION, embed), "embeddings", "chunk_id")
    write(ledger.unknown_rows(rejected.dropDuplicates(["path"]), store, "rejected", "path", buckets), "rejected", "path")
    write(done.select(*rows.columns), "documents", "id")
    # Counted by a plan without groups, so that an empty batch has a row, too.
    row = fresh.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return row.withColumn("chunks", F.lit(chunks.count()))


def start_ingest(files: DataFrame, store: str, checkpoint: str, org: str, embed, buckets: int = ledger.BUCKETS):
    """Run the ingest on a stream of files until what is there has been read."""
    return (
        files.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, store, org, embed, number, buckets) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
