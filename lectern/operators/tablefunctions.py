"""Table functions for SQL.

``register`` gives a session ``chunk_text(TABLE(...))``: rows of documents in, rows of
chunks out. It takes each row where it stands, so nothing is shuffled unless the query
asks for it with ``PARTITION BY``.

The table has ``doc_id`` and ``parsed``, as ``parsed_view`` makes them from a text
column in the JVM; other columns are not read. A document without text gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lectern.operators.chunking import distinct_chunks, parsed_blocks


class ChunkText:
    """Chunks of a document: doc_id in its own type, chunk_index, heading_path, body and content."""

    @staticmethod
    def analyze(docs: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(docs.dataType, StructType) or not {"doc_id", "parsed"} <= set(docs.dataType.names):
            raise ValueError("chunk_text takes TABLE(...) with the columns doc_id and parsed")
        return AnalyzeResult(
            StructType().add("doc_id", docs.dataType["doc_id"].dataType).add("chunk_index", IntegerType())
            .add("heading_path", ArrayType(StringType())).add("body", StringType()).add("content", StringType())
        )

    def eval(self, docs):
        for at, chunk in enumerate(distinct_chunks(docs["parsed"] or [])):
            yield docs["doc_id"], at, [h["text"] for h in chunk["path"]], chunk["body"], chunk["content"]


def register(spark: SparkSession) -> None:
    """Make ``chunk_text`` known to the session's SQL."""
    spark.udtf.register("chunk_text", F.udtf(ChunkText))


def parsed_view(docs: DataFrame, view: str, text: str = "text") -> None:
    """A view of documents (doc_id and a text column) with their blocks, for ``chunk_text``."""
    docs.select("doc_id", parsed_blocks(F.col(text)).alias("parsed")).createOrReplaceTempView(view)
