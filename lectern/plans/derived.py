"""The reference tables of the system, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registry import table


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a tenant and a file name."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("org_id"),
        F.concat_ws(" ", "lang", "source", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("doc_name"),
        "lang", "text", "n_chars",
    )


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line of a document, as stored chunks."""
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
        .select(
            F.concat(F.col("doc_id"), F.lit("_v1_chunk_"), F.col("chunk_index")).alias("chunk_id"),
            "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content",
        )
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows; the label of a document stands for its processing status."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "READY").when(F.col("quality") == 0, "FAILED").otherwise("QUEUED")
    return (
        docs(spark, folder)
        .join(labels, "doc_id", "left")
        .select("doc_id", "org_id", "doc_name", F.col("n_chars").alias("size_bytes"), status.alias("status"))
    )


UPLOAD_EXTENSIONS = ["exe", "bin", "PDF"]


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Upload rows from the part table: odd names, empty and oversized files, repeats."""
    from lectern.functions import fixed

    endings = F.array(*[F.lit(e) for e in fixed.SUPPORTED_EXTENSIONS + UPLOAD_EXTENSIONS])
    key = F.col("p_partkey")
    dots = F.when(key % 11 == 0, "..").otherwise("")
    name = F.concat(
        F.lit("/srv/in box/"), F.col("p_name"), dots, F.lit("\t v"), F.col("p_size"), F.lit("  ."),
        F.get(endings, (key % len(fixed.SUPPORTED_EXTENSIONS + UPLOAD_EXTENSIONS)).cast("int")),
    )
    size = (
        F.when(key % 17 == 0, F.lit(0))
        .when(key % 13 == 0, F.lit(52428801) + key * 1013)
        .otherwise(F.col("p_size") * 1000 + key)
    )
    return table(spark, folder, "part").select(
        key.alias("file_id"),
        F.concat(F.lit("org"), key % 3).alias("org_id"),
        F.when(key % 53 == 0, F.lit("/srv/x/\x01..")).otherwise(name).alias("raw_name"),
        size.cast("bigint").alias("size_bytes"),
        F.sha2(F.concat_ws("|", "p_name", "p_size"), 256).alias("sha256"),
        F.when(key % 3 == 0, "application/x-upload").alias("declared_mime"),
    )


# Turns in front of the user texts; the second value is the format a reader expects.
UTTERANCES = [
    ("Create a PDF report about", "pdf"),
    ("Explain the idea of", "none"),
    ("Convert that to Excel.", "xlsx"),
    ("Now make it a PDF.", "pdf"),
    ("Now show it as a diagram.", "svg"),
    ("Summarize this in 50 words.", "none"),
    ("Give me the data as CSV.", "csv"),
    ("Download the presentation.", "pptx"),
    ("Explain each feature of the above.", "none"),
    ("Based on the information, create a flow diagram.", "svg"),
    ("Show the system architecture in navy for management.", "svg"),
    ("Make that professional.", "none"),
    ("What is written in en src about", "none"),
    ("Put the numbers into a green spreadsheet.", "xlsx"),
    ("Is there a chart of the last quarter?", "none"),
    ("Generate a Word document to download and send.", "docx"),
    ("Create a minimal timeline diagram of", "svg"),
    ("Rewrite it.", "none"),
]


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with answer ids, sources, topics and realistic openings."""
    conv, turn = F.col("conv_id"), F.col("turn")
    is_user, is_assistant = F.col("role") == "user", F.col("role") == "assistant"
    opening = F.get(F.array(*[F.lit(u) for u, _ in UTTERANCES]), ((conv * 5 + turn) % len(UTTERANCES)).cast("int"))
    answered = is_assistant & ((conv + turn) % 4 != 3)
    content = (
        F.when(is_user, F.concat_ws(" ", opening, "text"))
        .when(is_assistant & ((conv + turn) % 6 == 5), F.concat_ws(" ", F.lit("I cannot answer that."), "text"))
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("m"), conv, F.lit("_"), turn).alias("message_id"), "conv_id", "turn", "role", content.alias("content"),
        F.when(answered, F.concat(F.lit("a"), conv, F.lit("_"), turn)).alias("answer_id"),
        F.when(answered & ((conv + turn) % 3 == 0), F.array(conv * 7 + turn)).otherwise(F.array().cast("array<bigint>")).alias("source_doc_ids"),
        F.when(answered & ((conv + turn) % 5 < 2), F.concat(F.lit("topic "), conv % 10)).alias("topic"),
    )
