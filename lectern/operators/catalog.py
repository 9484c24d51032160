"""Upload checks, catalog rows and catalog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T


def safe_name(raw: Column) -> Column:
    base = F.element_at(F.split(raw, "/"), -1)
    out = F.regexp_replace(base, F.lit(r"[\x00-\x1f\x7f]"), F.lit(""))
    out = T.collapse(F.replace(out, F.lit(".."), F.lit("")))
    return F.coalesce(T.blank_to_null(out), F.lit("unnamed_file"))


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def unit_label(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, members in fixed.UNIT_LABELS.items():
        out = F.coalesce(out, F.when(ext.isin(members), F.lit(label)))
    return F.coalesce(out, F.lit(fixed.DEFAULT_UNIT))


def mime_type(ext: Column, declared: Column | None = None) -> Column:
    """MIME type of an extension, from a literal map: no join, nothing to broadcast."""
    known = F.create_map(*[F.lit(x) for pair in fixed.MIME_TYPES.items() for x in pair])[ext]
    parts = [known] + ([declared] if declared is not None else []) + [F.lit(fixed.DEFAULT_MIME)]
    return F.coalesce(*parts)


def upload_errors(ext: Column, size: Column) -> Column:
    """Every reason to refuse a file; an empty array means it is accepted."""
    supported = ", ".join("." + e for e in fixed.SUPPORTED_EXTENSIONS)
    megabytes = size / F.lit(1024.0 * 1024.0)
    return F.array_compact(
        F.array(
            F.when(
                ~ext.isin(fixed.SUPPORTED_EXTENSIONS),
                F.concat(F.lit("Unsupported file type: ."), ext, F.lit(f". Supported: {supported}")),
            ),
            F.when(
                size > fixed.MAX_FILE_BYTES,
                F.concat(
                    F.lit("File too large: "), T.fixed_point(megabytes, 1),
                    F.lit(f" MB. Maximum: {fixed.MAX_FILE_BYTES // (1024 * 1024)} MB"),
                ),
            ),
            F.when(size == 0, F.lit("File is empty")),
        )
    )


def checked_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (raw_name, size_bytes) with a safe name, extension and all errors."""
    return (
        uploads.withColumn("name", safe_name(F.col("raw_name")))
        .withColumn("extension", extension(F.col("name")))
        .withColumn("errors", upload_errors(F.col("extension"), F.col("size_bytes")))
        .withColumn("accepted", F.size("errors") == 0)
    )


def document_id(org: Column, sha256: Column) -> Column:
    """Stable id: the same content in the same tenant always gets the same id."""
    return F.concat(F.lit("doc_"), F.left(F.sha2(F.concat(org, F.lit("|"), sha256), 256), F.lit(16)))


def document_rows(checked: DataFrame) -> DataFrame:
    """Catalog row of each accepted upload (org_id, name, extension, size_bytes, sha256)."""
    rows = checked.withColumn("id", document_id(F.col("org_id"), F.col("sha256")))
    return rows.select(
        "id", "org_id", "name", "extension", "size_bytes", "sha256",
        mime_type(F.col("extension"), F.col("declared_mime")).alias("mime_type"),
        unit_label(F.col("extension")).alias("unit_label"),
        F.concat(F.col("org_id"), F.lit("/"), F.col("id"), F.lit("/v1/original."), F.col("extension")).alias("storage_key"),
        F.concat(F.col("id"), F.lit("_v1")).alias("version_id"),
        F.lit("QUEUED").alias("status"),
    )


def with_defaults(old: DataFrame) -> DataFrame:
    """Rows of an earlier layout with every later field filled in."""
    kind = F.lower(F.coalesce("type", "extension", F.lit("")))
    return old.select(
        "id",
        F.coalesce("documentId", "id").alias("documentId"),
        F.coalesce("originalFilename", "name").alias("originalFilename"),
        F.coalesce(F.col("extension"), kind).alias("extension"),
        F.coalesce(F.col("mimeType"), mime_type(kind)).alias("mimeType"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.col("hash"),
        F.col("pageCount"),
        F.col("slideCount"),
        F.coalesce(F.col("unitLabel"), unit_label(kind)).alias("unitLabel"),
        F.coalesce("status", F.lit("ready")).alias("status"),
        F.coalesce("processingStatus", F.lit("completed")).alias("processingStatus"),
        F.coalesce("indexingStatus", F.lit("completed")).alias("indexingStatus"),
        F.coalesce("processedAt", "uploadedAt").alias("processedAt"),
        F.col("processingError"),
    )


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Key and the smallest ``order`` value: partial aggregation, so copies never gather."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def duplicate_log(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of each incoming file (org_id, sha256, file_id) against a catalog (org_id, sha256, id).

    Content already stored is a duplicate of the stored document; content seen
    twice in one load is a duplicate of its first file.
    """
    stored = existing.groupBy("org_id", "sha256").agg(F.min("id").alias("existing_id"))
    first = incoming.groupBy("org_id", "sha256").agg(F.min("file_id").alias("first_file"))
    known = first.join(stored, ["org_id", "sha256"], "left")
    joined = incoming.join(known, ["org_id", "sha256"], "left")
    return joined.select(
        "org_id", "sha256", "file_id", "existing_id",
        F.when(F.col("existing_id").isNotNull(), "duplicate")
        .when(F.col("file_id") == F.col("first_file"), "queued")
        .otherwise("duplicate_in_load")
        .alias("outcome"),
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: keys not yet stored. Running it again appends nothing."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def delete_cascade(parent_gone: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Children without the rows of the removed parents."""
    return [child.join(parent_gone.select(key), key, "left_anti") for child in children]


def size_label(size: Column) -> Column:
    step = F.least(F.floor(F.log2(size.cast("double")) / 10), F.lit(3))
    names = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")])
    amount = F.round(size / F.pow(F.lit(1024.0), step), 1)
    shown = F.regexp_replace(F.format_string("%.1f", amount), F.lit(r"\.0$"), F.lit(""))
    return F.when(size > 0, F.concat(shown, F.lit(" "), F.get(names, step.cast("int")))).otherwise("0 B")


def status_label(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("ready")))
    return (
        F.when(s.isin("ready", "indexed"), "Ready")
        .when(s.isin("processing", "extracting", "chunking"), s)
        .when(s.isin("failed", "error"), "Failed")
        .when(s == "duplicate", "Duplicate")
        .when(s == "queued", "Queued")
        .otherwise(s)
    )
