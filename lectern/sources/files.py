"""Files in: corpus scan, text files, archives, office documents, earlier JSON stores."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators.chunking import implicit_headings
from lectern.session import BYTES_AT_ONCE, ROWS_AT_ONCE, modest
from lectern.sources.markup import yaml_as_json


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file (path, name, bytes, size)."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("bytes"), F.col("length").alias("size")
    )


def text_files(files: DataFrame) -> DataFrame:
    """Text of the files with a text extension, headed by their name and cleaned."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    raw = F.concat(F.lit("[File: "), F.col("name"), F.lit("]\n\n"), F.decode("bytes", "UTF-8"))
    return files.filter(ext.isin(fixed.TEXT_EXTENSIONS)).withColumn("text", T.structured_clean(raw)).drop("bytes")


#: What a damaged, cut off or encrypted archive raises.
_DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError)


#: Endings whose text is not the bytes as they stand.
MARKUP = ["html", "htm", "xml"]
YAML = ["yaml", "yml"]
#: Endings whose bytes visit Python, with the parts that are read of a package.
PARTS = {"docx": r"^word/document\.xml$", "pptx": r"^ppt/slides/slide(\d+)\.xml$"}
PACKED = ["zip", *PARTS, *YAML]


def _ending(name: str = "name") -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def extracted_texts(files: DataFrame) -> DataFrame:
    """Text of files by their ending (doc_id, text); ``files`` has doc_id, name and bytes.

    Markup, JSON, YAML, SVG, archives, word-processor and slide files are read as
    such, other text endings as plain text. A file that cannot be read, or whose
    kind has no text here, gives no row.
    """
    return file_texts(files).select("doc_id", "text").filter("text is not null")


def file_texts(files: DataFrame) -> DataFrame:
    """The same for every file (doc_id, name, text, readable), with a null text where there is none.

    A file is read once and becomes a text in its own row, whatever its kind:
    nothing is moved, and only archives, packages, YAML and nested JSON visit Python.
    A file may be readable and have no text: an empty one, or one with nothing but embedded data.
    """
    from lectern.sources.markup import json_lines, svg_labels

    ext = F.col("ext")
    as_text = [*fixed.TEXT_EXTENSIONS, *MARKUP, *YAML, "json", "svg"]
    rows = modest(files).select(
        "doc_id", "name", _ending().alias("ext"),
        F.when(_ending().isin(as_text), F.decode("bytes", "UTF-8")).alias("raw"),
        _unpacked(F.when(_ending().isin(PACKED), _ending()), F.when(_ending().isin(PACKED), F.col("bytes"))).alias("parts"),
    )
    first = F.get("parts", F.lit(0))["body"]
    rows = json_lines(rows.withColumn("json", F.when(ext == "json", F.col("raw")).when(ext.isin(YAML), first)), "json")
    decks = F.filter(F.transform("parts", lambda p, i: slide_text(p["body"], i + 1)), lambda t: t != "")
    body = (
        F.when(ext == "zip", None).when(ext == "svg", None)
        .when(ext == "docx", F.array_join(word_blocks(F.when(ext == "docx", first)), "\n\n"))
        .when(ext == "pptx", F.array_join(decks, "\n\n"))
        .when(ext.isin("json", *YAML), F.col("lines"))
        .when(ext.isin(MARKUP), T.markup_text(F.col("raw")))
        .otherwise(F.col("raw"))
    )
    rows = rows.select("doc_id", "name", "ext", "raw", "parts", T.structured_clean(body).alias("clean"))
    text = (
        F.when(ext == "zip", F.array_join(F.transform("parts", lambda p: _section(p["name"], p["body"])), "\n\n"))
        .when(ext == "svg", svg_labels(F.col("raw")))
        .when(ext == "docx", implicit_headings(F.when(ext == "docx", F.col("clean"))))
        .otherwise(F.col("clean"))
    )
    readable = F.coalesce(F.when(ext.isin("zip", *PARTS), F.col("parts").isNotNull()).otherwise(F.col("raw").isNotNull()), F.lit(False))
    rows = rows.select("doc_id", "name", text.alias("text"), readable.alias("readable"))
    head = F.concat(F.lit("[File: "), F.col("name"), F.lit("]\n\n"))
    return rows.withColumn("text", F.when(T.trim_all(F.col("text")) != "", F.concat(head, F.col("text"))))


# ---- archives ---------------------------------------------------------------
def _wanted_members(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Text members of an open archive (member, raw)."""
    wanted = set(fixed.TEXT_EXTENSIONS)
    for info in archive.infolist():
        name = info.filename
        ext = name.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        if not (info.is_dir() or "__MACOSX" in name or ".git/" in name or ext not in wanted):
            yield name, archive.read(info).decode("utf-8", errors="replace")


def _parts_of(ext: str, data: bytes) -> list[tuple[str, str]] | None:
    """Members of an archive by name, parts of a package by number, a YAML text as JSON; None where it cannot be read."""
    import re

    if ext in YAML:
        return [("", yaml_as_json(data.decode("utf-8", errors="replace")))]
    found: list[tuple[str, str]] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            if ext == "zip":
                # What stands before a damaged member counts.
                found.extend(_wanted_members(archive))
            else:
                rule = re.compile(PARTS[ext])
                names = [name for name in dict.fromkeys(archive.namelist()) if rule.search(name)]
                if ext == "pptx":
                    names.sort(key=lambda name: int(rule.search(name).group(1)))
                return [(name, archive.read(name).decode("utf-8", errors="replace")) for name in names]
    except _DAMAGED:
        if ext != "zip":
            return None
    return sorted(found, key=lambda row: row[0].encode()) or None


@F.pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("body", StringType())])))
def _unpacked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """What Python reads of a file; null for the others. Large contents leave in pieces of a batch."""
    for kinds, contents in batches:
        out, held = [], 0
        for ext, data in zip(kinds, contents):
            parts = None if ext is None or data is None else _parts_of(ext, data)
            out.append(parts and [{"name": name, "body": body} for name, body in parts])
            held += sum(len(body) for _, body in parts or [])
            if held >= BYTES_AT_ONCE:
                yield pd.Series(out, dtype=object)
                out, held = [], 0
        if out:
            yield pd.Series(out, dtype=object)


def archive_members(files: DataFrame) -> DataFrame:
    """Text members of zip files (path, member, raw, error): one row in, many out.

    A damaged archive gives one row with its ``error`` and no member.
    """
    columns = ["path", "member", "raw", "error"]

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path, data in zip(batch["path"], batch["bytes"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        for name, body in _wanted_members(archive):
                            rows.append((path, name, body, None))
                            held += len(body)
                            if held >= BYTES_AT_ONCE or len(rows) >= ROWS_AT_ONCE:
                                yield pd.DataFrame(rows, columns=columns, dtype="str")
                                rows, held = [], 0
                except _DAMAGED as damage:
                    rows.append((path, None, None, str(damage)))
        if rows:
            yield pd.DataFrame(rows, columns=columns, dtype="str")

    return modest(files.select("path", "bytes")).mapInPandas(members, "path string, member string, raw string, error string")


def archive_sections(members: DataFrame) -> DataFrame:
    """One headed section per archive member."""
    members = members.filter("error is null")
    return members.select("path", "member", _section(F.col("member"), F.col("raw")).alias("section"))


def _section(member: Column, raw: Column) -> Column:
    return F.concat(F.lit("# Archive file: "), member, F.lit("\n\n"), T.structured_clean(raw))


# ---- office XML -------------------------------------------------------------
def package_parts(files: DataFrame, pattern: str) -> DataFrame:
    """XML parts of zipped office files whose name matches (path, part, xml); a damaged file has none."""
    import re

    rule = re.compile(pattern)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["bytes"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as package:
                        names = [n for n in package.namelist() if rule.search(n)]
                        xml = [package.read(n).decode("utf-8", errors="replace") for n in names]
                except _DAMAGED:
                    continue
                yield pd.DataFrame({"path": [path] * len(names), "part": names, "xml": xml}, dtype="str")

    return files.select("path", "bytes").mapInPandas(parts, "path string, part string, xml string")


def word_blocks(xml: Column) -> Column:
    """Blocks of a word-processor body: headings, list items, paragraphs, tables as bar rows."""
    raw = F.regexp_extract_all(xml, F.lit(r"(?s)<w:p\b.*?</w:p>|<w:tbl\b.*?</w:tbl>"), F.lit(0))
    facts = F.transform(
        raw,
        lambda b, i: F.struct(
            b.startswith("<w:tbl").alias("table"),
            T.run_text(b).alias("text"),
            F.lower(F.regexp_extract(b, r'<w:pStyle[^>]*w:val="([^"]+)"', 1)).alias("style"),
            F.coalesce(T.blank_to_null(F.regexp_extract(b, r'<w:ilvl[^>]*w:val="(\d+)"', 1)).cast("int"), F.lit(0)).alias("depth"),
            b.rlike(r"<w:numPr\b").alias("listed"),
            F.when(b.startswith("<w:tbl"), word_table(b)).alias("rows"),
        ),
    )
    solid = F.filter(facts, lambda x: (x["table"] & (x["rows"] != "")) | (~x["table"] & (x["text"] != "")))

    # The running number restarts at headings and plain paragraphs; tables leave it alone.
    def step(acc: Column, x: Column) -> Column:
        level = F.coalesce(
            T.blank_to_null(F.regexp_extract(x["style"], r"heading\s*([1-6])", 1)).cast("int"), F.lit(0)
        )
        number = (
            F.when(x["table"], acc["n"]).when(level > 0, 0)
            .when(x["listed"], acc["n"] + F.when(x["depth"] == 0, 1).otherwise(0)).otherwise(0)
        )
        bullet = F.when(x["style"].contains("number"), F.concat(number.cast("string"), F.lit("."))).otherwise("-")
        line = (
            F.when(x["table"], x["rows"])
            .when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), x["text"]))
            .when(x["listed"], F.concat(F.repeat(F.lit("  "), x["depth"]), bullet, F.lit(" "), x["text"]))
            .otherwise(x["text"])
        )
        return F.struct(number.alias("n"), F.concat(acc["out"], F.array(line)).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(solid, start, step, lambda acc: acc["out"])


def word_table(tbl: Column) -> Column:
    rows = F.transform(
        F.regexp_extract_all(tbl, F.lit(r"(?s)<w:tr\b.*?</w:tr>"), F.lit(0)),
        lambda r: F.filter(
            F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<w:tc\b.*?</w:tc>"), F.lit(0)), T.run_text), lambda c: c != ""
        ),
    )
    rows = F.filter(rows, lambda r: F.size(r) > 0)

    def shape(rs: Column) -> Column:
        width = F.array_max(F.transform(rs, F.size))
        return F.array_join(F.transform(rs, lambda r, i: bar_row(r, width, i)), "\n")

    def bar_row(r: Column, width: Column, i: Column) -> Column:
        padded = F.concat(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), width - F.size(r)))
        line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
        rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return F.concat(line, F.when(i == 0, rule).otherwise(""))

    return F.when(F.size(rows) > 0, T.bind(rows, shape)).otherwise("")


def word_text(parts: DataFrame) -> DataFrame:
    """Text of word-processor files (path, text)."""
    blocks = F.array_join(word_blocks(F.col("xml")), "\n\n")
    return parts.withColumn("blocks", blocks).select("path", implicit_headings(T.structured_clean(F.col("blocks"))).alias("text"))


def slide_text(xml: Column, number: Column) -> Column:
    """One slide: marker, title, indented bullets; empty for a slide without text."""
    items = F.filter(
        F.transform(
            F.regexp_extract_all(xml, F.lit(r"(?s)<a:p\b.*?</a:p>"), F.lit(0)),
            lambda p: F.struct(
                T.run_text(p).alias("text"),
                F.coalesce(T.blank_to_null(F.regexp_extract(p, r'<a:pPr[^>]*\blvl="(\d+)"', 1)).cast("int"), F.lit(0)).alias("depth"),
            ),
        ),
        lambda x: x["text"] != "",
    )

    def shape(xs: Column) -> Column:
        bullets = F.transform(
            F.slice(xs, F.lit(2), F.size(xs)), lambda x: F.concat(F.repeat(F.lit("  "), x["depth"]), F.lit("- "), x["text"])
        )
        return F.when(
            F.size(xs) > 0,
            F.concat(
                F.lit("<!-- SLIDE "), number.cast("string"), F.lit(" -->\n\n# "), F.get(xs, F.lit(0))["text"],
                F.when(F.size(xs) > 1, F.concat(F.lit("\n\n"), F.array_join(bullets, "\n"))).otherwise(""),
            ),
        ).otherwise("")

    return T.bind(items, shape)


def slides(parts: DataFrame) -> DataFrame:
    """Slides in numeric order (path, slide, text). ``parts`` are slide parts of packages."""
    from pyspark.sql.window import Window

    part_number = F.regexp_extract("part", r"slide(\d+)\.xml$", 1).cast("int")
    numbered = parts.withColumn("slide", F.row_number().over(Window.partitionBy("path").orderBy(part_number)))
    return numbered.select("path", "slide", slide_text(F.col("xml"), F.col("slide")).alias("text")).filter("text <> ''")


def slide_deck_text(slide_rows: DataFrame) -> DataFrame:
    """Whole deck as text; a deck is one uploaded file."""
    joined = slide_rows.groupBy("path").agg(F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY slide)").alias("t"))
    return joined.select("path", T.structured_clean(F.col("t")).alias("text"))


# ---- earlier store ----------------------------------------------------------
def legacy_store(spark: SparkSession, path: str, org: str = "org_default") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, versions and chunks from one JSON file with ``docs`` and ``chunks``."""
    schema = (
        "docs array<struct<id:string,documentId:string,name:string,originalFilename:string,mimeType:string,extension:string,"
        "type:string,size:bigint,hash:string,pageCount:int,slideCount:int,uploadedAt:bigint>>, "
        "chunks array<struct<id:string,docId:string,text:string>>"
    )
    store = spark.read.schema(schema).json(path, multiLine=True)
    d = store.select(F.explode("docs").alias("d")).select("d.*")
    created = F.coalesce(F.timestamp_millis("uploadedAt"), F.current_timestamp())
    key = F.coalesce("id", "documentId")
    documents = d.select(
        key.alias("id"), F.lit(org).alias("org_id"), F.coalesce("name", "originalFilename").alias("original_filename"),
        F.coalesce("mimeType", F.lit(fixed.DEFAULT_MIME)).alias("mime_type"),
        F.coalesce("extension", "type", F.lit("unknown")).alias("extension"),
        F.coalesce("size", F.lit(0)).alias("size_bytes"), F.col("hash").alias("sha256"),
        F.lit("READY").alias("status"), created.alias("created_at"),
    ).dropDuplicates(["id"])
    versions = d.select(
        F.concat(key, F.lit("_v1")).alias("id"), key.alias("document_id"), F.lit(1).alias("version_number"),
        F.nullif(F.col("pageCount"), F.lit(0)).alias("page_count"), F.nullif(F.col("slideCount"), F.lit(0)).alias("slide_count"),
        F.col("hash").alias("sha256"), F.lit("READY").alias("status"), created.alias("created_at"),
    ).dropDuplicates(["id"])
    c = store.select(F.posexplode("chunks").alias("pos", "c")).select("pos", "c.*").join(
        documents.select(F.col("id").alias("docId")), "docId", "left_semi"
    )
    from pyspark.sql.window import Window

    placed = c.withColumn("chunk_index", F.row_number().over(Window.partitionBy("docId").orderBy("pos")) - 1)
    chunks = placed.select(
        F.coalesce("id", F.concat("docId", F.lit("_v1_chunk_"), F.col("chunk_index"))).alias("id"),
        F.concat("docId", F.lit("_v1")).alias("version_id"), "chunk_index", F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"),
    ).dropDuplicates(["id"])
    return documents, versions, chunks
