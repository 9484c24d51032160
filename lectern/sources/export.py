"""Reports as CSV, TSV, JSON, text and HTML, and checks of written files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators.markdown import block_text, sections_of, titles


# ---- rows -------------------------------------------------------------------
def delimited_rows(blocks: DataFrame) -> DataFrame:
    """Rows of the tabular export (doc_id, pos, row, cells).

    The first table of a document as it is; without a table, Type and Content rows.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    # The blocks are read once: whether a document has a table is seen from each of its rows.
    first = F.min(F.when(F.col("type") == "table", F.col("pos"))).over(Window.partitionBy("doc_id"))
    placed = blocks.withColumns({"table_pos": first, "place": F.row_number().over(order)})

    def line(pos: Column, row: Column, cells: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), row.cast("int").alias("row"), cells.alias("cells"))

    plain = line(F.col("pos"), F.lit(0), F.array(F.col("type"), block_text()))
    head = line(F.lit(-1), F.lit(0), F.array(F.lit("Type"), F.lit("Content")))
    lines = (
        F.when(F.col("pos") == F.col("table_pos"), F.transform("rows", lambda cells, i: line(F.col("pos"), i, cells)))
        .when(F.col("table_pos").isNull() & (F.col("place") == 1), F.array(head, plain))
        .when(F.col("table_pos").isNull(), F.array(plain))
    )
    return placed.select("doc_id", F.inline(lines))


def csv_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ",")


def tsv_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.translate(c, "\t\r\n", "   ")), "\t")


def json_section_rows(blocks: DataFrame) -> DataFrame:
    """Content rows of the JSON export (doc_id, section, heading, pos, type, text)."""
    rows = sections_of(blocks).filter(~F.col("type").isin("h1", "h2"))
    return rows.select("doc_id", "section", "heading", "pos", "type", "text")


def json_documents(blocks: DataFrame, fallback: str = "Document") -> DataFrame:
    """One JSON text per document: title and sections with typed content. Bounded by the document."""
    marked = sections_of(blocks).filter(F.col("type") != "h1")
    item = F.when(F.col("type") != "h2", F.struct("pos", "type", "text"))
    per_section = marked.groupBy("doc_id", "section", "heading").agg(F.sort_array(F.collect_list(item)).alias("items"))
    content = F.transform("items", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text")))
    sections = per_section.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("section", F.col("heading"), content.alias("content")))).alias("s")
    )
    title = F.coalesce("title", F.lit(fallback))
    body = F.transform("s", lambda x: F.struct(x["heading"].alias("heading"), x["content"].alias("content")))
    return titles(blocks).join(sections, "doc_id", "left").select(
        "doc_id", F.to_json(F.struct(title.alias("title"), body.alias("sections"))).alias("json")
    )


def html_lines(blocks: DataFrame) -> DataFrame:
    """HTML of each block (doc_id, pos, html); neighbouring bullets share one list."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy("pos")
    bullet = F.col("type") == "bullet"
    before = F.coalesce(F.lag("type").over(order) == "bullet", F.lit(False))
    after = F.coalesce(F.lead("type").over(order) == "bullet", F.lit(False))

    def row(cells: Column, tag: Column) -> Column:
        one = F.transform(cells, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), T.escape_html(c), F.lit("</"), tag, F.lit(">")))
        return F.concat(F.lit("<tr>"), F.array_join(one, ""), F.lit("</tr>"))

    table = F.concat(
        F.lit("<table>"),
        F.array_join(F.transform("rows", lambda r, i: row(r, F.when(i == 0, F.lit("th")).otherwise(F.lit("td")))), ""),
        F.lit("</table>"),
    )
    tag = F.when(bullet, "li").when(F.col("type").isin("h1", "h2", "h3"), F.col("type")).otherwise("p")
    plain = F.concat(F.lit("<"), tag, F.lit(">"), T.escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    html = F.concat(
        F.when(bullet & ~before, "<ul>\n").otherwise(""),
        F.when(F.col("type") == "table", table).otherwise(plain),
        F.when(bullet & ~after, "\n</ul>").otherwise(""),
    )
    return blocks.withColumns({"html": html}).select("doc_id", "pos", "html")


def html_page(title: Column, body: Column) -> Column:
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>'),
        T.escape_html(F.coalesce(title, F.lit("Document"))), F.lit("</title>\n</head>\n<body>\n"), body, F.lit("\n</body>\n</html>"),
    )


def html_documents(blocks: DataFrame) -> DataFrame:
    body = html_lines(blocks).groupBy("doc_id").agg(F.expr("listagg(html, '\\n') WITHIN GROUP (ORDER BY pos)").alias("body"))
    return body.join(titles(blocks), "doc_id").select("doc_id", html_page(F.col("title"), F.col("body")).alias("html"))


# ---- files ------------------------------------------------------------------
def write_delimited(rows: DataFrame, path: str, tab: bool = False) -> None:
    """One folder per document, lines in order. Documents are spread over tasks."""
    line = tsv_line(F.col("cells")) if tab else csv_line(F.col("cells"))
    ordered = rows.select("doc_id", "pos", "row", line.alias("value")).repartition("doc_id").sortWithinPartitions("doc_id", "pos", "row")
    ordered.select("doc_id", "value").write.mode("overwrite").partitionBy("doc_id").text(path)


def write_texts(docs: DataFrame, text: str, path: str) -> None:
    docs.select("doc_id", F.col(text).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def file_checks(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Written files with size and signature checks (name, bytes, format, ok).

    The file source does not list empty files, so the catalog's names can be
    given: a name without a file with content is reported as not ok.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.substring("content", 1, 5)
    text = F.decode("content", "UTF-8")
    good = (
        F.when(ext == "pdf", head.cast("string").startswith("%PDF-"))
        .when(ext.isin("docx", "pptx", "xlsx", "zip"), head.cast("string").startswith("PK"))
        .when(ext == "json", F.try_parse_json(text).isNotNull())
        .otherwise(F.lit(True))
    )
    found = files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), ext.alias("format"),
        ((F.col("length") > 0) & good).alias("ok"),
    )
    if expected is None:
        return found
    return expected.select("name").join(found, "name", "left").withColumns(
        {"bytes": F.coalesce("bytes", F.lit(0)), "ok": F.coalesce("ok", F.lit(False))}
    )
