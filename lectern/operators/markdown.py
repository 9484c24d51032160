"""Report text to typed blocks, sections and structured documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.functions.patterns import jvm

_JOIN = "\x1e"  # between the rows of one table
_TAGS = (
    (r"(?s)<h1[^>]*>(.*?)</h1>", "\n# $1\n"),
    (r"(?s)<h2[^>]*>(.*?)</h2>", "\n## $1\n"),
    (r"(?s)<h3[^>]*>(.*?)</h3>", "\n### $1\n"),
    (r"(?s)<li[^>]*>(.*?)</li>", "\n- $1\n"),
    (r"(?s)<p[^>]*>(.*?)</p>", "\n$1\n"),
    (r"<br\s*/?>", "\n"),
)


def _lines(col: Column) -> Column:
    out = col
    for pattern, new in _TAGS:
        out = T.rx(out, pattern, new, "i")
    out = T.rx(out, r"<[^>]+>", "")
    return F.transform(F.split(out, r"\r?\n"), lambda l, i: F.struct(i.alias("pos"), T.trim_all(l).alias("line")))


def typed_lines(col: Column) -> Column:
    """Array of block strings; the rows of one table are one string.

    A bare list mark makes the next text line a bullet; bare heading and
    emphasis marks are dropped. Neighbouring table lines are glued, so no
    window or shuffle is needed to find tables.
    """
    bare = r"\A(?:#{1,6}|\*{1,3}|_{1,3}|`{1,3})\z"
    mark = r"\A(?:[-*]|•)\z"
    solid = F.filter(
        _lines(col), lambda x: (x["line"] != "") & (~x["line"].rlike(bare) | x["line"].rlike(mark))
    )
    shaped = T.pairs_with_previous(
        solid,
        lambda x, p: F.struct(
            x["pos"].alias("pos"), x["line"].alias("line"), x["line"].rlike(mark).alias("mark"),
            (F.coalesce(p["line"].rlike(mark), F.lit(False)) & ~x["line"].rlike(mark)).alias("after_mark"),
        ),
    )
    rows = F.filter(shaped, lambda x: ~x["mark"])
    rows = F.transform(
        rows,
        lambda x: F.struct(
            x["pos"].alias("pos"), (x["line"].contains("|") & ~x["after_mark"]).alias("table"),
            F.when(x["after_mark"], F.concat(F.lit("- "), T.rx(x["line"], r"\A[-*•]\s*", ""))).otherwise(x["line"]).alias("line"),
        ),
    )
    glued = T.pairs_with_previous(
        rows,
        lambda x, p: F.concat(
            F.when(p.isNull(), "")
            .when(x["table"] & p["table"] & (x["pos"] == p["pos"] + 1), _JOIN)
            .otherwise("\n"),
            # A bullet that holds a bar is no table: its bar is marked.
            F.when(x["table"], x["line"]).otherwise(F.replace(x["line"], F.lit("|"), F.lit("\x1f"))),
        ),
    )
    return F.filter(F.split(F.array_join(glued, ""), "\n"), lambda b: b != "")


def _block(line: Column) -> Column:
    is_table = line.contains("|")
    text = F.replace(line, F.lit("\x1f"), F.lit("|"))
    kind = (
        F.when(is_table, "table")
        .when(text.startswith("# "), "h1").when(text.startswith("## "), "h2").when(text.startswith("### "), "h3")
        .when(text.rlike(r"\A[-*]\s+"), "bullet")
        .when(text.rlike(r"\A\d+[.)]\s+"), "numbered")
        .otherwise("p")
    )
    body = (
        F.when(kind.isin("h1", "h2", "h3"), T.trim_all(T.rx(text, r"\A#{1,3} ", "")))
        .when(kind == "bullet", T.rx(text, r"\A[-*]\s+", ""))
        .when(kind == "numbered", T.rx(text, r"\A\d+[.)]\s+", ""))
        .when(kind == "p", text)
    )
    return F.struct(
        kind.alias("type"), body.alias("text"),
        F.when(kind == "numbered", F.regexp_extract(text, r"\A\d+", 0)).alias("number"),
        F.when(is_table, table_rows(line)).alias("rows"),
    )


def table_rows(line: Column) -> Column:
    def cells(row: Column) -> Column:
        inner = T.rx(T.rx(T.trim_all(row), r"\A\|", ""), r"\|\z", "")
        return F.transform(F.split(inner, r"\|"), T.trim_all)

    parsed = F.transform(F.split(line, _JOIN), cells)
    return F.filter(parsed, lambda r: ~F.forall(r, lambda c: c.rlike(r"\A:?-{3,}:?\z")) & (F.array_join(r, "") != ""))


def blocks_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per block (doc_id, pos, type, text, number, rows). The text is export text already."""
    lines = docs.select("doc_id", F.posexplode(typed_lines(F.col(text))).alias("pos", "line"))
    typed = lines.select("doc_id", "pos", _block(F.col("line")).alias("b")).select("doc_id", "pos", "b.*")
    return typed.filter((F.col("type") != "table") | (F.size("rows") > 0))


def block_text() -> Column:
    """Text of a block row; table rows as lines with bars."""
    table = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n")
    return F.when(F.col("type") == "table", table).otherwise(F.coalesce("text", F.lit("")))


def titles(blocks: DataFrame) -> DataFrame:
    first = F.when(F.col("type") == "h1", F.col("pos"))
    return blocks.groupBy("doc_id").agg(F.min_by(F.when(F.col("type") == "h1", F.col("text")), first).alias("title"))


def sections_of(blocks: DataFrame, heads: tuple[str, ...] = ("h2",)) -> DataFrame:
    """Blocks with the ordinal and heading of their section; a document's blocks are one row's text."""
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("type").isin(*heads)
    return blocks.withColumns(
        {
            "section": F.sum(head.cast("int")).over(so_far),
            "heading": F.coalesce(F.last(F.when(head, F.col("text")), ignorenulls=True).over(so_far), F.lit("")),
        }
    )


def structured_documents(blocks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, title, section, heading, level, pos, node, text, rows) fit for a report.

    Headings over ninety characters become text, tables need two rows and 2 to
    32 columns, and an own Sources section goes when source rows exist.
    """
    # The blocks are read once: a document's title is seen from each of its rows.
    whole = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    title = F.first(F.when(F.col("type") == "h1", F.col("text")), ignorenulls=True).over(whole)
    rows = blocks.withColumn("title", title).withColumn("title", T.print_text(F.coalesce("title", F.lit("Report"))))
    rows = rows.withColumn("text", T.print_text(F.col("text")))
    is_head = F.col("type").isin("h1", "h2", "h3")
    rows = rows.filter(~((F.col("type") == "h1") & (F.col("text") == F.col("title"))))
    # A heading that swallowed a dashed list opens a section with the list as bullets.
    rows = rows.withColumn("recovered", F.when(is_head, T.list_from_heading(F.col("text"))))
    rows = rows.withColumns(
        {
            "opens": is_head & (F.col("recovered").isNotNull() | (F.length("text") <= 90)),
            "cells": F.transform("rows", lambda r: F.transform(r, T.print_text)),
        }
    )
    columns = F.array_max(F.transform("cells", F.size))
    marked = F.exists("cells", lambda r: F.exists(r, lambda c: c.rlike(r"(?:^|\s)#{1,3}\s|^---$|\|")))
    good_table = (F.size("cells") >= 2) & columns.between(2, 32) & ~marked
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("opens"), F.struct(
        F.coalesce("recovered.heading", "text").alias("heading"),
        F.when(F.col("recovered").isNotNull(), 3).when(F.col("type") == "h2", 2).otherwise(3).alias("level"),
    ))
    rows = rows.withColumns(
        {
            "section": F.sum(F.col("opens").cast("int")).over(so_far),
            "head": F.last(opened, ignorenulls=True).over(so_far),
        }
    )
    alone = F.col("opens") & F.col("recovered").isNull()
    node = (
        F.when(alone, "heading").when(F.col("recovered").isNotNull(), "bullet").when(is_head, "paragraph")
        .when(F.col("type") == "p", "paragraph").otherwise(F.col("type"))
    )
    texts = F.when(F.col("recovered").isNotNull(), F.col("recovered.items")).otherwise(F.array("text"))
    out = rows.filter(alone | (F.col("type") != "table") | good_table).select(
        "doc_id", "title", "section", F.col("head.heading").alias("heading"), F.col("head.level").alias("level"), "pos",
        node.alias("node"), F.posexplode(texts).alias("item", "text"), F.when(~alone, F.col("cells")).alias("rows"),
    ).filter((F.col("node") == "table") | (F.col("text") != ""))
    if sources is not None:
        own = F.coalesce(F.col("heading").rlike(r"(?i)\A(?:sources?|references?)\z"), F.lit(False))
        known = sources.select("doc_id").distinct().withColumn("_sourced", F.lit(True))
        out = out.join(known, "doc_id", "left").filter(~(own & F.coalesce("_sourced", F.lit(False)))).drop("_sourced")
    return out


# ---- sections and paragraphs at table level ---------------------------------
def distinct_section_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sections of each document, equal ones (case and spacing aside) once (doc_id, pos, body)."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.col(text), jvm(r"\n(?=#{1,3}\s+\S)"))).alias("pos", "s"))
    cut = cut.withColumn("body", T.trim_all(T.rx(F.col("s"), r"\n{3,}", "\n\n"))).filter("body <> ''").drop("s")
    keyed = cut.withColumn("key", F.sha2(F.lower(T.collapse(F.col("body"))), 256))
    first = keyed.groupBy("doc_id", "key").agg(F.min("pos").alias("pos"))
    return keyed.join(first, ["doc_id", "key", "pos"]).drop("key")
