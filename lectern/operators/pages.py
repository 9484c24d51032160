"""Page markers, page furniture and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T


def repeated_line_counts(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line) that occur twice or more in a document."""
    return (
        lines.select("doc_id", F.lower(T.collapse(F.col("line"))).alias("norm"))
        .filter((F.length("norm") > 2) & (F.length("norm") < 120))
        .groupBy("doc_id", "norm")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n >= 2")
    )


def split_pages(text: Column) -> Column:
    """Array of page texts, cut before each page, slide or scan marker."""
    return F.split(text, r"\n(?=<!-- (?:PAGE|SLIDE) \d+ -->|--- Page \d+ ---)")


def page_number(page: Column) -> Column:
    found = F.regexp_extract(page, r"\A\s*(?:<!-- (?:PAGE|SLIDE) (\d+) -->|--- Page (\d+) ---)", 1)
    scanned = F.regexp_extract(page, r"\A\s*--- Page (\d+) ---", 1)
    return F.coalesce(T.blank_to_null(found), T.blank_to_null(scanned)).cast("int")


def pages_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per numbered page (doc_id, page, page_text)."""
    return (
        docs.select("doc_id", F.explode(split_pages(F.col(text))).alias("page_text"))
        .withColumn("page", page_number(F.col("page_text")))
    )


def missing_pages(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Pages 1..n (``expected``: doc_id, n) that a document lacks."""
    wanted = expected.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    return wanted.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def strip_page_furniture(text: Column, product_name: str | None = None) -> Column:
    """Drop repeated short lines and page numbers from text with page markers.

    Lines are counted over the whole document and only when it has two or more pages.
    Everything happens inside the row: equal lines meet by sorting an array.
    """
    def norm(line: Column) -> Column:
        return F.lower(T.collapse(line))

    def drop(lines: Column) -> Column:
        keyed = F.sort_array(
            F.transform(lines, lambda l, i: F.struct(norm(l).alias("key"), i.alias("pos"), l.alias("line")))
        )
        def mark(arr: Column) -> Column:
            before = F.transform(F.concat(F.array(F.lit(None)), F.transform(arr, lambda x: x["key"])), lambda k: k)
            after = F.concat(F.slice(F.transform(arr, lambda x: x["key"]), F.lit(2), F.size(arr)), F.array(F.lit(None)))
            around = F.arrays_zip(arr.alias("row"), F.slice(before, F.lit(1), F.size(arr)).alias("prev"), after.alias("next"))
            return F.filter(around, lambda x: keep(x))

        def keep(x: Column) -> Column:
            key = x["row"]["key"]
            twin = F.coalesce(x["prev"] == key, F.lit(False)) | F.coalesce(x["next"] == key, F.lit(False))
            repeated = twin & (F.length(key) > 2) & (F.length(key) < 120)
            number = T.matches(key, fixed.PAGE_NUMBER_LINE)
            footer = T.matches(key, T.footer_pattern(product_name)) if product_name else F.lit(False)
            return ~(repeated | number | footer)

        kept = T.bind(keyed, mark)
        ordered = F.sort_array(F.transform(kept, lambda x: F.struct(x["row"]["pos"].alias("pos"), x["row"]["line"].alias("line"))))
        return F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")

    several = F.size(F.split(text, r"\n(?=<!-- PAGE \d+ -->)")) > 1
    return F.when(several, T.bind(F.split(text, "\n"), drop)).otherwise(text)


def structured_clean_pages(col: Column, product_name: str | None = None) -> Column:
    """``structured_clean`` for text with page markers."""
    return T.tidy_blank_lines(T.drop_adjacent_repeats(strip_page_furniture(T.strip_artifacts(col), product_name)))
