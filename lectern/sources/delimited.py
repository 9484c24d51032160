"""Delimited files and sheets as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"')


def csv_field(value: Column) -> Column:
    """Quote a field only when it needs quotes."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def sheet_text_lines(rows: DataFrame, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """Sheet rows as CSV lines under a ``# Sheet`` heading line per sheet.

    One row per line: a sheet is never gathered into one value. Blank rows are left out.
    """
    filled = F.concat_ws("", *[F.col(c).cast("string") for c in columns]) != ""
    body = rows.filter(filled).select(
        F.col(sheet).alias("sheet"), F.col(order).cast("bigint").alias("row_key"),
        F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"),
    )
    heads = rows.select(F.col(sheet).alias("sheet")).distinct().select(
        "sheet", F.lit(-1).cast("bigint").alias("row_key"), F.concat(F.lit("# Sheet: "), F.col("sheet")).alias("line")
    )
    return heads.unionByName(body)
