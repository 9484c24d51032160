import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

LONG = " ".join(f"word{k * 7919 % 5003}" for k in range(30_000))
SHARED = "the very same passage stands in several of these documents and is far longer than fifty bytes"

ODD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, "One two three.", "en"),
    (5, "one TWO three", "en"),
    (6, LONG, "en"),
    (7, LONG + " and a tail", "en"),
    (8, "Ünïcödé wörds, ñandú; 中文 字 😀 " * 9, "de"),
    (8, "another text under the same id, " + SHARED, "de"),
    (9, "same same same same same same " * 30, "fr"),
    (9, "same same same same same same " * 30, "fr"),
    (10, "A" * 130, "es"),
    (11, "A" * 131 + "b" + "A" * 60, "es"),
    (12, "before " + SHARED + " after", None),
    (13, SHARED, "en"),
    (14, "x" + SHARED[:49] + "y", "en"),
    (None, "before " + SHARED + " after", "en"),
    (None, None, None),
    (15, "line\nline\nline\n\n  \nother line\nline ", "en"),
    (16, "mark ▁ mark  two  spaces ", "en"),
]


def frame(spark, rows, text="text"):
    """documents with columns whose names the operators use inside."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField(text, T.StringType()), T.StructField("lang", T.StringType()),
        *(T.StructField(n, T.StringType()) for n in ("mark", "bucket", "segment", "class", "root", "__mark", "trusted", "held", "labels", "key", "answers")),
    ])
    return spark.createDataFrame([(*r, *"abcdefghijk") for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def given(spark):
    """Odd rows and the small documents table, as (doc_id, text)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    return ODD + [(r[0] + 100, r[1], r[2]) for r in docs]


@pytest.fixture(scope="session")
def docs(spark, given):
    return frame(spark, given).cache()


@pytest.fixture(scope="session")
def pairs(given):
    return [(d, t) for d, t, _ in given]


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


def rows(df):
    return [tuple(r) for r in df.collect()]
