"""Queries over documents without a word, against their SQL."""

import duckdb
import pytest

from lectern.plans import ORACLES, QUERIES

TEXTS = ["", " ", "\n \n\t", "\u00a0", None, "A label\n1. x", "one\n\ntwo.", "\n b", " \n a\n\nc"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    # Each text under three ids in a row: some queries go by the remainder of the id.
    rows = [(3 * i + k, text, "en", "src1", len(text or "")) for i, text in enumerate(TEXTS) for k in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "<p>some text</p>"), (2, "<script>x</script>")], "page_id bigint, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, '{"k": %d}' % i) for i in range(12)], "event_id bigint, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["implicit_headings", "vertical_text", "word_blocks", "slide_texts", "ingested_files", "streamed_ingest"])
def test_rows_of_documents_without_a_word(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
