"""The whole hybrid search: nothing foreign or unfinished, and every arm changes rows."""

from lectern.operators.retrieval import hybrid_search

CHUNK = "chunk_id bigint, doc_id bigint, org_id string, doc_name string, chunk_index bigint, content string, status string, parent_headings array<string>"
QUERY = "query_id bigint, query string, org_id string, active_document bigint, target_document string, topic string"


def test_scopes_tenants_names_and_sections(spark):
    filler = "words about nothing of note, number "
    chunks = [
        # Tenant a: a finished report of thirty chunks, one of them unfinished, under two headings.
        *[(i, 1, "a", "Yearly report.txt", i, f"{filler}{i} budget plan", "QUEUED" if i == 7 else "READY", ["Main", "Core" if i % 2 else "Rest"]) for i in range(30)],
        (40, 2, "a", "Other.txt", 0, "the budget plan of another file", "READY", None),
        # Tenant b holds the same names and words.
        (50, 3, "b", "Yearly report.txt", 0, "budget plan of the foreign tenant", "READY", ["Core"]),
    ]
    queries = [
        (1, "budget plan", "a", 2, None, None),
        (2, "yearly report budget plan", "a", None, "yearly report", "core"),
        (3, "tell me about the yearly report: zzz", "a", None, None, None),
        (4, "budget plan", "a", None, None, None),
        (5, "budget plan", "c", None, None, None),
    ]
    vectors = spark.createDataFrame([(c[0], [1.0, c[0] / 100]) for c in chunks], "item_id bigint, vector array<double>")
    asked = spark.createDataFrame([(q[0], [1.0, 0.0]) for q in queries], "query_id bigint, vector array<double>")
    rows = hybrid_search(spark.createDataFrame(queries, QUERY), asked, spark.createDataFrame(chunks, CHUNK), vectors, k=4).collect()
    found = {q[0]: {r["chunk_id"] for r in rows if r["query_id"] == q[0]} for q in queries}

    everything = set().union(*found.values())
    assert 7 not in everything and 50 not in everything
    assert found[1] == {40} and found[5] == set()
    # Ranked rows of the report only; every other finished chunk under the asked heading follows as a sibling.
    odd = {i for i in range(30) if i % 2 and i != 7}
    assert 40 not in found[2] and odd <= found[2]
    siblings = {r["chunk_id"] for r in rows if r["query_id"] == 2 and r["section_scope_match"]}
    assert siblings and siblings <= odd and all(r["rank"] is None for r in rows if r["section_scope_match"])
    # A named document brings its best five chunks, also where no word of them was asked for.
    named = {r["chunk_id"] for r in rows if r["query_id"] == 3}
    assert {10, 11, 12, 13, 14} <= named
    # Without a scope the first 25 of the tenant's equal rows stay.
    assert found[4] == {i for i in range(26) if i != 7}


def test_scoped_queries_meet_the_chunks_of_their_documents_only(spark, monkeypatch):
    from lectern.operators import lexical, retrieval

    stored = []
    real = lexical.kept
    monkeypatch.setattr(lexical, "kept", lambda df, label: (stored.append(label), real(df, label))[1])
    chunks = [(d * 10 + i, d, f"file {d}.txt", i, "apples and pears" if i % 2 else "plums") for d in (1, 2, 3) for i in range(4)]
    queries = [
        (1, "file 1 apples pears", None, "file 1"), (2, "file 1 plums", None, "file 1"), (3, "zzz", 2, None), (4, "apples or plums", 3, None),
    ]
    rows = retrieval.scoped_search(
        spark.createDataFrame(queries, "query_id bigint, query string, active_document bigint, target_document string"),
        spark.createDataFrame(chunks, "chunk_id bigint, doc_id bigint, doc_name string, chunk_index bigint, content string"), 3,
    ).collect()
    got = sorted((r["query_id"], r["chunk_id"], r["leg"]) for r in rows)
    assert got == [
        (1, 11, "scoped"), (1, 13, "scoped"), (2, 10, "scoped"), (2, 12, "scoped"), (3, 20, "document"), (3, 21, "document"),
        (3, 22, "document"), (4, 30, "scoped"), (4, 31, "scoped"), (4, 32, "scoped"),
    ]
    # The words of all chunks are neither stored nor moved where every query has a scope.
    assert "words" not in stored


def test_no_row_holds_a_whole_named_document(spark, monkeypatch):
    import re

    from lectern.operators import retrieval as R

    monkeypatch.setattr(R, "ASKED_AT_ONCE", 2)
    texts = [f"some words of the red chapter number {'abcdefghijkl'[i]} and more words" for i in range(12)]
    chunks = spark.createDataFrame([(i, i % 2, f"blue book {i % 2}.txt", t) for i, t in enumerate(texts)], "chunk_id int, doc_id int, doc_name string, content string")
    asked = spark.createDataFrame([(q, f"words in blue book {q % 3} chapter") for q in range(9)], "query_id int, query string")
    found = R.named_scores(asked, chunks)
    assert not re.search(r"collect_list\([^)]*chunk_id", found._jdf.queryExecution().optimizedPlan().toString())
    got = {(r["query_id"], r["doc_id"], r["chunk_id"]): r["score"] for r in found.collect()}
    assert len(got) == found.count() == 9 * 12
    assert set(got.values()) == {3}  # twice "words", once "chapter"; no other term stands in the text
