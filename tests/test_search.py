import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import evidence as E
from lectern.operators import lexical as L
from lectern.operators import retrieval as R
from lectern.operators import vectors as V
from lectern.operators import vectorlists as VL


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    items = rng.normal(size=(300, 8))
    items[7] = items[11]
    items[20] = 0.0
    queries = rng.normal(size=(20, 8))
    make = lambda m, name: spark.createDataFrame(
        [(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)], f"{name} bigint, vector array<float>, label int"
    )
    return items.astype("float32").astype(float), queries.astype("float32").astype(float), make(items, "item_id"), make(queries, "query_id")


def brute(items, queries, k, keep=lambda q, i: True):
    out = {}
    for q, qv in enumerate(queries):
        scored = []
        for i, v in enumerate(items):
            if keep(q, i):
                n = np.linalg.norm(qv) * np.linalg.norm(v)
                scored.append((-round(float(qv @ v / n), 6) if n else 0.0, i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


def test_both_ways_of_exact_search_agree_with_brute_force(vectors, monkeypatch):
    items, queries, i_df, q_df = vectors
    expected = brute(items, queries, 5)
    assert ranked(V.top_similar(q_df, i_df, 5)) == expected
    monkeypatch.setattr(V, "ITEM_BLOCK", 50)
    monkeypatch.setattr(V, "QUERY_BLOCK", 6)
    assert ranked(V.top_similar(q_df, i_df, 5, broadcast_bytes=64)) == expected


def test_hot_group_is_split(vectors, monkeypatch):
    items, queries, i_df, q_df = vectors
    monkeypatch.setattr(V, "ITEM_BLOCK", 16)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    assert ranked(V.top_similar(q_df, i_df, 4, group="label")) == brute(items, queries, 4, lambda q, i: q % 3 == i % 3)


def test_stored_lists_are_exact_when_all_are_probed(spark, vectors):
    items, queries, i_df, q_df = vectors
    index = VL.build_lists(i_df)
    assert 10 <= index.centres.count() <= 2 * int(300**0.5)
    assert index.vectors.count() == 300
    exact = brute(items, queries, 5)
    assert ranked(VL.top_in_lists(index, q_df, 5, index.centres.count())) == exact
    wanted = VL.lists_for(index, 5, 0.95)
    few = ranked(VL.top_in_lists(index, q_df, 5, wanted))
    assert all(len(few[q]) == 5 for q in exact)
    assert sum(len(set(few[q]) & set(exact[q])) for q in exact) / 100 >= 0.85
    # Equal vectors share a list.
    homes = {r["item_id"]: r["list_id"] for r in index.vectors.select("item_id", "list_id").collect()}
    assert homes[7] == homes[11]


def test_stored_lists_take_new_items_without_a_new_fit(spark, vectors, monkeypatch):
    items, queries, i_df, q_df = vectors
    monkeypatch.setattr(VL, "BLOCK", 40)
    index = VL.build_lists(i_df.filter("item_id < 250"))
    centres = index.centres.orderBy("list_id").collect()
    late = i_df.filter("item_id >= 240")
    index = VL.add_items(index, late)
    index = VL.add_items(index, late)
    assert index.vectors.count() == 300 and index.vectors.select("item_id").distinct().count() == 300
    assert index.centres.orderBy("list_id").collect() == centres
    assert ranked(VL.top_in_lists(VL.open_lists(spark, index.folder), q_df, 5, len(centres))) == brute(items, queries, 5)


def test_stored_lists_of_hot_empty_and_missing_vectors(spark):
    schema = "item_id bigint, vector array<float>"
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60 + i, [float(i), 1.0]) for i in range(30)] + [(99, None)]
    index = VL.build_lists(spark.createDataFrame(rows, schema))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id bigint, vector array<float>")
    assert ranked(VL.top_in_lists(index, asked, 3, 1)) == {1: [0, 1, 2]}
    none = VL.build_lists(spark.createDataFrame([], schema))
    assert VL.top_in_lists(none, asked, 3).count() == 0


def test_cosine_column_handles_zero(spark):
    df = spark.sql("SELECT array(1.0D, 0.0D) a, array(0.0D, 0.0D) b, array(2.0D, 2.0D) c")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert abs(df.select(V.cosine(F.col("a"), F.col("c"))).first()[0] - 0.5**0.5) < 1e-12


def test_query_syntax(spark):
    chunks = spark.createDataFrame(
        [(1, "red policy for hotel rooms"), (2, "policies of the red house"), (3, "hotel red rooms policy old"), (4, "green garden")],
        "chunk_id bigint, content string",
    )
    ask = lambda q: {r["chunk_id"] for r in L.and_hits(spark.createDataFrame([(1, q)], "query_id bigint, query string"), chunks).collect()}
    assert ask("red policies") == {1, 2, 3}
    assert ask('"red policy"') == {1}
    assert ask("red policy -old") == {1, 2}
    assert ask("hotel rooms or green garden") == {1, 3, 4}
    assert ask("red unknownword") == set()


def test_cover_density():
    words = "a x b x x a b".split()
    assert L.covers(words, [["a", "b"]]) == [(0, 2), (2, 5), (5, 6)]
    assert L.covers(["a", "a"], [["a"]]) == [(0, 0), (1, 1)]


def test_or_fallback_only_without_hits(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "chunk_id bigint, content string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "beta delta"), (3, "the of")], "query_id bigint, query string")
    got = {(r["query_id"], r["chunk_id"], r["leg"]) for r in L.search(queries, chunks, 10).collect()}
    assert got == {(1, 1, "and"), (2, 1, "or")}


def test_substring_score_matches_brute_force(spark):
    texts = {1: "cat concatenate dog", 2: "dogs dog cat cat"}
    queries = {1: "cat dog cat", 2: "con"}
    q = spark.createDataFrame(list(queries.items()), "query_id bigint, query string")
    c = spark.createDataFrame(list(texts.items()), "chunk_id bigint, content string")
    want = {
        (i, j): n
        for i, a in queries.items()
        for j, b in texts.items()
        if (n := sum(t in w for t in a.split() for w in b.split()))
    }
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in L.substring_scores(q, c).collect()} == want


def test_search_without_vectors_is_text_only(spark):
    chunks = spark.createDataFrame([(1, 1, "a.txt", "alpha beta gamma delta"), (2, 2, "b.txt", "other words in here now")], "chunk_id bigint, doc_id bigint, doc_name string, content string")
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id bigint, query string")
    none = spark.createDataFrame([], "item_id bigint, vector array<float>")
    qv = spark.createDataFrame([], "query_id bigint, vector array<float>")
    assert [r["chunk_id"] for r in R.hybrid_search(queries, qv, chunks, none, 5).collect()] == [1]


CANDIDATE = (
    "query_id bigint, query string, target_document string, active_document bigint, topic string, chunk_id string, doc_id string, "
    "doc_name string, content string, vector_score double, parent_headings array<string>, rank int, chunk_index int"
)


def candidate(query, rows, target=None, topic=None):
    return [(1, query, target, None, topic, c, d, n, t, s, p, i + 1, i) for i, (c, d, n, t, s, p) in enumerate(rows)]


def test_selection_keeps_the_matching_document(spark):
    rows = candidate(
        "Explain the hotel booking data",
        [
            ("hotel-1", "hotel", "hotel.csv", "Hotel booking records include reservation dates, room types and guests.", 0.62, []),
            ("case-1", "case", "case.docx", "AI RAG and Summary provide document search and related case studies.", 0.2, []),
            ("python-1", "python", "python.pdf", "Python functions, modules, and language syntax.", 0.05, []),
        ],
    )
    out = E.judged(spark.createDataFrame(rows, CANDIDATE))
    assert [r["chunk_id"] for r in out.filter("accepted").collect()] == ["hotel-1"]
    assert out.filter("not accepted and reject_reason is null").count() == 0


def test_comparison_keeps_both_sources(spark):
    rows = candidate(
        "Compare security controls across the policy and deployment guide",
        [
            ("security-1", "policy", "security-policy.pdf", "Security controls require multifactor authentication.", 0.55, []),
            ("security-2", "deployment", "deployment-guide.pdf", "Deployment security uses role-based access.", 0.5, []),
            ("other-1", "finance", "annual-report.pdf", "Annual revenue and performance are reported by year.", 0.1, []),
        ],
    )
    got = {r["chunk_id"] for r in E.judged(spark.createDataFrame(rows, CANDIDATE)).filter("accepted").collect()}
    assert got == {"security-1", "security-2"}


def test_missing_topic_and_wrong_document_are_told(spark):
    rows = candidate(
        "Explain The Entrepreneurial State", [("a", "a", "a.pdf", "State policy for entrepreneurs in general terms.", 0.9, [])]
    )
    assert E.judged(spark.createDataFrame(rows, CANDIDATE)).first()["reject_reason"] == "Named topic is absent from the evidence"
    rows = candidate("Explain booking", [("a", "a", "other.pdf", "booking facts and more booking facts", 0.9, [])], target="hotel")
    assert E.judged(spark.createDataFrame(rows, CANDIDATE)).first()["reject_reason"].startswith("Document mismatch")


def test_parent_section_brings_its_siblings(spark):
    rows = candidate("Explain core features", [("c1", "d", "d.docx", "User login and access rules.", 0.4, ["Core Features"])], target="d", topic="core feature")
    chunks = spark.createDataFrame(
        [("c1", "d", "d.docx", "User login", ["Core Features"]), ("c2", "d", "d.docx", "Search text", ["Core Features"]), ("c3", "d", "d.docx", "Prices", ["Offer"]), ("c4", "e", "e.docx", "Else", ["Core Features"])],
        "chunk_id string, doc_id string, doc_name string, content string, parent_headings array<string>",
    )
    out = R.with_parent_sections(spark.createDataFrame(rows, CANDIDATE), chunks)
    assert {(r["chunk_id"], r["section_scope_match"]) for r in out.collect()} == {("c1", False), ("c2", True)}
    heading = R.parent_heading(spark.createDataFrame(rows, CANDIDATE)).first()
    assert heading["heading"] == "Core Features"
    sections = spark.createDataFrame([(1, "1.1"), (1, "1.2"), (2, "3")], "query_id bigint, section_number string")
    heads = spark.createDataFrame([(1, "Core"), (2, "X")], "query_id bigint, heading string")
    assert [(r["query_id"], r["sections"]) for r in E.complete_sections(sections, heads).collect()] == [(1, 2)]


def test_budget_keeps_the_first_row_however_long(spark):
    rows = spark.createDataFrame([(1, "a", "x" * 20000, 1), (1, "b", "y", 2), (2, "c", "z" * 100, 1), (2, "d", "w" * 100, 2)], "g int, doc_name string, content string, rank int")
    got = {(r["g"], r["doc_name"]) for r in E.within_budget(rows, "g", [F.col("rank")]).collect()}
    assert got == {(1, "a"), (2, "c"), (2, "d")}


def test_names_containing(spark):
    names = spark.createDataFrame([(1, "Annual Report 2020.pdf"), (2, "ab.txt")], "doc_id bigint, doc_name string")
    fragments = spark.createDataFrame([("report 2",), ("AB",), ("zz",)], "fragment string")
    assert {(r["fragment"], r["doc_id"]) for r in L.names_containing(fragments, names).collect()} == {("report 2", 1), ("AB", 2)}


def test_grounding(spark):
    from lectern.operators.embed import embedder, hashing_model
    from lectern.operators.grounding import answer_verdicts

    answers = spark.createDataFrame(
        [
            (1, "<p>Hotel bookings include reservation dates and room types. (Source: hotel.csv)</p>"),
            (2, "<p>Python modules define reusable programming functions.</p>"),
            (3, "# Heading"), (4, "No evidence for this long sentence at all."),
        ], "answer_id bigint, answer string",
    )
    proof = spark.createDataFrame([(i, 1, "Hotel booking records include reservation dates and room types.") for i in (1, 2, 3)], "answer_id bigint, evidence_id bigint, text string")
    got = {r["answer_id"]: r["grounded"] for r in answer_verdicts(answers, proof, embedder(hashing_model(2048))).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_ties_at_the_cut_with_ids_of_any_sign():
    rng = np.random.default_rng(9)
    for trial in range(300):
        n, k = int(rng.integers(5, 60)), int(rng.integers(1, 5))
        scores = rng.integers(0, 4, (3, n)) / 4.0
        ids = rng.choice(np.concatenate([rng.integers(-(2**62), 2**62, 100), 2**53 + np.arange(50), -(2**53) - np.arange(50)]), n, replace=False)
        empty = (np.empty((3, 0)), np.empty((3, 0), np.int64))
        found, names = V._kept_best(*empty, scores, ids, k)
        for row in range(3):
            best = sorted(zip(-scores[row], ids.tolist()))[:k]
            assert list(zip(-found[row], names[row].tolist())) == best
    scores = np.array([[0.9] + [0.5] * 20])
    found, names = V._kept_best(np.empty((1, 0)), np.empty((1, 0), np.int64), scores, np.array([7, *range(-100, -80)]), 2)
    assert found.tolist() == [[0.9, 0.5]] and names.tolist() == [[7, -100]]


def test_a_common_title_phrase_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "NAME_BLOCK", 4)
    names = [(k, f"en src {k} rare word.txt" if k % 3 else "lone") for k in range(20)] + [(5, "second name.txt"), (5, "en src 5.txt")]
    docs = spark.createDataFrame(names, "doc_id long, doc_name string")
    texts = [(k, "compare en src 7 and rare word" if k % 2 else "second name en src") for k in range(15)] + [(3, "second name"), (40, "src en")]
    asked = spark.createDataFrame(texts, "query_id long, query string")
    words = lambda t: t.replace(".", " ").split()
    runs = lambda w: set(zip(w, w[1:]))
    wanted = {(q, d) for q, t in texts for d, n in names if runs([w for w in words(t) if w != "and"]) & runs(words(n))}
    found = L.title_matches(asked, docs)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    # Pairs are not moved once they are made: nothing but the filter and the columns stands over the join.
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line for line in plan[:3])


def test_words_of_a_chunk_are_counted_where_they_are(spark, monkeypatch):
    q = spark.createDataFrame([(1, "and anda banana"), (2, "stone one")], "query_id bigint, query string")
    texts = [(1, "The banana stands: bandana band banana banana"), (2, "a lone stone on one stonework stonestone"), (3, None), (4, "")]
    c = spark.createDataFrame(texts, "chunk_id bigint, content string")
    few = L.substring_scores(q, c)
    plan = few._jdf.queryExecution().executedPlan().toString()
    # Dealt out by chunk once; words and scores are neither moved nor joined by a shuffle.
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert moved.count("chunk_id") == 1 and set(moved) == {"chunk_id", "term"} and "SortMergeJoin" not in plan
    monkeypatch.setattr(L, "FEW_ROWS", 0)
    many = L.substring_scores(q, c)
    assert sorted(few.collect()) == sorted(many.collect())
    assert {(r["query_id"], r["chunk_id"]) for r in few.collect()} == {(1, 1), (2, 2)}


def test_terms_of_a_long_query_are_counted_by_the_substrings_of_words():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(300)]
    terms, lines = words[:120], [words[100:200], words[200:], [], ["abcabc", "abcabc"]]
    assert R.counts_in_words(terms, lines) == [sum(t in w for t in terms for w in line) for line in lines]
    assert R.counts_in_words([], lines) == [0] * 4


def test_or_search_deals_chunks_over_as_many_tasks_as_their_pairs_need(spark, monkeypatch):
    q = spark.createDataFrame([(i, t, g) for i, t, g in [(1, "wolves and bears", "a"), (2, "bear", "a"), (3, "the of", "a"), (4, "bear wolf", "b")]], "query_id bigint, query string, own string")
    texts = [(i, "the bear met bears, wolf " + "wolves " * (i % 3), "ab"[i % 2]) for i in range(40)] + [(40, None, "a"), (41, "", "b")]
    c = spark.createDataFrame(texts, "chunk_id bigint, content string, own string")

    def rows(group):
        return sorted((r["query_id"], r["chunk_id"], r["score"]) for r in L.or_hits(q, c, 8, group).collect())

    whole, owned = rows(None), rows("own")
    want = {1: lambda i: 2 + i % 3, 2: lambda i: 2, 4: lambda i: 3}
    assert whole == sorted((k, i, float(n(i))) for k, n in want.items() for i in range(40))
    assert owned == [(k, i, n) for k, i, n in whole if (k == 4) == (i % 2 == 1)]
    monkeypatch.setattr(L, "TASK_PAIRS", 16)
    hits = L.or_hits(q, c, 8)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    # 40 chunks have 319 pairs of an occurrence and a query: 20 tasks, and nothing is moved but by chunk.
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\d+)\)", plan)
    assert moved == [("chunk_id", "20")] and plan.count("Exchange hashpartitioning") == 1
    assert rows(None) == whole and rows("own") == owned
    monkeypatch.setattr(L, "FEW_ROWS", 0)
    assert rows(None) == whole and rows("own") == owned
