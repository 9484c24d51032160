"""The pivot join against all pairs, and what it skips."""

import numpy as np
import pytest

from lectern.operators import lexical as L
from lectern.operators import pivots as PV
from lectern.operators import vectors as V

QUERY, ITEM = "query_id bigint, vector array<double>", "item_id bigint, vector array<double>"


def clustered(n, seed, clusters=40, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return centres[rng.integers(0, clusters, n)] + rng.normal(scale=0.05, size=(n, dims))


def frame(spark, ids, vectors, schema):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)], schema)


def brute(q, x, floor):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(unit(q) @ unit(x).T, V.DIGITS) >= floor


@pytest.mark.parametrize("floor", [0.1, 0.5, 0.9, 0.999, 1.0])
def test_every_pair_over_the_floor(spark, floor):
    rng = np.random.default_rng(5)
    x = np.concatenate([clustered(300, 1), rng.normal(size=(60, 16)), clustered(20, 1)[:10]])
    q = np.concatenate([x[:50] * 3.0, rng.normal(size=(30, 16))])
    cells = PV.build_cells(frame(spark, range(len(x)), x, ITEM), bundle_rows=20)
    got = PV.near_pairs(frame(spark, range(len(q)), q, QUERY), cells, floor).collect()
    want = {(a, b) for a, b in zip(*np.nonzero(brute(q, x, floor)))}
    assert len(got) == len(want) and {(r["query_id"], r["item_id"]) for r in got} == want
    links = PV.near_links(frame(spark, range(len(q)), q, QUERY), cells, floor).collect()
    assert {r["query_id"]: r["links"] for r in links} == {a: int(n) for a, n in enumerate(brute(q, x, floor).sum(axis=1)) if n}


def test_hot_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "ITEM_BLOCK", 16)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    x = np.concatenate([np.tile(np.eye(16)[0], (70, 1)), clustered(80, 2)])
    q = np.concatenate([np.tile(np.eye(16)[0], (20, 1)), clustered(15, 2)])
    cells = PV.build_cells(frame(spark, range(len(x)), x, ITEM))
    assert cells.table["rows"].max() >= 70
    got = PV.near_pairs(frame(spark, range(len(q)), q, QUERY), cells, 0.8).collect()
    want = {(a, b) for a, b in zip(*np.nonzero(brute(q, x, 0.8)))}
    assert len(got) == len(want) and {(r["query_id"], r["item_id"]) for r in got} == want


def test_odd_vectors_and_empty_tables(spark):
    x = [None, [0.0, 0.0], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 0.0], [1.0, 0.0]]
    items = frame(spark, [1, 2, 3, 4, -5, -5], x, ITEM)
    queries = frame(spark, [7, 8, 9], [[2.0, 0.0], None, [0.0, 0.0]], QUERY)
    got = [(r["query_id"], r["item_id"], r["score"]) for r in PV.near_pairs(queries, items, 0.5).collect()]
    assert got == [(7, -5, 1.0)] * 2
    for q, i in ((queries.limit(0), items), (queries, items.limit(0)), (queries, items.filter("item_id = 1"))):
        assert PV.near_pairs(q, i, 0.5).collect() == []
    assert PV.multiplied(queries, PV.build_cells(items.limit(0)), 0.5).first()["met"] == 0
    with pytest.raises(ValueError):
        PV.near_pairs(queries, items, 0.0)


def test_large_query_sets_of_similar_pairs_go_by_pivots(spark):
    x = clustered(200, 3)
    q_df, i_df = frame(spark, range(40), x[:40], QUERY), frame(spark, range(200), x, ITEM)
    rows = lambda df: sorted((r["query_id"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(V.similar_pairs(q_df, i_df, 0.7, broadcast_bytes=64)) == rows(V.similar_pairs(q_df, i_df, 0.7))


def test_products_grow_slower_than_the_square(spark):
    met = []
    for n in (200, 800):
        # As a corpus grows, so do its clusters.
        x = clustered(n, n, clusters=n // 10)
        cells = PV.build_cells(frame(spark, range(n), x, ITEM), bundle_rows=16)
        row = PV.multiplied(frame(spark, range(n), x, QUERY), cells, 0.95).first()
        assert row["pairs"] == n * n
        met.append(row["met"])
    assert met[0] < 0.5 * 200**2 and met[1] < 12 * met[0]


def test_fragments_by_two_pieces_at_a_distance(spark):
    rng = np.random.default_rng(4)
    names = ["".join(rng.choice(list("aab1 .A"), rng.integers(0, 14))) for _ in range(120)] + [None, "Ünï cödé ümlaut.txt", "x" * 300]
    cuts = [n[i : i + int(k)] for n in names if n for i, k in [(int(rng.integers(0, len(n))), rng.integers(1, 9))]]
    fragments = [*cuts, "", None, "zzz", "aaaa", "ÜNÏ", "CÖDÉ üm", "x" * 40]
    f = spark.createDataFrame([(x,) for x in fragments], "fragment string")
    d = spark.createDataFrame(list(enumerate(names)), "doc_id bigint, doc_name string")
    got = [(r["fragment"], r["doc_id"]) for r in L.names_containing(f, d).collect()]
    want = {(x, i) for x in fragments if x for i, n in enumerate(names) if n and x.lower() in n.lower()}
    assert len(got) == len(set(got)) and set(got) == want


def test_title_matches_among_given_pairs(spark):
    q = spark.createDataFrame([(1, "sales report for march"), (2, "annual budget plan"), (3, None)], "query_id bigint, query string")
    d = spark.createDataFrame([(10, "Sales report.pdf"), (11, "Budget plan 2.txt"), (12, None)], "doc_id bigint, doc_name string")
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 3) for b in (10, 11, 12)] + [(1, 10)], "query_id bigint, doc_id bigint")
    rows = lambda df: sorted((r["query_id"], r["doc_id"]) for r in df.collect())
    assert rows(L.title_matches(q, d, among=pairs)) == rows(L.title_matches(q, d)) == [(1, 10), (2, 11)]
    assert rows(L.title_matches(q, d, among=pairs.filter("doc_id = 11"))) == [(2, 11)]


def test_copies_are_one_class(spark):
    items = frame(spark, [9, -4, 5, 6, 7], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], None, [-0.0, 1.0]], ITEM)
    assert {(r["item_id"], r["copies"]) for r in PV.classes(items).collect()} == {(-4, 2), (5, 2)}
    got = {(r["item_id"], r["class_id"], r["copies"]) for r in PV.members(items).collect()}
    assert got == {(9, -4, 2), (-4, -4, 2), (5, 5, 2), (7, 5, 2), (6, None, None)}
    assert PV.members(items.limit(0)).collect() == []


def test_links_move_rows_once_a_block_of_the_other_side(spark, monkeypatch):
    monkeypatch.setattr(V, "ITEM_BLOCK", 8)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    x = np.random.default_rng(3).normal(size=(600, 6))
    items, queries = frame(spark, range(len(x)), x, ITEM), frame(spark, range(len(x)), x, QUERY)
    cells = PV.build_cells(items, bundle_rows=None)
    # A bundle in 16 of 600 rows, or a cell: not one for each 8 rows.
    assert cells.table["bundle"].nunique() <= 2 * PV.SIDE_BLOCKS < 600 // 8
    links = {r["query_id"]: r["links"] for r in PV.near_links(queries, items, 0.3).collect()}
    assert links == {a: int(n) for a, n in enumerate(brute(x, x, 0.3).sum(axis=1))}
