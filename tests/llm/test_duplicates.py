import random

import brute
import numpy as np
import pytest
from conftest import frame, rows

from lectern.llm import jaccard, suffixes
from lectern.llm.components import components


def ordered(found):
    return sorted(found, key=brute.key)


def test_jaccard_equals_all_pairs(docs, pairs):
    assert ordered(rows(jaccard.near_duplicates(docs))) == brute.near_duplicates(pairs)


def test_jaccard_of_nothing(none):
    assert rows(jaccard.near_duplicates(none)) == []


@pytest.fixture(scope="module")
def family():
    """Near copies at many similarities, and exact copies."""
    pick = random.Random(5)
    base = [f"w{pick.randrange(900)}" for _ in range(120)]
    out = []
    for k in range(60):
        words = list(base)
        for _ in range(k % 7):
            words[pick.randrange(120)] = f"x{pick.randrange(900)}"
        out.append((k, " ".join(words)))
    return out + [(100 + k, out[0][1]) for k in range(40)]


def test_jaccard_in_blocks(spark, family):
    table = frame(spark, [(d, t, "en") for d, t in family])
    small = jaccard.Forest(block_rows=7)
    assert ordered(rows(jaccard.near_duplicates(table, small))) == brute.near_duplicates(family)


def test_forest_shortens_prefixes():
    assert jaccard.Forest().depth == 4
    assert jaccard.Forest(target=0.5).depth == 8
    assert jaccard.Forest(trees=1, target=0.999).depth == 1


def test_one_of_each_keeps_one_row_a_group(docs, pairs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["__mark"] for r in kept.collect()} == {"f"}
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    classes = [r for r in brute.near_duplicates(pairs) if r[0] is not None]
    wordless = [r[0] for r in classes if r[4] == 0]
    leads = {r[1] for r in classes if r[4] > 0}
    # Two texts share the id 8; each leads a group of its own.
    assert sorted(ids) == sorted([*leads, *wordless, 8])


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (60, 100), (7, 7)]
    found = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{k: 0 for k in range(41)}, 50: 50, 60: 50, 100: 50}


def test_suffixes_equal_all_strings(docs, pairs):
    assert ordered(rows(suffixes.dedup(docs).drop("spans"))) == brute.repeated_bytes(pairs)


def test_suffixes_with_hot_seeds_and_many_buckets(docs, pairs, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "BUCKET_ENTRIES", 3_000)
    monkeypatch.setattr(suffixes, "OPEN_ENTRIES", 100)
    assert ordered(rows(suffixes.dedup(docs).drop("spans"))) == brute.repeated_bytes(pairs)


def test_suffixes_dealt_out_in_rounds(docs, pairs, monkeypatch):
    monkeypatch.setattr(suffixes, "DEAL_BITS", 3)
    monkeypatch.setattr(suffixes, "DEAL_ENTRIES", 5_000)
    monkeypatch.setattr(suffixes, "SCAN_ENTRIES", 70)
    monkeypatch.setattr(suffixes, "BUCKET_ENTRIES", 500)
    assert ordered(rows(suffixes.dedup(docs).drop("spans"))) == brute.repeated_bytes(pairs)


def test_buckets_are_even(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("key", suffixes.row_key())
    dealt = suffixes.deal(texts, 6).where("bucket >= 0").selectExpr("bucket", "length(seeds) AS n").groupBy("bucket").sum("n").collect()
    sizes = sorted(r[1] for r in dealt)
    assert len(sizes) == 64 and sizes[-1] < 2 * sizes[32]


def test_sets_link_alike_in_any_tile():
    pick = np.random.default_rng(2)
    base = np.unique(pick.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = [np.unique(np.where(pick.random(len(base)) < 0.06 * (k % 5), pick.integers(0, 1 << 62, len(base)).astype(np.uint64), base)) for k in range(40)]
    sets += [pick.integers(0, 1 << 62, 20).astype(np.uint64) for _ in range(4)]
    plain = [[10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)) for b in sets] for a in sets]
    for tile, columns in ((512, 2048), (7, 11)):
        root, links = jaccard.linked_sets(sets, None, 8, 10, columns, tile)
        assert links.tolist() == [sum(row) - 1 for row in plain]
        assert all(root[a] == root[b] for a in range(len(sets)) for b in range(len(sets)) if plain[a][b])
        assert root[40:].tolist() == list(range(40, 44)) and (root <= np.arange(44)).all()


def test_suffixes_of_repeated_rows_over_batches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 3_000)
    copy = "a row that comes again and again, the same in every batch, with words enough for several anchors in each of them"
    # In order, in one partition: a batch with many copies, then a batch with a single one.
    filler = [(k, " ".join(f"{k * j * 7919 % 100_003}" for k in range(1, 420)), "en") for j, k in ((3, 100), (5, 101))]
    table = [(7, copy)] * 12 + [(None, copy)] * 4 + [filler[0][:2], (7, copy), filler[1][:2], (None, copy)]
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    assert ordered(rows(suffixes.dedup(docs).drop("spans"))) == brute.repeated_bytes(table)


def test_suffixes_of_nothing(none):
    assert rows(suffixes.dedup(none)) == []


def test_levels_stay_logarithmic():
    levels, pick = suffixes.Levels(), np.random.default_rng(1)
    for _ in range(64):
        seeds = pick.integers(0, 1 << 60, 100).astype(np.uint64)
        levels.add(seeds, seeds, pick.integers(0, 50, 100))
        assert len(levels.arrays) <= 8
    assert len(levels.merged()[0]) == 6400


def test_cut_keeps_whole_characters(spark):
    passage = "é" * 60
    table = frame(spark, [(1, passage, "fr"), (2, "début " + passage + " fin", "fr"), (3, passage, "fr"), (4, None, "fr")])
    found = {r["doc_id"]: r["text"] for r in suffixes.cut(table).collect()}
    assert found[1] == passage and found[4] is None and 3 not in found
    assert found[2] == "début  fin"
    assert suffixes.without("aéb", np.array([[0, 2]])) == "éb"


def test_rims_are_one_row_for_a_task_and_bucket(docs, monkeypatch):
    from pyspark.sql import functions as F

    seen = []

    def counted(dealt, open_bits, settle=suffixes.settle_rims):
        seen.append((open_bits, dealt.count(), dealt.select("bucket", F.spark_partition_id()).distinct().count()))
        return settle(dealt, open_bits)

    for name, value in {"BATCH_BYTES": 2_000, "OPEN_ENTRIES": 20, "settle_rims": counted}.items():
        monkeypatch.setattr(suffixes, name, value)
    suffixes.dedup(docs).count()
    ((open_bits, dealt, tasks),) = seen
    # Not one for each block of texts.
    assert open_bits > 1 and dealt == tasks > 0
