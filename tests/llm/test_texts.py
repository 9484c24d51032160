import itertools
import math
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import ODD, frame, rows
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from lectern.llm import blocks, budgets, contamination, language, licenses, lm, pieces, quality, shards, sqlchecks

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def ordered(found):
    return sorted(found, key=brute.key)


def test_phrases_equal_all_windows(spark, docs, pairs, monkeypatch):
    items = [(1, "one two three"), (2, None), (3, ""), (None, "same same same"), (4, "one two three"), (5, ODD[5][1][:300]), (5, "two three")]
    real = [(r[0] + 50, r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    table = spark.createDataFrame(items + real, "item_id long, text string")
    expected = brute.contamination(pairs, items + real)
    assert ordered(rows(contamination.contamination(docs, table))) == expected
    monkeypatch.setattr(contamination, "WINDOWS_AT_ONCE", 900)
    monkeypatch.setattr(contamination, "CANDIDATES_AT_ONCE", 50)
    assert ordered(rows(contamination.contamination(docs, table))) == expected
    clean = contamination.clean(docs, table)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in clean.select("doc_id").collect()) == sorted(r[0] or -1 for r in expected if not r[5])


def test_phrases_without_items_or_documents(spark, docs, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in contamination.contamination(docs, nothing).collect())
    assert rows(contamination.contamination(none, nothing)) == []


def test_near_finds_words_within_a_distance(spark):
    table = frame(spark, [(1, "red a b blue", None), (2, "blue a b c d red", None), (3, "red", None)])
    found = contamination.near(contamination.build_index(table), [["Red", "blue"]], 3)
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_base_figures(docs, pairs):
    found = quality.judge(docs, quality.fit(docs, None))
    assert ordered(rows(found.drop("kept", "score"))) == brute.base_figures(pairs)
    assert all(r["score"] == 0.0 and r["kept"] != r["base_failed"] for r in found.collect())


def test_ratio_equals_counting(spark, docs, pairs):
    labels = spark.createDataFrame([(100 + k, int(k % 3 > 0), int(k % 7 == 0)) for k in range(200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality.Rules(bits=8)
    ratios = quality.fit(docs, labels, rules)
    given = {r["doc_id"]: r["held"] for r in quality.trusted(labels, rules).collect()}
    assert set(given) == {100 + k for k in range(200) if k % 3 and k % 7}
    trusted = {d for d, held in given.items() if not held}
    raw, good = np.zeros(256), np.zeros(256)
    grams = []
    for d, text in pairs:
        h = [blocks.word_hash(w) for w in brute.solid_words(text)]
        mine = [x >> 56 for x in h] + [int(x) >> 56 for x in blocks.gram_hashes(np.array(h, np.uint64), 2)]
        grams.append(mine)
        for x in mine:
            raw[x] += 1
            good[x] += d in trusted
    share = (raw + 1) / (raw.sum() + 256)
    expected = np.round(np.log((good + rules.smoothing * share) / (good.sum() + rules.smoothing) / share) * 1e6)
    assert np.abs(expected - ratios).max() <= 1
    scores = sorted((round(sum(ratios[x] for x in g) / max(1, len(g)) / 1e6, 9), d or -1) for (d, _), g in zip(pairs, grams))
    assert scores == sorted((round(r["score"], 9), r["doc_id"] or -1) for r in quality.judge(docs, ratios, rules).collect())
    kept = quality.keep(docs, ratios, rules)
    assert kept.columns == docs.columns
    assert kept.count() == quality.judge(docs, ratios, rules).where("kept").count()


def test_threshold_loses_a_share_of_held_out_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ratios = quality.fit(docs, labels)
    rules = quality.calibrated(docs, labels, ratios)
    held = quality.trusted(labels, rules).where("held")
    judged = quality.judge(docs, ratios, rules).where("not base_failed")
    own = judged.join(held, "doc_id")
    assert own.where("not kept").count() <= rules.lost * own.count()
    bad = judged.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    assert bad.where("not kept").count() > 0.9 * bad.count()
    assert quality.calibrated(docs, None, ratios) == quality.calibrated(docs.limit(0), labels, ratios) == quality.Rules()


def test_quality_of_nothing(none):
    assert rows(quality.judge(none, quality.fit(none, None))) == []


def _tokens(text):
    return [w.translate(brute.UPPER) for w in brute.solid_words(text)] + [None]


@pytest.mark.parametrize("small", [False, True])
def test_lm_equals_counting(docs, pairs, monkeypatch, small):
    if small:
        monkeypatch.setattr(lm, "SEGMENT_BYTES", 30_000)
        monkeypatch.setattr(lm, "BUCKET_ENTRIES", 2_000)
        monkeypatch.setattr(lm, "ROUND_BYTES", 20_000)
    held = [brute.remainder(d, 7) == 2 for d, _ in pairs]
    texts = [_tokens(t) for _, t in pairs]
    single, double = {}, {}
    for t, h in zip(texts, held):
        if not h:
            for a, b in zip([0, *t], t):
                single[b] = single.get(b, 0) + 1
                double[a, b] = double.get((a, b), 0) + 1
    n, v, starts = sum(single.values()), len(single), held.count(False)
    got = {}
    for r in lm.score(docs, language.id_remainder(7) == 2).collect():
        got.setdefault((r["doc_id"], r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"], round(r["base_score"], 6)), []).append(r["score"])
    exact, found = 0.0, 0.0
    for (d, _), t, h in zip(pairs, texts, held):
        plain = {w: (single.get(w, 0) + 1) / (n + v + 1) for w in t}
        base = sum(math.log10(plain[w]) for w in t)
        mine = got[d, len(t), sum(w in single for w in t), h, n, round(base, 6)]
        want = 0.0
        for a, b in zip([0, *t], t):
            before = starts if a == 0 else single.get(a, 0)
            c = double.get((a, b), 0)
            kept = lm.lower_bound(lm.level(np.array([c])))[0] if c else 0
            want += math.log10(0.5 * kept / before + 0.5 * plain[b]) if before else math.log10(plain[b])
        # A filter's wrong hits only add to a count.
        assert max(mine) >= want - 1e-6
        exact, found = exact + want, found + max(mine)
    assert abs(found / exact - 1) < 0.03


def test_lm_reads_segments_as_often_whatever_the_filters_need(docs, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(lm, "ROUND_BYTES", 2_000)
    plan = lm.score(docs, language.id_remainder(7) == 2)._jdf.queryExecution().optimizedPlan().toString()
    # Segments, totals and levels: filters are not carried to the segments in rounds.
    assert "MapInArrow" not in plan and plan.count("Relation") == 3


@cases(st.sets(st.integers(0, 2**64 - 1)))
def test_packed_keys(values):
    keys = np.array(sorted(values), np.uint64)
    assert (lm._unpack_keys(lm._pack_keys(keys)) == keys).all()


def test_bloom_levels():
    keys, counts = blocks.constants(9, 5000), np.arange(1, 5001) % 60 + 1
    table = lm.build_filter(keys, counts)
    got = lm.probe(table, keys)
    assert (got >= lm.level(counts)).all() and (got == lm.level(counts)).mean() > 0.9
    assert (lm.probe(table, blocks.constants(10, 5000)) > 0).mean() < 0.06
    assert (lm.lower_bound(lm.level(counts)) <= counts).all()


def test_lm_of_nothing(none, docs):
    assert rows(lm.score(none, F.lit(False))) == []
    assert all(r["score"] == 0.0 and r["train_tokens"] == 0 for r in lm.score(docs, F.lit(True)).collect())


def test_token_counts_equal_the_library(docs, pairs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = []
    for d, t in pairs:
        n = len(library.encode(t or ""))
        expected.append((d, len((t or "").encode()), n, n > 4096))
    assert ordered(rows(budgets.count_tokens(docs, MODEL).drop("fit_bytes"))) == ordered(expected)


@settings(max_examples=60, deadline=None)
@cases(st.text(alphabet="aé e\n▁.中th 😀in", max_size=40))
def test_every_prefix(text):
    own = budgets.counter(MODEL)
    expected = [len(own.library.encode(text[:p])) for p in range(len(text) + 1)]
    assert own.prefix_counts(text).tolist() == expected
    limit = expected[-1] // 2
    assert len(own.truncate(text, limit)) == max(p for p, n in enumerate(expected) if n <= limit)


def test_prefix_table_and_fit(spark):
    table = frame(spark, [(1, "a bc def", None), (2, None, None)])
    assert {r["doc_id"]: len(r["counts"]) for r in budgets.prefix_counts(table, MODEL).collect()} == {1: 9, 2: 1}
    long = frame(spark, [(1, "ab cd " * 400, None)])
    row = budgets.count_tokens(long, MODEL, limit=10).first()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    fit = ("ab cd " * 400)[: row["fit_bytes"]]
    assert row["over_limit"] and len(library.encode(fit)) <= 10 < len(library.encode(("ab cd " * 400)[: row["fit_bytes"] + 3]))


def test_fit_inside_a_unit(spark):
    import random

    pick = random.Random(3)
    texts = [
        "".join(chr(0x4E00 + pick.randrange(3000)) for _ in range(900)), "a few words, then " + "".join(pick.choices("abcdefghi=+/ABC012", k=900)),
        "x" * 3000, "word and   " * 90, "mark ▁ mark " * 80 + "😀" * 60, " " * 200 + "end", "under the limit ▁", "", None,
    ]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for limit in (1, 60, 130):
        found = budgets.count_tokens(frame(spark, [(k, t, None) for k, t in enumerate(texts)]), MODEL, limit).collect()
        for r in found:
            t = texts[r["doc_id"]] or ""
            want = max(p for p in range(min(len(t), 20 * limit) + 1) if len(library.encode(t[:p])) <= limit)
            assert r["fit_bytes"] == len(t[:want].encode()), (limit, r)


def test_prefixes_of_a_long_unit():
    own = budgets.counter(MODEL)
    text = "".join("abcde="[k * k * 7919 % 6] for k in range(60_000))
    counts = own.prefix_counts(text)
    assert [counts[p] for p in (17, 999, 60_000)] == [len(own.library.encode(text[:p])) for p in (17, 999, 60_000)]


def _unigram():
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_encoding_is_the_librarys_best_path_as_unigram():
    library, own = _unigram(), pieces.encoder(MODEL)
    # Short texts of known characters: the library's single precision holds their sums.
    for text in ("hello world", "the quick brown fox jumps", "été à la mer", "a  b", "Straßenbahn", "x"):
        assert own.viterbi("▁" + text.replace(" ", "▁"))[0] == library.nbest_encode(text, nbest_size=2)[0]


@settings(max_examples=80, deadline=None)
@cases(st.text(alphabet="the inra😀中\n", max_size=9))
def test_viterbi_equals_all_paths(text):
    own = pieces.encoder(MODEL)
    marked = "▁" + text.replace(" ", "▁")
    table = {p: s for p, (_, _, s) in own.automaton.items()}
    best = [0.0] + [-math.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        for low in range(end):
            s = table.get(marked[low:end], own.unknown if end - low == 1 else -math.inf)
            best[end] = max(best[end], best[low] + s)
    ids, score = own.viterbi(marked)
    assert score == best[-1]
    assert own.decode(ids) == text


def test_ids_are_the_librarys(docs, pairs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = [(r["doc_id"], r["text"], tuple(r["ids"])) for r in pieces.encode(docs, MODEL).collect()]
    assert ordered(found) == ordered([(d, t, tuple(library.encode(t or ""))) for d, t in pairs])


@settings(max_examples=80, deadline=None)
@cases(st.text(alphabet="the inra😀中\n", max_size=60))
def test_merging_equals_the_library(text):
    own = pieces.encoder(MODEL)
    library = budgets.counter(MODEL).library
    assert own.ranked("▁" + text.replace(" ", "▁"))[0] == (library.encode(text) if text else own.ranked("▁")[0])


@settings(deadline=None, max_examples=60)
@cases(st.text(alphabet="theanding \u00e9\u6f22*.\n", max_size=60))
def test_short_merging_equals_the_heap(text):
    own = pieces.encoder(MODEL)
    marked = pieces.U.MARK + text.replace(" ", pieces.U.MARK)
    ids = []
    cuts = own.merge(marked)
    for low, high in zip(cuts, cuts[1:]):
        piece = own.automaton.get(marked[low:high], None)
        ids += [piece[1]] if piece else [own.byte_ids[b] for b in marked[low:high].encode()]
    assert own.merge_short(marked)[0] == ids


def test_units_are_remembered_from_task_to_task(docs, monkeypatch):
    assert pieces.encoder(MODEL) is blocks.remembered(MODEL, pieces.Encoder)
    monkeypatch.setattr(pieces, "MEMORY_UNITS", 7)
    own, met = pieces.Encoder(MODEL), []
    encode, own.memory.work = own.memory.work, lambda texts: (met.extend(texts), encode(texts))
    block = lambda text: next(iter(blocks.blocks(pieces.pa.array([text]))))
    tokens = lambda text: own.encode_block(block(text))[0].tolist()
    want = [tokens(t) for t in ("the one", "the two", "a b c d e f g", "the end", "one two")]
    # Full after the third text: only the unit that was met in two blocks is still known.
    assert met.count("the") == 1 and met.count("one") == 2
    fresh = pieces.Encoder(MODEL)
    assert want == [fresh.encode_block(block(t))[0].tolist() for t in ("the one", "the two", "a b c d e f g", "the end", "one two")]


def test_round_trips(docs, pairs):
    found = rows(pieces.round_trips(docs, MODEL).select("doc_id", "n_bytes", "round_trip"))
    assert ordered(found) == ordered([(d, len((t or "").encode()), True) for d, t in pairs])
    back = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert all((r["text"] or "").replace("▁", " ") == r["decoded"] for r in back.collect())


def test_licenses(spark, none):
    texts = [
        (1, "See the GNU General Public License, and the  GNU-general public\nlicense."),
        (2, "Permision is hereby granted, free of charge, to any persn obtaining a copy"),
        (3, "CC BY"), (4, None), (5, ""), (6, "nothing here " * 2000 + "MIT License"), (6, "apache"), (7, "All rihgts reserved"),
        (8, "mit"), (9, "license"),
    ]
    found = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(frame(spark, [(d, t, None) for d, t in texts])).collect()}
    assert len(found) == len(texts)
    first = found[1, 12]
    assert (first["n_base"], first["first_word"], first["last_word"], first["base_labels"]) == (2, 2, 8, "gpl")
    assert found[2, 13]["labels"] == "mit" and found[2, 13]["n_base"] == 0 and 0.9 < found[2, 13]["score"] < 1
    span = found[2, 13]["spans"][0]
    assert (span["first_word"], span["last_word"], span["edits"]) == (0, 12, 2)
    assert found[6, 4002]["first_word"] == 4000
    assert found[7, 3]["labels"] == "all-rights-reserved"
    assert found[4, 0]["first_word"] is None and found[4, 0]["labels"] == "" and found[4, 0]["score"] == 0.0
    assert not found[8, 1]["labels"] and not found[9, 1]["labels"]
    assert rows(licenses.scan(none)) == []


def test_close_notices_with_different_edits(spark):
    text = "mozilla pub1ic license xx mozilla public license, mozila public licens"
    row = licenses.scan(frame(spark, [(1, text, None)])).first()
    assert [(s["label"], s["first_word"], s["last_word"], s["edits"]) for s in row["spans"]] == [
        ("mpl", 0, 2, 1), ("mpl", 4, 6, 0), ("mpl", 7, 9, 2)
    ]


def test_base_places_equal_word_search(docs, pairs):
    def places(text):
        w, at = brute.alnum_words(text), []
        for p in licenses.PHRASES:
            parts = p.split()
            at += [k for k in range(len(w)) if w[k : k + len(parts)] == parts]
        return len(w), len(at), min(at, default=None), max(at, default=None)

    found = rows(licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word"))
    assert ordered(found) == ordered([(d, *places(t)) for d, t in pairs])


@settings(max_examples=60, deadline=None)
@cases(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 18), st.sampled_from("xy z")), max_size=2))
def test_pigeonhole_finds_all_within_the_edits(edits):
    notice = licenses.Notice(b"all rights reserved", "x", 2)
    text = list("all rights reserved")
    for kind, at, char in edits:
        at = min(at, len(text) - 1)
        if kind == 0:
            text[at] = char
        elif kind == 1:
            text.insert(at, char)
        else:
            del text[at]
    raw = ("some words " + "".join(text) + " and more").encode()
    assert licenses.fuzzy(raw, np.array([0, len(raw)]), [notice])


def test_language(spark, docs, given, none):
    model = language.fit(docs.where(language.id_remainder(5) != 0))
    found = language.predict(docs, model, language.id_remainder(5) == 0).collect()
    assert len(found) == len(given)
    truth = {d: lang for d, _, lang in given if d is not None and d >= 100}
    held = [r for r in found if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(r["held_out"] == (brute.remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in found)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    empty = language.fit(none)
    assert {r["lang_pred"] for r in language.predict(docs, empty, F.lit(True)).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.fit(docs, max_languages=2)


def test_language_scores_equal_naive_bayes():
    first = np.array([0, 3, 3, 7])
    codes = np.array([97, 98, 97, 98, 99, 97, 98], np.uint32)
    counted = [(b.tolist(), s.tolist()) for b, s in language.features(codes, first, 15)]
    assert [s for _, s in counted] == [[0, 3, 3, 7], [0, 2, 2, 5], [0, 1, 1, 3]]
    assert counted[1][0][0] == counted[1][0][4]  # "ab" both times


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 50, 257])
def test_permutation(n):
    assert sorted(shards.permute(k, n, 20) for k in range(n)) == list(range(n))


def test_shards(docs, pairs, none):
    found = shards.shard(docs).collect()
    places = sorted(r["slot"] * 16 + r["shard"] for r in found)
    assert places == list(range(len(pairs)))
    sizes = [len((t or "").encode()) + 1 for _, t in pairs]
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == ordered(
        [(d, s, zlib.crc32((t or "").encode())) for (d, t), s in zip(pairs, sizes)]
    )
    order = ordered((r["doc_id"], r["text_crc32"], r["size"]) for r in found)
    number = {k: [n for n, x in enumerate(order) if x == k] for k in order}
    for r in found:
        assert r["slot"] * 16 + r["shard"] in [shards.permute(n, len(order), 20) for n in number[r["doc_id"], r["text_crc32"], r["size"]]]
    assert rows(shards.shard(none)) == []


def test_shards_do_not_depend_on_partitions(docs):
    assert ordered(rows(shards.shard(docs))) == ordered(rows(shards.shard(docs.repartition(7))))


def test_blocks_cut_whole_documents():
    import pyarrow as pa

    texts = ["ab c", None, "", "d" * 50, "é f"]
    for limit in (1, 10, 1000):
        found = list(blocks.blocks(pa.array(texts), limit))
        assert [b.data[b.offsets[k] : b.offsets[k + 1]].tobytes().decode() for b in found for k in range(b.n)] == [t or "" for t in texts]
    whole = next(blocks.blocks(pa.array(texts)))
    assert blocks.words(whole, blocks.SOLID).counts.tolist() == [2, 0, 0, 1, 2]
    assert len(set(itertools.chain.from_iterable([blocks.span_hashes(whole.data, *map(np.array, ([0, 3, 4], [2, 4, 54]))).tolist()]))) == 3


def test_sql_names_every_column():
    assert "grown_shard" in sqlchecks.sharding(16, 20) and "items_sha256" in sqlchecks.decontamination(10)


def test_all_trusted_rows_count_whichever_way_they_come(spark, docs, monkeypatch):
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted(many, quality.Rules()).count() == 60_000
    labels = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    sent = quality.fit(docs, labels)
    rules = quality.calibrated(docs, labels, sent, quality.Rules(min_words=3))
    monkeypatch.setattr(quality, "SENT_IDS", 0)
    assert (quality.fit(docs, labels) == sent).all() and sent.any()
    assert quality.calibrated(docs, labels, sent, quality.Rules(min_words=3)) == rules
