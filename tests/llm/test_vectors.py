"""Operators on vectors and token-ID files against plain numpy and the library."""

import hashlib
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import frame, rows
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import blocks, codes, qd, rans, whitening

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTES)
NAMES = "vec_id long, embedding array<float>, label int, x string, code string, n string, at string, salt string, part string"


def vectors(spark, given):
    """embeddings with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *"abcdef") for r in given], NAMES).repartition(3)


def odd_vectors(n=60, width=8):
    rng = np.random.default_rng(4)
    out = [(int(k), [float(v) for v in np.float32(rng.normal(size=width) / 3)], int(k) % 3 if k % 7 else None) for k in range(n)]
    same = out[5][1]
    out += [(200 + k, same, 1) for k in range(20)]
    out += [(7, out[8][1], 2), (7, out[7][1], 1), (-3, [-v for v in same], 0), (None, out[2][1], None)]
    out += [(300, None, 1), (301, same[:-1] + [None], 1), (302, same[:-1] + [float("nan")], 1), (303, [float("inf")] + same[1:], 1), (304, [float("-inf")] * width, 1)]
    return out + [(305, same[:5], 2), (306, [], 2), (307, [0.0] * width, None)]


def usable(given, scale, width):
    kept = [r for r in given if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    x = np.array([[int(np.floor(scale * v)) for v in r[1]] + [0] * (width - len(r[1])) for r in kept], np.int64).reshape(-1, width)
    return kept, x


def brute_codes(given, width, entries, parts=4, rounds=4):
    kept, x = usable(given, 1024, width)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, x[k].tolist()))
    step = width // parts
    cut = [x[:, p * step : (p + 1) * step] for p in range(parts)]
    books = [c[order[:entries]].copy() for c in cut]

    def nearest(p):
        d = ((cut[p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            own, _ = nearest(p)
            for e in set(own.tolist()):
                books[p][e] = cut[p][own == e].sum(axis=0) // (own == e).sum()
    found = [nearest(p) for p in range(parts)]
    error = sum(f[1] for f in found)
    by_label = Counter()
    for r, e in zip(kept, error.tolist()):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{f[0][k]:02x}" for f in found), int(error[k]), by_label[r[2]], digest) for k, r in enumerate(kept)), key=brute.key)


@pytest.mark.parametrize("entries", [16, 256])
def test_codes_equal_all_distances(spark, entries):
    given = odd_vectors()
    found = codes.compress(vectors(spark, given), entries=entries)
    assert sorted(rows(found.drop("distances")), key=brute.key) == brute_codes(given, 8, entries)


def test_codes_of_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = codes.compress(table).collect()
    assert sorted((tuple(r)[:5] for r in found), key=brute.key) == brute_codes([tuple(r) for r in table.collect()], 64, 256)
    assert np.mean([r["distances"] for r in found]) < 0.5 * 4 * 256 * 5


def test_codes_of_nothing(spark):
    assert rows(codes.compress(vectors(spark, []))) == []
    assert rows(codes.compress(vectors(spark, [(1, None, 2)]))) == []
    with pytest.raises(Exception, match="exact range"):
        codes.compress(vectors(spark, [(1, [1e30], 2)])).collect()


def test_large_numbers_stay_exact(spark):
    given = [(k, [float(np.float32(v)) for v in np.random.default_rng(k).normal(size=4) * 20_000], 0) for k in range(40)]
    assert sorted(rows(codes.compress(vectors(spark, given), entries=8).drop("distances")), key=brute.key) == brute_codes(given, 4, 8)


def test_net_moves_are_at_most_sums_of_drifts():
    rng = np.random.default_rng(1)
    history = [rng.integers(-500, 500, (32, 5)) for _ in range(5)]
    groups = codes.grouped(history[0], 8)
    assert sorted(np.concatenate(groups).tolist()) == list(range(32))
    net = codes.net_moves(history, groups)
    drift = [np.sqrt(((b - a) ** 2).sum(axis=1)) for a, b in zip(history, history[1:])]
    for s in range(5):
        for g, own in enumerate(groups):
            assert net[s, g] <= sum(d[own].max() for d in drift[s:]) * (1 + 1e-9)


def test_decoded_vectors_are_near(spark):
    given = [r for r in odd_vectors() if r[0] is not None and r[0] < 60 and r[0] >= 0]
    table = vectors(spark, given)
    points, width = codes.G.on_grid(table, "embedding", ["vec_id", "label"], 1024, 1 << 27, 4)
    state, books = codes.fit(points, width, entries=256)
    back = codes.decode(state.select("vec_id", F.lower(F.hex("code")).alias("code")), books).collect()
    exact = {r[0]: r[1] for r in given if r[0] != 7}
    assert max(abs(a - b) for r in back if r["vec_id"] in exact for a, b in zip(r["vector"], exact[r["vec_id"]])) < 1e-3


# ---- whitening ----------------------------------------------------------------
@pytest.mark.parametrize("name", ["odd", "sf0.001"])
def test_whitening_equals_a_dense_solver(spark, name):
    if name == "odd":
        given, width, table = odd_vectors(), 8, vectors(spark, odd_vectors())
    else:
        table, width = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), 64
        given = [tuple(r) for r in table.collect()]
    kept, x = usable(given, 256, width)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:4], directions[:, ::-1][:, :4]
    expected = ((x * n - sums) / n) @ directions / np.sqrt(values)
    found = whitening.whiten(table).collect()
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter((r[0], k) for r in kept for k in range(1, 5))
    assert {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-10
    total = np.trace(centred.T @ centred) / n
    for k in range(4):
        own = sorted((r["vec_id"] or -9, r["deviation"], round(abs(r["whitened"]), 7)) for r in found if r["component"] == k + 1)
        plain = [(r[0] or -9, int(((n * v - sums) ** 2).sum()), round(abs(float(w)), 7)) for r, v, w in zip(kept, x, expected[:, k])]
        for a, b in zip(own, sorted(plain)):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6
        assert all(abs(r["explained"] - values[k] / total) < 1e-9 for r in found if r["component"] == k + 1)
        # One sign for all rows.
        signed = {r["vec_id"]: r["whitened"] for r in found if r["component"] == k + 1}
        ratio = [signed[r[0]] * float(w) > 0 for r, w in zip(kept, expected[:, k]) if r[0] not in (7, None) and abs(w) > 1e-6]
        assert all(ratio) or not any(ratio)


def test_whitening_without_variation(spark):
    assert rows(whitening.whiten(vectors(spark, []))) == []
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0), (2, None, 0)])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [
        (v, k, 1, 0, None, 0.0, 0.0) for v in (1, 2) for k in (1, 2)
    ]
    line = whitening.whiten(vectors(spark, [(k, [k / 2.0, k / 2.0, 1.0], 0) for k in range(5)])).collect()
    assert [r["whitened"] is None for r in sorted(line)] == [False, True, True] * 5
    assert {round(abs(r["whitened"]), 9) for r in line if r["component"] == 1} == {0.0, round(0.5**0.5, 9), round(2**0.5, 9)}


@settings(max_examples=60, deadline=None)
@cases(st.integers(1, 9), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([1, 3, 1000]))
def test_qd_equals_a_dense_solver(n, m, seed, top):
    matrix = np.random.default_rng(seed).integers(-top, top + 1, (m, n)).astype(float)
    r = np.linalg.qr(matrix, mode="r")
    r = np.vstack([r, np.zeros((max(0, n - len(r)), n))])
    values, directions = qd.right_vectors(r, 4)
    square, k = matrix.T @ matrix, min(4, n)
    size = max(1.0, np.abs(square).max()) * n
    assert np.abs(np.linalg.eigvalsh(square)[::-1] - values).max() < 1e-12 * size
    assert np.abs(square @ directions - directions * values[:k]).max() < 1e-11 * size
    assert np.abs(directions.T @ directions - np.eye(k)).max() < 1e-10


@pytest.mark.parametrize("gap", [0.0, 1e-14, 1e-9, 1e-4])
def test_qd_with_near_values(gap):
    rotation = np.linalg.qr(np.random.default_rng(3).normal(size=(24, 24)))[0]
    matrix = np.diag([4 + gap * k for k in range(6)] + [1.0] * 18) @ rotation
    values, directions = qd.right_vectors(np.linalg.qr(matrix, mode="r"), 4)
    assert np.abs(directions.T @ directions - np.eye(4)).max() < 1e-12
    assert np.abs(matrix.T @ (matrix @ directions) - directions * values[:4]).max() < 1e-12


# ---- token-ID files -----------------------------------------------------------
def library(texts):
    return [np.array([*e.ids, 0], "<u4") for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def placed(pairs):
    out, at = [], 0
    for (doc, _), ids in zip(pairs, library([t for _, t in pairs])):
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_the_library_s_ids(spark, docs, pairs, none, monkeypatch):
    found = rows(rans.round_trip(docs, BYTES))
    ties = [d for d, n in Counter(d for d, _ in pairs).items() if n > 1]
    ordered = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = placed(ordered)
    assert sorted(r for r in found if r[0] not in ties and r[0] is not None) == sorted(r for r in expected if r[0] not in ties and r[0] is not None)
    assert Counter((r[0], *r[2:]) for r in found) == Counter((r[0], *r[2:]) for r in expected)
    at = 0
    for _, start, n, _ in sorted(found, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] is None for r in sorted(found, key=lambda r: r[1])] == [True] * 2 + [False] * (len(found) - 2)
    assert rows(rans.round_trip(none, BYTES)) == []


def test_many_blocks_and_segments(spark, docs, pairs, monkeypatch, tmp_path):
    expected = Counter((r[0], *r[2:]) for r in placed(pairs))
    monkeypatch.setattr(rans, "BLOCK", 700)
    monkeypatch.setattr(rans, "STEPS", 4)
    monkeypatch.setattr(rans, "SEGMENT", 4 * rans.LANES)
    rans.write(docs, str(tmp_path / "out"), BYTES)
    found = rans.read(spark, str(tmp_path / "out")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert Counter((r[0], r[2], r[3]) for r in found) == expected
    assert spark.read.parquet(str(tmp_path / "out/blocks")).count() > 100


def test_a_text_of_several_megabytes(spark):
    text = "".join(f"word{k * 7919 % 5003} " if k % 50 else "x" * 300 for k in range(300_000))
    assert len(text) > 3_000_000
    table = frame(spark, [(1, text, "en"), (2, "short", "en")])
    assert sorted(rows(rans.round_trip(table, BYTES))) == placed([(1, text), (2, "short")])


def test_a_damaged_block_is_told():
    coder = rans.Coder(rans.quantised(np.arange(50)))
    ids = np.random.default_rng(2).integers(0, 50, 40_000).astype(np.uint32)
    (block,) = coder.encode([ids])
    read = {**block, "stream": np.concatenate(block["words"]), "name": (3, 4)}
    assert (coder.decode([read])[0] == ids).all()
    read["stream"][len(read["stream"]) // 2] ^= 64
    with pytest.raises(ValueError, match=r"block \(3, 4\)"):
        coder.decode([read])


@settings(max_examples=40, deadline=None)
@cases(st.lists(st.integers(0, 3 * rans.SEGMENT), max_size=4), st.integers(1, 300), st.integers(0, 10**6))
def test_coder_gives_back_any_ids(sizes, vocabulary, seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 1000, vocabulary) * (rng.random(vocabulary) < 0.5)
    table = rans.quantised(counts)
    assert table.sum() == 1 << rans.SCALE and table.min() >= 1
    coder = rans.Coder(table)
    groups = [rng.integers(0, vocabulary, n).astype(np.uint32) for n in sizes]
    made = coder.encode(groups)
    read = [{**b, "stream": np.concatenate(b["words"]) if b["words"] else np.empty(0, np.uint32)} for b in made]
    for ids, back in zip(groups, coder.decode(read)):
        assert (ids == back).all()


def test_files_are_near_the_entropy():
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.zipf(1.3, 200_000), 40_000).astype(np.uint32)
    counts = np.bincount(ids, minlength=50_257)
    (block,) = rans.Coder(rans.quantised(counts)).encode([ids])
    size = 4 * sum(map(len, block["words"])) + 8 * sum(map(len, block["states"]))
    share = counts[counts > 0] / len(ids)
    assert size < 1.06 * -(share * np.log2(share)).sum() * len(ids) / 8


PARTS = st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "　", " ", "\u0085", "a", "Z9", "é", "中", "'s", "'", "!", "ſ", "<|endoftext|>", "​", "😀", "\x00", "ñ"])


@settings(max_examples=300, deadline=None)
@cases(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=4))
def test_pieces_have_the_library_s_ids(texts):
    raw = [t.encode() for t in texts]
    block = blocks.Block(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ids, counts = rans.tokens(BYTES).of(block)
    expected = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)] if texts else []
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [x for e in expected for x in e]
