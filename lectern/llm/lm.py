"""LM scoring: a log-frequency Bloom filter of bigram counts and interpolated probabilities.

Tokens are the words (runs of anything but ASCII white space, ASCII lower-cased)
of the whole text and one end token. Counts come from every training document.

Every block of documents becomes a segment: its distinct token hashes in order
(the vocabulary) and its tokens as numbers into it. Segments are a table in the
shared folder. Two things are then gathered from all segments, each combined
inside the segment first and dealt out by hash:

* token counts, exact: a bucket adds up one entry per segment and token and sends
  the totals back to the segments that asked;
* bigram counts: a bucket adds up and stores them in its own **log-frequency Bloom
  filter**. A count c is kept as its level ``1 + floor(log c / log 1.5)``: the pair
  (bigram, j) is inserted for j = 1 .. level. A probe asks for j = 1, 2, ... until
  the first miss, and the level's lower bound is the count. Wrong hits can only
  raise it, and it is capped by the exact counts of both tokens.

A filter never leaves its bucket: the bigrams of all segments, those of held-out
texts among them, come to it, each is probed once, and the levels go back to the
segments that asked. So a segment is read as often whatever the corpus.

``p(w | h) = W * c(h w) / c(h) + (1 - W) * (c(w) + 1) / (N + V + 1)``, the second
part alone where h was not seen; the first token's h is the text's start.

Cases: a null or empty text is the end token alone. Repeated rows teach and are
scored one by one; a null doc_id counts as empty text in the hold-out rule. Very
long texts make a longer segment. Without training rows N = V = 0 and every token
has probability 1. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.session import kept

SEGMENT_BYTES = 2 << 20
BUCKET_ENTRIES = 2_000_000
#: Bytes of bigrams that meet a filter at once.
ROUND_BYTES = 64 << 20
LEVEL_BASE = 1.5
PROBES = 3
BITS_PER_INSERT = 8
WEIGHT = 0.5
END = np.uint64(B.constants(3, 2)[0])
START = np.uint64(B.constants(3, 2)[1])

SEGMENTS = (
    "segment long, doc_ids array<long>, held array<boolean>, sizes array<int>, vocabulary binary, tokens binary, "
    "n_train long, n_train_docs long, n_vocabulary long, n_pairs long"
)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes: their steps, byte by byte of the steps, as the upper bytes are nearly all zero."""
    return _pack(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(_unpack(raw, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def lower_bound(levels: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 for none."""
    return np.where(levels > 0, np.ceil(LEVEL_BASE ** (levels - 1.0) - 1e-9), 0.0)


def pair_keys(vocabulary: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it in its text."""
    hashes = vocabulary[tokens]
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return B.mixed(before * np.uint64(0x9E3779B97F4A7C15) + (hashes ^ (before >> np.uint64(31))))


def segments(docs: DataFrame, held_out: Column) -> DataFrame:
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in B.blocks(batch.column("text"), SEGMENT_BYTES):
                found = B.words(block, B.SOLID)
                hashes = B.span_hashes(B.LOWER[block.data], found.start, found.end)
                hashes[hashes == END] = START  # keeps the end token apart from every word
                sizes = found.counts + 1
                all_tokens = np.insert(hashes, found.first[1:], END)
                vocabulary, tokens = np.unique(all_tokens, return_inverse=True)
                part = batch.slice(block.row, block.n)
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                train = ~np.repeat(held, sizes)
                pairs = np.unique(pair_keys(vocabulary, tokens, sizes)[train])
                one = pa.array([0, block.n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.ListArray.from_arrays(one, part.column("doc_id").cast(pa.int64())),
                        pa.ListArray.from_arrays(one, pa.array(held)),
                        pa.ListArray.from_arrays(one, pa.array(sizes, pa.int32())),
                        pa.array([_pack_keys(vocabulary)], pa.binary()),
                        pa.array([_pack(tokens.astype(np.int32))], pa.binary()),
                        pa.array([int(train.sum())]),
                        pa.array([int((~held).sum())]),
                        pa.array([len(vocabulary)]),
                        pa.array([len(pairs)]),
                    ],
                    [c.strip().split(" ")[0] for c in SEGMENTS.split(", ")],
                )
                number += 1

    # The fractions of a hash's range that go to one bucket follow from these rows' sizes.
    return kept(B.modest(docs).select("doc_id", "text", held_out.alias("held")).mapInArrow(run, SEGMENTS), "lm-segments")


def _segment(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array(row["sizes"], np.int64)
    return _unpack_keys(row["vocabulary"]), _unpack(row["tokens"], np.int32), sizes, np.array(row["held"], bool)


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket starts in sorted keys."""
    edges = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _bits(entries: int) -> int:
    return max(0, math.ceil(math.log2(max(1, entries) / BUCKET_ENTRIES)))


PAYLOAD = "bucket int, segment long, keys binary, counts binary"


def token_payload(found: DataFrame, bits: int) -> DataFrame:
    """For each segment and bucket: its tokens and their training counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, tokens, sizes, held = _segment(row)
                counts = np.bincount(tokens[~np.repeat(held, sizes)], minlength=len(vocabulary)).astype(np.uint32)
                yield _payload(row["segment"], vocabulary, counts, bits)

    return found.select("segment", "held", "sizes", "vocabulary", "tokens").mapInArrow(run, PAYLOAD)


def pair_payload(found: DataFrame, bits: int) -> DataFrame:
    """For each segment and bucket: its bigrams and their training counts; 48 bits of hash below the bucket's."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, tokens, sizes, held = _segment(row)
                keys, which = np.unique(pair_keys(vocabulary, tokens, sizes), return_inverse=True)
                counts = np.bincount(which[~np.repeat(held, sizes)], minlength=len(keys))
                yield _payload(row["segment"], keys, counts.astype(np.uint32), bits, short=True)

    return found.select("segment", "held", "sizes", "vocabulary", "tokens").mapInArrow(run, PAYLOAD)


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys << np.uint64(bits)) >> np.uint64(16)


def _payload(segment: int, keys: np.ndarray, counts: np.ndarray, bits: int, short: bool = False) -> pa.RecordBatch:
    cuts = _cuts(keys, bits)
    raw = _short(keys, bits) if short else keys
    full = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full, pa.int32()),
            pa.array(np.full(len(full), segment), pa.int64()),
            pa.array([_pack_keys(raw[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
            pa.array([_pack(counts[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
        ],
        ["bucket", "segment", "keys", "counts"],
    )


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
    return ranked[first], np.add.reduceat(counts[order], first) if len(first) else counts


TOTALS = "segment long, bucket int, totals binary, n_distinct long"


def token_totals(payload: DataFrame) -> DataFrame:
    """Totals sent back to each segment; a row with segment -1 has the bucket's number of known tokens."""

    def run(key, table):
        parts = [_unpack_keys(x) for x in table.column("keys").to_pylist()]
        counts = [_unpack(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()]
        keys, sums = _summed(np.concatenate(parts), np.concatenate(counts))
        back = [_pack(sums[np.searchsorted(keys, p)]) for p in parts]
        n = len(parts)
        return pa.table(
            {
                "segment": pa.array(table.column("segment").to_pylist() + [-1], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int32()),
                "totals": pa.array([*back, b""], pa.binary()),
                "n_distinct": pa.array([0] * n + [int((sums > 0).sum())], pa.int64()),
            }
        )

    return payload.groupBy("bucket").applyInArrow(run, TOTALS)


def _places(keys: np.ndarray, step: int, probe: int, n_bits: int) -> np.ndarray:
    return B.mixed(keys + B.constants(50 + probe, 64)[step % 64] * np.uint64(2 * (step // 64) + 1)) % np.uint64(n_bits)


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of a filter with ``BITS_PER_INSERT`` bits for each (key, level) put in."""
    levels = level(counts)
    n_bits = max(64, int(levels.sum()) * BITS_PER_INSERT)
    flags = np.zeros(n_bits, bool)
    step = 1
    while len(keys):
        for probe in range(PROBES):
            flags[_places(keys, step, probe, n_bits)] = True
        step += 1
        stays = levels >= step
        keys, levels = keys[stays], levels[stays]
    return np.packbits(flags, bitorder="little")


def probe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key: the last of 1, 2, ... that the filter holds."""
    n_bits = len(table) * 8
    out = np.zeros(len(keys), np.uint8)
    alive = np.arange(len(keys))
    step = 1
    while len(alive) and step < 255:
        for k in range(PROBES):
            at = _places(keys[alive], step, k, n_bits)
            alive = alive[(table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out[alive] = step
        step += 1
    return out


def levels(payload: DataFrame) -> DataFrame:
    """Levels sent back to each segment, from the filter of each bucket of bigrams; buckets count from -1 down."""

    def run(key, table):
        parts = [_unpack_keys(x) for x in table.column("keys").to_pylist()]
        counts = [_unpack(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()]
        keys, sums = _summed(np.concatenate(parts), np.concatenate(counts))
        # A whole number of bytes, so that a probe sees the same length.
        built = build_filter(keys[sums > 0], sums[sums > 0])
        step = max(1, ROUND_BYTES // 8)
        found = np.concatenate([probe(built, keys[low : low + step]) for low in range(0, len(keys), step)])
        return pa.table(
            {
                "segment": table.column("segment"),
                "bucket": pa.array(np.full(len(parts), -1 - key[0].as_py()), pa.int32()),
                "totals": pa.array([_pack(found[np.searchsorted(keys, p)]) for p in parts], pa.binary()),
            }
        )

    return payload.groupBy("bucket").applyInArrow(run, "segment long, bucket int, totals binary")


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_segment(row: dict, totals: np.ndarray, levels: np.ndarray, n: int, v: int, n_docs: int) -> pa.Table:
    vocabulary, tokens, sizes, held = _segment(row)
    first = np.cumsum(sizes) - sizes
    single = (totals + 1) / (n + v + 1)
    plain = np.log10(single)[tokens]
    c_word = totals[tokens]
    c_before = np.empty(len(tokens), np.int64)
    c_before[1:] = c_word[:-1]
    c_before[first] = n_docs
    pair = np.minimum(np.minimum(lower_bound(levels), c_word), c_before)
    mixed = np.where(c_before > 0, WEIGHT * pair / np.maximum(c_before, 1) + (1 - WEIGHT) * single[tokens], single[tokens])
    return pa.table(
        {
            "doc_id": pa.array(row["doc_ids"], pa.int64()),
            "held_out": pa.array(held),
            "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat((c_word > 0).astype(np.int64), first)),
            "train_tokens": pa.array(np.full(len(sizes), n), pa.int64()),
            "base_score": pa.array(np.add.reduceat(plain, first)),
            "score": pa.array(np.add.reduceat(np.log10(mixed), first)),
        }
    )


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per document; ``held_out`` rows teach nothing."""
    found = segments(docs, held_out)
    sums = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_train_docs", "n_vocabulary", "n_pairs"))).first()
    token_bits, pair_bits = _bits(sums["n_vocabulary"]), _bits(sums["n_pairs"])
    totals = kept(token_totals(token_payload(found, token_bits)), "lm-totals")
    n, n_docs = sums["n_train"], sums["n_train_docs"]
    v = totals.where("segment = -1").agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    answers = totals.where("segment >= 0").select("segment", "bucket", "totals")
    # Written, so that the bigrams' shuffle is done with when the segments are moved.
    answers = answers.unionAll(kept(levels(pair_payload(found, pair_bits)), "lm-levels"))

    def run(left, right):
        row = left.to_pylist()[0]
        parts = {b: t for b, t in zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist())}
        exact = np.concatenate([_unpack(parts[b], np.int64) for b in sorted(parts) if b >= 0])
        # Bigrams in the order of their hashes, as they were dealt out.
        found = np.concatenate([_unpack(parts[b], np.uint8) for b in sorted(parts, reverse=True) if b < 0])
        vocabulary, tokens, sizes, _ = _segment(row)
        _, which = np.unique(pair_keys(vocabulary, tokens, sizes), return_inverse=True)
        return score_segment(row, exact, found[which].astype(np.int64), n, v, n_docs)

    whole = found.select("segment", "doc_ids", "held", "sizes", "vocabulary", "tokens")
    return whole.groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(run, SCHEMA)
