"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Words are runs of anything but ASCII white space, of the whole text. Two
multinomials over hashed word unigrams and bigrams are counted: one over **all**
documents, one over the trusted ones (labelled good and not toxic). The trusted one
backs off to the raw one with a fixed weight, so with few trusted texts all ratios
are near 0. A document's score is the sum of ``log p_trusted - log p_raw`` over its
n-grams, divided by their number. It is kept if it passes the base rules and its
score is not under the threshold, which trusted documents left out of the fit set
(``calibrated``): it loses a stated share of them, at every size of the corpus. The
ratios are whole millionths, so a score does not depend on the order of summing and
the verdict is the same in every run.

Nothing is a sample: the raw side counts every document, the trusted side every
trusted one but those left out for the threshold, and the threshold is the exact
rank among all of those. Trusted doc_ids are sent to the documents, or, where they
are more than ``SENT_IDS``, meet them by shuffle.

Cases: a null or empty text, or one of white space alone, has no words, zero
figures and score 0.0, and fails the base rules. Repeated rows and repeated
doc_ids are judged row by row. Without labels (no table, no row, none trusted)
every score is 0.0 and the base rules alone decide. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.session import dropped, kept

SYMBOLS = B.byte_class(b"[#*$%&|<>]"[1:-1])
SCALE = 1_000_000
#: Doc_ids that are sent to every task (32 MB of them); more meet the documents by shuffle.
SENT_IDS = 4_000_000


@dataclass(frozen=True)
class Rules:
    bits: int = 16
    #: Weight, in n-grams, of the raw corpus in the trusted distribution.
    smoothing: float = 65_536.0
    threshold: float = -0.3
    #: One labelled row in so many is left out of the fit and sets the threshold.
    held_out: int = 5
    #: Share of held-out good documents that may fall under the threshold.
    lost: float = 0.02
    min_words: int = 50
    max_repeat_percent: int = 50


def _features(block: B.Block, found: B.Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of unigrams, of bigrams, and which document each bigram is in."""
    hashes = B.span_hashes(block.data, found.start, found.end)
    shift = np.uint64(64 - bits)
    inside = B.grams_inside(found.first, 2, len(hashes))
    pairs = (B.gram_hashes(hashes, 2) >> shift).astype(np.int64)[inside]
    return (hashes >> shift).astype(np.int64), pairs, found.doc[:-1][inside] if len(hashes) else found.doc


def _counter(bits: int):
    def count(batches):
        size = 1 << bits
        raw, trusted = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            good = np.asarray(batch.column("trusted").to_numpy(zero_copy_only=False), bool)
            for block in B.blocks(batch.column("text")):
                found = B.words(block, B.SOLID)
                single, pairs, pair_doc = _features(block, found, bits)
                mine = good[block.row : block.row + block.n]
                for bucket, doc in ((single, found.doc), (pairs, pair_doc)):
                    raw += np.bincount(bucket, minlength=size)
                    trusted += np.bincount(bucket[mine[doc]], minlength=size)
        hit = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit, pa.int32()), pa.array(raw[hit], pa.int64()), pa.array(trusted[hit], pa.int64())],
            ["bucket", "raw", "trusted"],
        )

    return count


def fit(docs: DataFrame, labels: DataFrame | None, rules: Rules = Rules()) -> np.ndarray:
    """Log ratio of each bucket in millionths: at most ``2^bits`` numbers, whatever the corpus."""
    text = B.modest(docs).select("doc_id", "text")
    if labels is None:
        marked = text.withColumn("trusted", F.lit(False))
    else:
        sample = trusted(labels, rules).where(~F.col("held")).select("doc_id", F.lit(True).alias("trusted"))
        marked = text.join(_sized(sample), "doc_id", "left")
    counted = (
        marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(_counter(rules.bits), "bucket int, raw long, trusted long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    )
    raw, good = (np.zeros(1 << rules.bits) for _ in range(2))
    for row in counted.toLocalIterator():
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["trusted"]
    if not good.sum():
        return np.zeros(1 << rules.bits, np.int64)
    return np.round(log_ratio(raw, good, rules.smoothing) * SCALE).astype(np.int64)


def log_ratio(raw: np.ndarray, good: np.ndarray, weight: float) -> np.ndarray:
    """Log of the trusted share over the raw share; the trusted side backs off to the raw one.

    With few trusted n-grams all ratios are near 0, so a small sample rejects nobody for
    what it has not seen.
    """
    share = (raw + 1) / (raw.sum() + len(raw))
    return np.log((good + weight * share) / (good.sum() + weight)) - np.log(share)


def trusted(labels: DataFrame, rules: Rules) -> DataFrame:
    """All good doc_ids; ``held`` ones are kept for the threshold."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(rules.held_out)) == 0
    return good.select("doc_id").distinct().withColumn("held", held)


def _sized(ids: DataFrame) -> DataFrame:
    """Broadcast where the ids, counted and not assumed, are few; texts are then not moved. Either way takes all of them."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def calibrated(docs: DataFrame, labels: DataFrame | None, ratios: np.ndarray, rules: Rules = Rules()) -> Rules:
    """The rules with the threshold that loses the share ``lost`` of the held-out good documents, and no higher than 0.

    Documents that the fit has counted would set it too high. Without held-out documents the threshold stays.
    """
    if labels is None:
        return rules
    held = _sized(trusted(labels, rules).where("held").select("doc_id"))
    judged = judge(docs.select("doc_id", "text").join(held, "doc_id", "left_semi"), ratios, rules)
    scores = kept(judged.where(~F.col("base_failed")).select("score"), "held")
    # The driver sees two numbers, however many documents are held out.
    lost = int(rules.lost * scores.count())
    found = scores.orderBy("score").limit(lost + 1).agg(F.max("score")).first()[0]
    dropped(scores)
    return rules if found is None else replace(rules, threshold=min(0.0, found))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more, and which of those are not the first (in order of place)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    later[order[1:][same]] = True
    return many, later


def base_figures(block: B.Block, found: B.Words) -> dict[str, np.ndarray]:
    """Counts of the base rules for each document of a block."""
    data, n = block.data, block.n
    salt = B.mixed(np.arange(1, n + 1, dtype=np.uint64))
    solid = B.SOLID[data]
    lines = B.runs(data != 0x0A, block.offsets)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    has_word = filled[lines.end] > filled[lines.start]
    line_doc = lines.doc[has_word]
    line_hash = B.span_hashes(data, lines.start, lines.end)[has_word]
    _, later = repeats(line_hash ^ salt[line_doc])
    doc = found.doc
    windows = B.gram_hashes(B.span_hashes(data, found.start, found.end), 3)
    inside = np.flatnonzero(B.grams_inside(found.first, 3, len(doc)))
    many, _ = repeats(windows[inside] ^ salt[doc[inside]])
    covered = np.zeros(len(doc), bool)
    for step in range(3):
        covered[inside[many] + step] = True
    return {
        "n_words": found.counts,
        "word_chars": block.sums(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": block.sums(SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_doc[later], minlength=n),
        "n_repeat_words": np.bincount(doc[covered], minlength=n),
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def judge_batch(ids: pa.Array, texts: pa.Array, ratios: np.ndarray, rules: Rules) -> pa.RecordBatch:
    parts = []
    for block in B.blocks(texts):
        found = B.words(block, B.SOLID)
        single, pairs, pair_doc = _features(block, found, rules.bits)
        sums = np.zeros(block.n, np.int64)
        np.add.at(sums, pair_doc, ratios[pairs])
        sums += B.segment_sums(ratios[single], found.first)
        grams = found.counts + np.bincount(pair_doc, minlength=block.n)
        parts.append({**base_figures(block, found), "score": sums / np.maximum(grams, 1) / SCALE})
    out = {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")}
    n_words = out["n_words"]
    failed = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)
    kept = ~failed & (out["score"] >= rules.threshold)
    longs = [pa.array(out[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), *longs, pa.array(failed), pa.array(kept), pa.array(out["score"].astype(float))],
        [c.strip().split(" ")[0] for c in SCHEMA.split(",")],
    )


def judge(docs: DataFrame, ratios: np.ndarray, rules: Rules = Rules()) -> DataFrame:
    """One row per document: base figures, ``base_failed``, ``kept`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            yield judge_batch(batch.column("doc_id"), batch.column("text"), shared.value, rules)

    return B.modest(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, ratios: np.ndarray, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns; only texts go to Python, and only verdicts come back."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        return judge_batch(pa.nulls(len(texts), pa.int64()), texts, shared.value, rules).column("kept")

    return B.modest(docs).where(passes("text"))
