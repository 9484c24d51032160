"""Language ID: multinomial naive Bayes over hashed character n-grams.

Character 1-, 2- and 3-grams of the whole lower-cased text are hashed to
``2^bits`` buckets. Counts per language come from every training document: a task
adds up one vector per language and Spark sums them. The matrix of log
probabilities (languages x buckets, float32) is broadcast; documents are scored
in blocks, one gather and one segmented sum per language. A document's result
uses its text only.

The matrix has a fixed number of buckets; its rows follow the number of distinct
languages, at most ``max_languages`` (a corpus with more raises an error that says
so: 1,000 languages are 131 MB).

Cases: a text that is null, empty or without a letter gives ``und`` and 0.0.
Without training rows every document gives ``und`` and 0.0. Equal scores go to the
smallest language name. Repeated rows are learned and scored row by row; the
lower-cased text alone is read beside ``lang`` in training. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B

SIZES = (1, 2, 3)
BLOCK_CHARS = 1 << 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Log probability of a bucket in each language.
    matrix: np.ndarray
    #: Log prior of each language.
    prior: np.ndarray
    bits: int


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [t.lower() if t else "" for t in texts]
    first = np.zeros(len(lowered) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=first[1:])
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32), first


def _blocks(texts: pa.Array):
    """Lists of texts of about ``BLOCK_CHARS`` characters."""
    kept, size, row = [], 0, 0
    for k, text in enumerate(texts):
        kept.append(text.as_py())
        size += len(kept[-1] or "")
        if size >= BLOCK_CHARS:
            yield row, kept
            kept, size, row = [], 0, k + 1
    if kept:
        yield row, kept


def features(codes: np.ndarray, first: np.ndarray, bits: int):
    """For each n-gram size: buckets and the first n-gram of each document."""
    values = B.mixed(codes.astype(np.uint64) + np.uint64(1))
    for size in SIZES:
        inside = B.grams_inside(first, size, len(codes))
        buckets = (B.gram_hashes(values, size, seed=size) >> np.uint64(64 - bits)).astype(np.int64)[inside]
        counts = np.maximum(np.diff(first) - size + 1, 0)
        start = np.zeros(len(first), np.int64)
        np.cumsum(counts, out=start[1:])
        yield buckets, start


def _counter(bits: int):
    def count(batches):
        size = 1 << bits
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row, texts in _blocks(batch.column("text")):
                mine = np.array(langs[row : row + len(texts)])
                names, which = np.unique(mine, return_inverse=True)
                for k, name in enumerate(names):
                    docs[str(name)] = docs.get(str(name), 0) + int((which == k).sum())
                codes, first = _codes(texts)
                for buckets, start in features(codes, first, bits):
                    owner = np.repeat(which, np.diff(start))
                    table = np.bincount(owner * size + buckets, minlength=len(names) * size).reshape(len(names), size)
                    for k, name in enumerate(names):
                        sums[str(name)] = sums.get(str(name), 0) + table[k]
        for name, vector in sums.items():
            hit = np.flatnonzero(vector)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(hit) + 1)),
                    pa.array(np.append(hit, -1), pa.int32()),
                    pa.array(np.append(vector[hit], docs[name]), pa.int64()),
                ],
                ["lang", "bucket", "n"],
            )

    return count


def fit(training: DataFrame, bits: int = 15, smoothing: float = 0.5, max_languages: int = 1000) -> Model:
    """Count every row of ``training(text, lang)``; rows without a language teach nothing."""
    rows = B.modest(training).select("text", "lang").where(F.col("lang").isNotNull())
    counted = rows.mapInArrow(_counter(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    tables: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for row in counted.toLocalIterator():
        if row["lang"] not in tables:
            if len(tables) == max_languages:
                raise ValueError(f"more than {max_languages} languages; raise max_languages")
            tables[row["lang"]], docs[row["lang"]] = np.zeros(1 << bits), 0
        if row["bucket"] < 0:
            docs[row["lang"]] = row["n"]
        else:
            tables[row["lang"]][row["bucket"]] = row["n"]
    names = tuple(sorted(tables))
    if not names:
        return Model((), np.zeros((0, 1 << bits), np.float32), np.zeros(0), bits)
    counts = np.stack([tables[x] for x in names]) + smoothing
    prior = np.array([docs[x] for x in names], float)
    return Model(
        names,
        np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32),
        np.log(prior / prior.sum()),
        bits,
    )


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    codes, first = _codes(texts)
    n = len(texts)
    totals = np.tile(model.prior, (n, 1))
    for buckets, start in features(codes, first, model.bits):
        for k in range(len(model.languages)):
            cumulated = np.zeros(len(buckets) + 1)
            np.cumsum(model.matrix[k][buckets], out=cumulated[1:], dtype=float)
            totals[:, k] += cumulated[start[1:]] - cumulated[start[:-1]]
    distinct, which = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() if c < 0xD800 or c > 0xDFFF else False for c in distinct], bool)
    lettered = B.segment_sums(letter[which].astype(np.int64), first) > 0 if len(codes) else np.zeros(n, bool)
    if not model.languages:
        return ["und"] * n, np.zeros(n)
    best = totals.argmax(axis=1)
    odds = np.exp(totals - totals.max(axis=1, keepdims=True))
    score = np.where(lettered, 1.0 / odds.sum(axis=1), 0.0)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, lettered)], score


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """One row per document: ``held_out`` as given, the predicted language and its posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = [], []
            for _, texts in _blocks(batch.column("text")):
                found, score = score_texts(texts, shared.value)
                names += found
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    pa.array(names, pa.string()),
                    pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return B.modest(docs).select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, SCHEMA)


def id_remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus
