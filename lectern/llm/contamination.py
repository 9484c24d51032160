"""Benchmark decontamination: a distributed positional inverted index and phrase search.

Words are ASCII lower-cased runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of whole
texts; a word is known by its 64-bit hash. ``build_index`` turns every block of
documents into one segment: its terms in order, and for each term the sorted
places where it stands. Segments are a table in the shared folder, written by the
scan without a shuffle.

A search takes windows of the test items, at most ``WINDOWS_AT_ONCE`` at a time
(more make more passes, so the broadcast stays bounded). Global document-side term
counts come from the index; each window starts from the posting list of its rarest
term, and the lists of the next rarest terms, shifted by their offset, are
intersected one after the other until the whole phrase stands. ``near`` finds
places where all words of a phrase stand within a distance of its rarest word.

Cases: a null or empty text, or one without a word, has no words and no hits; an
item without a word has no window; an item with fewer words than ``size`` is one
window. Repeated items with one item_id count as one, an item with a null item_id
marks words but is not named. Repeated documents and doc_ids are answered row by
row. Very long texts make a longer segment. Empty tables give empty or all-clean
results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.session import kept

SIZE = 10
SEGMENT_BYTES = 2 << 20
WINDOWS_AT_ONCE = 200_000
CANDIDATES_AT_ONCE = 2_000_000

INDEX = "segment long, doc_ids array<long>, marks array<long>, words array<int>, terms binary, counts binary, places binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def hashed_words(block: B.Block) -> tuple[B.Words, np.ndarray]:
    found = B.words(block, B.ALNUM)
    return found, B.span_hashes(B.LOWER[block.data], found.start, found.end)


def text_mark():
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def build_index(docs: DataFrame) -> DataFrame:
    """The segments of a corpus, one row each."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in B.blocks(batch.column("text"), SEGMENT_BYTES):
                found, hashes = hashed_words(block)
                order = np.argsort(hashes, kind="stable")
                terms, counts = np.unique(hashes, return_counts=True)
                part = batch.slice(block.row, block.n)
                one = pa.array([0, block.n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.ListArray.from_arrays(one, part.column("doc_id").cast(pa.int64())),
                        pa.ListArray.from_arrays(one, part.column("mark")),
                        pa.ListArray.from_arrays(one, pa.array(found.counts, pa.int32())),
                        pa.array([_pack(terms)], pa.binary()),
                        pa.array([_pack(counts.astype(np.uint32))], pa.binary()),
                        # Differences inside a list are small numbers, which pack well.
                        pa.array([_pack(np.diff(order, prepend=0).astype(np.int32))], pa.binary()),
                    ],
                    ["segment", "doc_ids", "marks", "words", "terms", "counts", "places"],
                )
                number += 1

    return kept(B.modest(docs).select("doc_id", "text", text_mark().alias("mark")).mapInArrow(run, INDEX), "postings")


@dataclass
class Segment:
    """Posting lists as one sorted array of (term number, place)."""

    terms: np.ndarray
    start: np.ndarray
    places: np.ndarray
    first: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.start))
        return (owner << 32) | self.places

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term here, -1 where it does not stand."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


def segments(batch: pa.RecordBatch) -> Iterator[tuple[int, Segment]]:
    for row in range(batch.num_rows):
        counts = _unpack(batch.column("counts")[row].as_py(), np.uint32).astype(np.int64)
        first = np.append(0, np.cumsum(batch.column("words")[row].values.to_numpy().astype(np.int64)))
        places = np.cumsum(_unpack(batch.column("places")[row].as_py(), np.int32).astype(np.int64))
        terms = _unpack(batch.column("terms")[row].as_py(), np.uint64)
        yield batch.column("segment")[row].as_py(), Segment(terms, np.append(0, np.cumsum(counts)), places, first)


@dataclass
class Windows:
    """Phrases as rows of term hashes, the rarest term first; ``offset`` is a term's place in the phrase."""

    terms: np.ndarray
    offset: np.ndarray
    length: np.ndarray


def window_rows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """terms (hashes as longs) and item: each distinct window of each item."""

    def run(batches):
        for batch in batches:
            names = batch.column("item_id").cast(pa.string()).to_pylist()
            for block in B.blocks(batch.column("text")):
                found, hashes = hashed_words(block)
                signed = hashes.view(np.int64)
                terms, owner = [], []
                for d in range(block.n):
                    low, high = int(found.first[d]), int(found.first[d + 1])
                    own = range(low, max(low + 1, high - size + 1)) if high > low else ()
                    terms += [signed[k : min(k + size, high)] for k in own]
                    owner += [names[block.row + d]] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int64())), pa.array(owner, pa.string())], ["terms", "item"])

    return items.select("item_id", "text").mapInArrow(run, "terms array<long>, item string").distinct()


def query_blocks(windows: DataFrame) -> Iterator[tuple[list[list[int]], list[list[str | None]]]]:
    """Distinct windows and the items of each, a bounded number of rows at a time."""
    total = windows.count()
    parts = -(-total // WINDOWS_AT_ONCE)
    for part in range(parts):
        mine = windows.where(F.pmod(F.xxhash64("terms", F.coalesce("item", F.lit(""))), F.lit(parts)) == part)
        items: dict[tuple[int, ...], list[str | None]] = {}
        for row in mine.toLocalIterator():
            items.setdefault(tuple(row["terms"]), []).append(row["item"])
        yield [list(t) for t in items], list(items.values())


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of a sorted vocabulary stands in the corpus."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        sums = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                own = _unpack(terms.as_py(), np.uint64)
                at = np.searchsorted(shared.value, own)
                at[at == len(shared.value)] = 0
                hit = shared.value[at] == own
                sums[at[hit]] += _unpack(counts.as_py(), np.uint32)[hit]
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(sums[met])], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for row in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def rarest_first(phrases: list[list[int]], index: DataFrame) -> Windows:
    length = np.array([len(p) for p in phrases])
    terms = np.zeros((len(phrases), int(length.max())), np.uint64)
    for k, p in enumerate(phrases):
        terms[k, : len(p)] = np.array(p, np.int64).view(np.uint64)
    inside = np.arange(terms.shape[1]) < length[:, None]
    vocabulary = np.unique(terms[inside])
    counts = term_counts(index, vocabulary)[np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)]
    order = np.argsort(np.where(inside, counts, np.iinfo(np.int64).max), axis=1, kind="stable")
    return Windows(np.take_along_axis(terms, order, 1), order, length)


def phrase_places(segment: Segment, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its first word) of every exact occurrence inside one document."""
    numbers = segment.number(windows.terms.ravel()).reshape(windows.terms.shape)
    inside = np.arange(numbers.shape[1]) < windows.length[:, None]
    alive = np.flatnonzero(~((numbers < 0) & inside).any(axis=1))
    if not len(alive):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = segment.keys
    lead = numbers[alive, 0]
    sizes = segment.start[lead + 1] - segment.start[lead]
    bounds = np.cumsum(sizes)
    found_w, found_p = [], []
    low = 0
    while low < len(alive):
        base = bounds[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(bounds, base + CANDIDATES_AT_ONCE, "right")))
        part = alive[low:high]
        w = np.repeat(part, sizes[low:high])
        p = segment.places[B.gather(segment.start[lead[low:high]], sizes[low:high])] - windows.offset[w, 0]
        for k in range(1, numbers.shape[1]):
            more = windows.length[w] > k
            wanted = (numbers[w, k].astype(np.int64) << 32) | (p + windows.offset[w, k])
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            stays = ~more | ((keys[at] == wanted) & (p >= 0))
            w, p = w[stays], p[stays]
        p_ok = p >= 0
        w, p = w[p_ok], p[p_ok]
        doc = np.searchsorted(segment.first, p, "right") - 1
        whole = p + windows.length[w] <= segment.first[doc + 1]
        found_w.append(w[whole])
        found_p.append(p[whole])
        low = high
    return np.concatenate(found_w), np.concatenate(found_p)


HITS = "segment long, at int, hit_words array<int>, item_ids array<string>, n_marks int"


def search(index: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """For each document with a hit and each pass: words hit and items found."""
    spark = index.sparkSession
    passes = []
    for phrases, owners in query_blocks(kept(window_rows(items, size), "windows")):
        shared = spark.sparkContext.broadcast((rarest_first(phrases, index), owners))

        def run(batches, shared=shared):
            windows, named = shared.value
            for batch in batches:
                for number, segment in segments(batch):
                    w, p = phrase_places(segment, windows)
                    if not len(w):
                        continue
                    doc = np.searchsorted(segment.first, p, "right") - 1
                    rows = []
                    for d in np.unique(doc).tolist():
                        mine = doc == d
                        base = segment.first[d]
                        words = np.unique(B.gather(p[mine] - base, windows.length[w[mine]]))
                        names = sorted({x for k in np.unique(w[mine]).tolist() for x in named[k] if x is not None})
                        rows.append((number, d, words.tolist(), names, int(mine.sum())))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int64()),
                            pa.array([r[1] for r in rows], pa.int32()),
                            pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                            pa.array([r[3] for r in rows], pa.list_(pa.string())),
                            pa.array([r[4] for r in rows], pa.int32()),
                        ],
                        ["segment", "at", "hit_words", "item_ids", "n_marks"],
                    )

        passes.append(index.select("segment", "words", "terms", "counts", "places").mapInArrow(run, HITS))
    if not passes:
        return spark.createDataFrame([], HITS)
    found = passes[0]
    for more in passes[1:]:
        found = found.unionAll(more)
    return found


def judged(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``contamination`` and ``mark``, the hash of the row's text."""
    index = build_index(docs)
    hits = (
        search(index, items, size)
        .groupBy("segment", "at")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hit_words")))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )
    )
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "marks", "words")).alias("at", "doc")).select(
        "segment", "at", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.marks").alias("mark"), F.col("doc.words").cast("long").alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(hits, ["segment", "at"], "left").select(
        "doc_id", "mark", "n_words", n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    return judged(docs, items, size).drop("mark")


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents without any window of an item, with all their columns."""
    hit = judged(docs, items, size).where("contaminated").select("doc_id", "mark").distinct()
    same = docs["doc_id"].eqNullSafe(hit["doc_id"]) & (text_mark() == hit["mark"])
    return docs.join(hit, same, "left_anti")


def near(index: DataFrame, phrases: list[list[str]], within: int) -> DataFrame:
    """phrase, segment, doc_id, word: places of a phrase's rarest word with all its other words within a distance."""
    hashed = [[int(np.uint64(B.word_hash(w.lower())).view(np.int64)) for w in p] for p in phrases if p]
    if not hashed:
        return index.sparkSession.createDataFrame([], "phrase int, doc_id long, word long")
    shared = index.sparkSession.sparkContext.broadcast(rarest_first(hashed, index))

    def run(batches):
        windows = shared.value
        for batch in batches:
            for row, (_, segment) in enumerate(segments(batch)):
                ids = batch.column("doc_ids")[row].values.to_pylist()
                for w in range(len(windows.length)):
                    numbers = segment.number(windows.terms[w, : windows.length[w]])
                    if (numbers < 0).any():
                        continue
                    lists = [segment.places[segment.start[k] : segment.start[k + 1]] for k in numbers]
                    at = lists[0]
                    doc = np.searchsorted(segment.first, at, "right") - 1
                    low, high = np.maximum(at - within, segment.first[doc]), np.minimum(at + within, segment.first[doc + 1] - 1)
                    ok = np.ones(len(at), bool)
                    for places in lists[1:]:
                        ok &= np.searchsorted(places, high, "right") > np.searchsorted(places, low, "left")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(int(ok.sum()), w), pa.int32()),
                            pa.array([ids[d] for d in doc[ok]], pa.int64()),
                            pa.array(at[ok] - segment.first[doc[ok]], pa.int64()),
                        ],
                        ["phrase", "doc_id", "word"],
                    )

    return index.mapInArrow(run, "phrase int, doc_id long, word long")
