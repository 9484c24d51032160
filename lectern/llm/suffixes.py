"""Suffix-array dedup: byte strings that also start in an earlier document.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id, judged on the input.

**Sampled suffixes.** Full suffix arrays of a corpus would take many times its
size. A suffix is taken only where it starts at an *anchor*: the place of the least
hash among the ``WINDOW`` seeds (``SEED`` bytes each) of some string of ``LENGTH``
bytes. That choice depends on the string alone, so a string and its copy have the
same anchors, and every string holds one: about one place in fifteen is kept and
no match is lost. A suffix is known by the fingerprint of its seed and that of its
*surroundings* (all bytes that any string through the seed can reach).

**Logarithmic index family.** Suffixes are dealt out by mixed seed fingerprint, so
buckets are even. A bucket takes its suffixes in batches of ascending doc_id. A
batch becomes a sorted suffix array and is merge-scanned against itself and the
levels that stand: a suffix found with a smaller doc_id is a long match. What is new
in it becomes a level; levels of about equal size are merged, so there are at most
log n of them and a suffix is merged log n times. A suffix ends up as one of

* surroundings seen in a smaller doc_id: every string through the anchor is one;
* a seed with one surroundings only: no string of which it is the least seed is;
* else open: the rim of a match, or a seed that recurs by chance.

**Rims.** Open anchors are dealt out by seed once more, now with their surroundings
as they are; the bucket finds the smallest doc_id of each string of which the seed
is the least one, and answers with a bit for each string.

A seed that stands in ``HOT`` documents of one block of texts or more is *hot*. Its
places are not dealt out by seed: its bucket gets one entry a dealing, and all its
places are open.
Their strings are hashed, combined inside the batch, and dealt out by hash. So a
passage in a third of all documents costs a batch one hash for each of its strings,
and the strings over its edge, which all differ, are spread over all buckets.

Texts are shuffled once: they are kept in the shared folder, bucketed by a key of
doc_id and text, and the later passes join them bucket by bucket. Of the rows that
share a key one is marked, and only that one is dealt out and judged: which seeds
are hot depends on the batch, so two rows of a key could get two answers.

Cases: a null or empty text has 0 bytes, nothing removed, and the hash of nothing.
Texts under ``LENGTH`` bytes are never cut. Rows that share a doc_id do not count
against each other; repeated rows get equal results. A null doc_id counts as the
largest. Very long texts are one piece of work. ``cut`` keeps all columns, whatever
their names. An empty table gives an empty result. Equality is that of 64-bit fingerprints or more (80 bits for a suffix).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import blocks as B
from lectern.session import dropped, kept, scratch_path

LENGTH = 50
SEED = 22
WINDOW = LENGTH - SEED + 1
RIM = LENGTH - SEED
BATCH_BYTES = 512 << 10
HOT = 8
BUCKET_ENTRIES = 500_000
#: Suffixes that a task deals out at once: a bucket gets one row of them.
DEAL_ENTRIES = 1 << 20
#: Buckets are dealt out in rounds of so many bits.
DEAL_BITS = 12
#: Rims and hot strings that a task deals out at once.
RIM_ENTRIES = 1 << 18
#: Suffixes of a batch that meets the levels.
SCAN_ENTRIES = 1 << 16
OPEN_ENTRIES = 60_000
NO_ID = np.iinfo(np.int64).max
FULL, OPEN, OPEN_HOT = 1, 2, 3


def _sliding(values: np.ndarray, size: int, op) -> np.ndarray:
    """op over each run of ``size`` values."""
    reach, out = 1, values
    while reach * 2 <= size:
        out = op(out[:-reach], out[reach:])
        reach *= 2
    rest = size - reach
    return op(out[: len(out) - rest], out[rest:]) if rest else out


class Text:
    """Hashes of any range of a block's bytes."""

    def __init__(self, block: B.Block):
        self.block = block
        n = len(block.data)
        self.power, self.inverse = B.powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(B._BYTE_VALUE[block.data] * self.power[:n], out=self.total[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lengths = (end - start).astype(np.uint64)
        return B.mixed((self.total[end] - self.total[start]) * self.inverse[start] + lengths * np.uint64(0x9E3779B97F4A7C15))

    def every(self, size: int) -> np.ndarray:
        """Hash of the string of ``size`` bytes at each place."""
        n = len(self.block.data) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return B.mixed((self.total[size:] - self.total[:n]) * self.inverse[:n])

    def inside(self, size: int) -> np.ndarray:
        """Which of those strings stay inside one document."""
        n = max(0, len(self.block.data) - size + 1)
        ok = np.ones(n, bool)
        for edge in self.block.offsets[1:-1].tolist():
            ok[max(0, edge - size + 1) : edge] = False
        return ok


def anchors(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their document and seed fingerprint; the least seed of each string."""
    seeds = text.every(SEED)
    inside = text.inside(LENGTH)
    if not inside.any():
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    least = np.where(inside, _sliding(seeds, WINDOW, np.minimum), np.uint64(0))
    edge = np.zeros(WINDOW - 1, np.uint64)
    reached = _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum)
    place = np.flatnonzero((reached == seeds) & (reached > 0))
    doc = np.searchsorted(text.block.offsets, place, "right") - 1
    return place, doc, seeds[place], least


def surroundings(text: Text, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Fingerprint of all surroundings of each anchor."""
    low, high = np.maximum(place - RIM, text.block.offsets[doc]), np.minimum(place + LENGTH, text.block.offsets[doc + 1])
    around = text.ranges(low, high) + B.mixed((place - low).astype(np.uint64))
    return (around >> np.uint64(32)).astype(np.uint32)


def _known(keys: np.ndarray, around: np.ndarray) -> np.ndarray:
    return B.mixed(keys ^ B.mixed(around.astype(np.uint64) + np.uint64(1)))


class Levels:
    """Sorted suffix arrays of geometrically growing sizes: (suffix, seed, smallest doc_id). No suffix stands in two."""

    def __init__(self):
        self.arrays: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _sorted(suffix, seed, doc):
        order = np.argsort(suffix)
        suffix, seed, doc = suffix[order], seed[order], doc[order]
        first = np.flatnonzero(np.append(True, suffix[1:] != suffix[:-1]))
        return suffix[first], seed[first], np.minimum.reduceat(doc, first)

    def add(self, suffix: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> None:
        if not len(suffix):
            return
        new = self._sorted(suffix, seed, doc)
        while self.arrays and len(self.arrays[-1][0]) <= 2 * len(new[0]):
            new = self._sorted(*(np.concatenate(pair) for pair in zip(self.arrays.pop(), new)))
        self.arrays.append(new)

    def merged(self):
        while len(self.arrays) > 1:
            b, a = self.arrays.pop(), self.arrays.pop()
            self.arrays.append(self._sorted(*(np.concatenate(pair) for pair in zip(a, b))))
        return self.arrays[0]

    def meet(self, suffix: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which suffixes of a batch stand with a smaller doc_id in a level or in the batch; its new ones become a level.

        Batches come in ascending order of doc_id, so what stands is never replaced.
        """
        own, own_seed, least = self._sorted(suffix, seed, doc)
        fresh = np.ones(len(own), bool)
        for known, _, before in self.arrays:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            least[hit] = np.minimum(least[hit], before[at[hit]])
            fresh &= ~hit
        found = least[np.searchsorted(own, suffix)] < doc
        self.add(own[fresh], own_seed[fresh], least[fresh])
        return found

    def several(self) -> np.ndarray:
        """Seeds with two surroundings or more."""
        if not self.arrays:
            return np.empty(0, np.uint64)
        ranked = np.sort(np.concatenate([seeds for _, seeds, _ in self.arrays]))
        return np.unique(ranked[1:][ranked[1:] == ranked[:-1]])


def _among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(values), bool)
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def _short(seeds: np.ndarray, bits: int) -> bytes:
    """48 bits of each seed below those that name its bucket."""
    wide = ((seeds << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, :6]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


DEALT = "bucket int, batch long, keys binary, ids binary, counts binary, seeds binary, around binary"


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def row_key():
    """doc_id and text of a row as one number; repeated rows share it and their result."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit("")))


def marked(keyed: DataFrame, key: str, mark: str) -> DataFrame:
    """``mark``: is the row the first of its key in its partition? (All rows of a key must be in one.)"""

    def run(batches):
        seen = set()
        for batch in batches:
            first = []
            for k in batch.column(key).to_pylist():
                first.append(k not in seen)
                seen.add(k)
            yield batch.append_column(mark, pa.array(first, pa.bool_()))

    return B.modest(keyed).mapInArrow(run, T.StructType([*keyed.schema.fields, T.StructField(mark, T.BooleanType())]))


_DEALT = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("keys", "ids", "counts", "seeds", "around"))])


class _Dealer:
    """Suffixes of several blocks of texts, given out as one row a bucket."""

    def __init__(self, bits: int, number: int):
        self.bits, self.number = bits, number
        self._empty()

    def _empty(self) -> None:
        self.plain, self.hot, self.marks, self.docs, self.n = [], [], [], 0, 0

    def take(self, keys, ids, doc, seeds, around) -> None:
        self.plain.append((keys, ids, doc + self.docs, seeds, around))
        self.docs += len(keys)
        self.n += len(seeds)

    @staticmethod
    def _documents(keys, ids, doc):
        own, counts = np.unique(doc, return_counts=True)
        return keys[own].tobytes(), ids[own].tobytes(), counts.astype(np.int32).tobytes()

    def rows(self) -> pa.RecordBatch:
        out = [(-1 - self.number % 1021, self.number, *self._documents(keys, ids, doc), ordinal.astype(np.int32).tobytes(), b"") for keys, ids, doc, ordinal in self.hot]
        if self.plain:
            keys, ids, doc, seeds, around = (np.concatenate(c) for c in zip(*self.plain))
            for b, mine in self._buckets(seeds):
                out.append((b, self.number, *self._documents(keys, ids, doc[mine]), _short(seeds[mine], self.bits), around[mine].tobytes()))
        if self.marks:
            # One entry for each hot seed, with nobody to answer to.
            marks = np.unique(np.concatenate(self.marks))
            out += [(b, -1, b"", b"", b"", _short(marks[mine], self.bits), b"") for b, mine in self._buckets(marks)]
        self.number += 1
        self._empty()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_DEALT)], schema=_DEALT)

    def _buckets(self, seeds: np.ndarray):
        """Each bucket with the places of its seeds, in order."""
        return _by_bucket(_leading(seeds, self.bits))


def _by_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.empty(0, np.int64)
    for low, high in zip(first, np.append(first[1:], len(order))):
        yield int(bucket[order[low]]), order[low:high]


def _leading(seeds: np.ndarray, bits: int) -> np.ndarray:
    return (seeds >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(seeds), np.int64)


def deal(docs: DataFrame, bits: int) -> DataFrame:
    """The suffixes of the documents (doc_id, text, key), for each bucket in the order of documents and places.

    The seeds that decide are mixed once more: an anchor is the least seed of a
    window, so nearly all anchors would share their leading bits.
    """
    level = min(bits, DEAL_BITS)

    def run(batches):
        dealer = _Dealer(level, TaskContext.get().partitionId() << 32)
        for batch in batches:
            all_ids, all_keys = _ids(batch.column("doc_id")), batch.column("key").to_numpy()
            for block in B.blocks(batch.column("text"), BATCH_BYTES):
                ids, keys = all_ids[block.row : block.row + block.n], all_keys[block.row : block.row + block.n]
                text = Text(block)
                place, doc, seeds, _ = anchors(text)
                around = surroundings(text, place, doc)
                hot = _hot(seeds, doc)
                seeds = B.mixed(seeds)
                if hot.any():
                    ordinal = np.arange(len(doc)) - np.searchsorted(doc, doc)
                    dealer.hot.append((keys, ids, doc[hot], ordinal[hot]))
                    dealer.marks.append(np.unique(seeds[hot]))
                dealer.take(keys, ids, doc[~hot], seeds[~hot], around[~hot])
                if dealer.n >= DEAL_ENTRIES:
                    yield dealer.rows()
        yield dealer.rows()

    dealt = B.modest(docs).select("doc_id", "text", "key").mapInArrow(run, DEALT)
    while level < bits:
        dealt, level = _dealt_again(dealt, level, min(bits, level + DEAL_BITS)), min(bits, level + DEAL_BITS)
    return dealt


def _dealt_again(dealt: DataFrame, bits: int, more: int) -> DataFrame:
    """Buckets named by more bits, for corpora where a task cannot write to all of them at once."""

    def run(batches):
        dealer = _Dealer(more, TaskContext.get().partitionId() << 32)
        for batch in batches:
            whole = batch.filter(pa.compute.less(batch.column("bucket"), 0))
            if whole.num_rows:
                yield whole
            for row in batch.filter(pa.compute.greater_equal(batch.column("bucket"), 0)).to_pylist():
                # The 48 bits below those of the bucket; what lay under them is gone.
                seeds = (np.uint64(row["bucket"]) << np.uint64(64 - bits)) | (_long(row["seeds"]) << np.uint64(16)) >> np.uint64(bits)
                if row["batch"] < 0:
                    dealer.marks.append(seeds)
                    continue
                keys, ids, counts = (_array(row, c, t) for c, t in (("keys", np.int64), ("ids", np.int64), ("counts", np.int32)))
                dealer.take(keys, ids, np.repeat(np.arange(len(keys)), counts), seeds, _array(row, "around", np.uint32))
                if dealer.n >= DEAL_ENTRIES:
                    yield dealer.rows()
        yield dealer.rows()

    return dealt.repartition("bucket").mapInArrow(run, DEALT)


def _hot(seeds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Suffixes whose seed stands in ``HOT`` documents of the batch or more."""
    order = np.lexsort((doc, seeds))
    s, d = seeds[order], doc[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    distinct, counts = np.unique(s[fresh], return_counts=True)
    many = distinct[counts >= HOT]
    return np.isin(seeds, many) if len(many) else np.zeros(len(seeds), bool)


#: Answers for a row: codes of its anchors in a bucket (CODE), ordinals of its hot anchors
#: (HOT_AT), bits for the strings of its open anchors (BITS), flags for its hot strings (FLAGS).
CODE, HOT_AT, BITS, FLAGS = range(4)
ANSWER = "key long, kind int, bucket int, data binary, n_open long"
_ANSWER = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("n_open", pa.int64())])


def _answers(kind: int, bucket: int, keys: np.ndarray, counts: np.ndarray, data: np.ndarray, n_open=None) -> pa.Table:
    """A row for each document: ``counts`` values of ``data`` each."""
    offsets = (np.append(0, np.cumsum(counts)) * data.itemsize).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    n = len(keys)
    return pa.table(
        [pa.array(keys), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket, np.int32)), raw, pa.array(np.zeros(n, np.int64) if n_open is None else n_open)],
        schema=_ANSWER,
    )


def _array(row: dict, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _bytes(table: pa.Table, name: str) -> bytes:
    return b"".join(v.as_buffer() for chunk in table.column(name).chunks for v in chunk)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(_bytes(table, name), kind)


def judge(dealt: DataFrame) -> DataFrame:
    """For each row and bucket with anything but zeros, the codes of its suffixes there; places of hot seeds."""

    def run(key, table):
        bucket = key[0].as_py()
        of = table.column("batch")
        marked, table = table.filter(pa.compute.less(of, 0)), table.filter(pa.compute.greater_equal(of, 0))
        keys, counts = _joined(table, "keys", np.int64), _joined(table, "counts", np.int32).astype(np.int64)
        if bucket < 0:
            return _answers(HOT_AT, -1, keys, counts, _joined(table, "seeds", np.int32))
        if not len(keys):
            return _ANSWER.empty_table()
        hot, seeds = np.unique(_long(_bytes(marked, "seeds"))), _long(_bytes(table, "seeds"))
        suffix = _known(seeds, _joined(table, "around", np.uint32))
        doc = np.repeat(_joined(table, "ids", np.int64), counts)
        order = np.argsort(doc, kind="stable")
        levels, full = Levels(), np.zeros(len(doc), bool)
        for low in range(0, len(order), SCAN_ENTRIES):
            mine = order[low : low + SCAN_ENTRIES]
            full[mine] = levels.meet(suffix[mine], seeds[mine], doc[mine])
        codes = np.where(_among(seeds, levels.several()), OPEN, 0).astype(np.uint8)
        codes[_among(seeds, hot)] = OPEN_HOT
        codes[full] = FULL
        first = np.cumsum(counts) - counts
        n_open = np.add.reduceat((codes == OPEN).astype(np.int64), first)
        whole = _answers(CODE, bucket, keys, counts, codes, n_open)
        return whole.filter(pa.array(np.maximum.reduceat(codes, first) > 0))

    return dealt.groupBy("bucket").applyInArrow(run, ANSWER)


# ---- a document with its answers --------------------------------------------
class Given:
    """The answers of a block of documents (a list of kind, bucket and data for each, or null)."""

    def __init__(self, answers: pa.ListArray):
        self.kind, self.bucket, self.data = answers.flatten().flatten()
        self.doc = np.repeat(np.arange(len(answers)), pa.compute.fill_null(pa.compute.list_value_length(answers), 0).to_numpy(zero_copy_only=False))

    def of(self, kind: int, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document and bucket of each answer of a kind, its number of values, and all values."""
        mine = np.flatnonzero(self.kind.to_numpy(zero_copy_only=False) == kind)
        data, bucket = self.data.take(pa.array(mine)), self.bucket.to_numpy(zero_copy_only=False)
        values = np.frombuffer(b"".join(data.to_pylist()), dtype)
        sizes = pa.compute.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64) // values.itemsize
        return self.doc[mine], bucket[mine].astype(np.int64), sizes, values

    def apply(self, kind: int, doc: np.ndarray, bucket: np.ndarray, out: np.ndarray) -> None:
        """Puts the values of a kind where their document and bucket are, in order."""
        own, dealt, sizes, values = self.of(kind, out.dtype)
        spread = max(bucket.max(initial=0), dealt.max(initial=0)) + 1
        place = doc * spread + bucket
        order = np.argsort(place, kind="stable")
        first, last = (np.searchsorted(place, own * spread + dealt, side, sorter=order) for side in ("left", "right"))
        if (last - first != sizes).any():
            raise ValueError("answers of another text")
        out[order[B.gather(first, sizes)]] = values


class Answered:
    """A block of documents, the anchors and their codes."""

    def __init__(self, block: B.Block, answers: pa.ListArray, bits: int):
        self.block, self.text, self.given = block, Text(block), Given(answers)
        self.place, self.doc, self.seeds, self.least = anchors(self.text)
        self.first = np.searchsorted(self.doc, np.arange(block.n + 1))
        self.bucket = _leading(B.mixed(self.seeds), bits)
        self.code = np.zeros(len(self.place), np.uint8)
        doc, _, sizes, at = self.given.of(HOT_AT, np.int32)
        self.code[np.repeat(self.first[doc], sizes) + at] = OPEN_HOT
        plain = np.flatnonzero(self.code == 0)
        codes = np.zeros(len(plain), np.uint8)
        self.given.apply(CODE, self.doc[plain], self.bucket[plain], codes)
        self.code[plain] = codes

    def strings(self, which: np.ndarray) -> np.ndarray:
        """For anchors ``which``, a row of flags: may the string that starts l bytes before it be a copy?

        Only strings of which the anchor is the least seed, and that reach no anchor found whole in a smaller doc_id.
        """
        start = self.place[which][:, None] - np.arange(WINDOW)
        inside = (start >= 0) & (start < len(self.least))
        held = np.zeros(len(self.block.data) + 2, np.int32)
        full = self.place[self.code == FULL]
        np.add.at(held, np.maximum(full - RIM, 0), 1)
        np.add.at(held, full + 1, -1)
        sure = np.cumsum(held) > 0
        at = np.where(inside, start, 0)
        return inside & (self.least[at] == self.seeds[which][:, None]) & ~sure[at]

    def open_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        which = np.flatnonzero(self.code == OPEN)
        return which, self.strings(which) if len(which) else np.zeros((0, WINDOW), bool)

    def hot_strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings of hot anchors, in order, and their hashes."""
        which = np.flatnonzero(self.code == OPEN_HOT)
        if not len(which):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        start = np.unique((self.place[which][:, None] - np.arange(WINDOW))[self.strings(which)])
        return start, self.text.ranges(start, start + LENGTH)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.collect_set(F.struct("kind", "bucket", "data")).alias("answers"))


def _answered(batch: pa.RecordBatch, bits: int):
    for block in B.blocks(batch.column("text"), BATCH_BYTES):
        part = batch.slice(block.row, block.n)
        yield part, Answered(block, part.column("answers"), bits)


RIMS = "bucket int, keys binary, ids binary, counts binary, body binary, which binary"


class _RimDealer:
    """Open anchors and hot strings of several blocks of texts, given out as one row a bucket."""

    def __init__(self, open_bits: int):
        self.open_bits = open_bits
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self._empty()

    def _empty(self) -> None:
        self.parts, self.docs, self.n = [], 0, 0

    def take(self, own: Answered, keys: np.ndarray, ids: np.ndarray) -> None:
        data = own.block.data
        which, flags = own.open_anchors()
        at = own.place[which]
        reach = np.concatenate([np.arange(-RIM, 0), np.arange(SEED, LENGTH)])
        around = data[np.clip(at[:, None] + reach, 0, max(0, len(data) - 1))] if len(at) else np.zeros((0, 2 * RIM), np.uint8)
        mask = (flags.astype(np.uint32) << np.arange(WINDOW, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        start, hashes = own.hot_strings()
        doc = np.searchsorted(own.block.offsets, start, "right") - 1
        self.parts.append((keys, ids, own.doc[which] + self.docs, own.seeds[which], mask, around, doc + self.docs, hashes))
        self.docs += len(keys)
        self.n += len(which) + len(start)

    def rows(self) -> pa.RecordBatch:
        rows = []
        if self.parts:
            keys, ids, doc, seed, mask, around, hot_doc, hashes = (np.concatenate(c) for c in zip(*self.parts))
            documents = _Dealer._documents
            for b, mine in _by_bucket(_bucket(seed, self.open_bits)):
                body = seed[mine].tobytes() + mask[mine].tobytes() + around[mine].tobytes()
                rows.append((b, *documents(keys, ids, doc[mine]), self.pack(body), b""))
            for b, mine in _by_bucket(_bucket(hashes, self.open_bits)):
                once, again = np.unique(hashes[mine], return_inverse=True)
                rows.append((b + (1 << self.open_bits), *documents(keys, ids, hot_doc[mine]), once.tobytes(), self.pack(again.astype(np.int32).tobytes())))
        self._empty()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))],
            ["bucket", "keys", "ids", "counts", "body", "which"],
        )


def deal_rims(texts: DataFrame, codes: DataFrame, bits: int, open_bits: int) -> DataFrame:
    """Open anchors by seed, with their surroundings; hot strings by hash, each once a dealing.

    Buckets of hot strings are numbered from ``2 ** open_bits``. A task deals out
    ``RIM_ENTRIES`` at once: a row for each block and bucket would be rows that grow
    with the square of the input.
    """
    def run(batches):
        dealer = _RimDealer(open_bits)
        for batch in batches:
            for part, own in _answered(batch, bits):
                dealer.take(own, part.column("key").to_numpy(), _ids(part.column("doc_id")))
                if dealer.n >= RIM_ENTRIES:
                    yield dealer.rows()
        yield dealer.rows()

    joined = texts.join(_groups(codes), "key")
    return joined.mapInArrow(run, RIMS)


def _bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return _leading(B.mixed(values), bits)


def strings_of(seed: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Hash of each string through a seed: column l starts l bytes before it."""
    value = B.constants(81, 256)
    left, right = B.constants(82, RIM) | np.uint64(1), B.constants(83, RIM) | np.uint64(1)
    n = len(seed)
    before, after = np.zeros((n, WINDOW), np.uint64), np.zeros((n, WINDOW), np.uint64)
    for k in range(RIM):
        before[:, k + 1] = before[:, k] + value[around[:, RIM - 1 - k]] * left[k]
        after[:, k + 1] = after[:, k] + value[around[:, RIM + k]] * right[k]
    return B.mixed(B.mixed(before + seed[:, None]) + after[:, ::-1] + np.arange(WINDOW, dtype=np.uint64))


def settle_rims(dealt: DataFrame, open_bits: int) -> DataFrame:
    """Answers: a bit for each string of an open anchor, a flag for each hot string: is there a smaller doc_id? None where all are no."""
    def copies(kind, bucket, keys, counts, values):
        found = np.maximum.reduceat(values, np.cumsum(counts) - counts) > 0 if len(keys) else np.empty(0, bool)
        return _answers(kind, bucket, keys, counts, values).filter(pa.array(found, pa.bool_()))

    def run(key, table):
        unpack = zstandard.ZstdDecompressor().decompress
        bucket = key[0].as_py()
        rows = table.to_pylist()
        counts = [_array(r, "counts", np.int32).astype(np.int64) for r in rows]
        doc = [np.repeat(_array(r, "ids", np.int64), c) for r, c in zip(rows, counts)]
        keys, per_key = np.concatenate([_array(r, "keys", np.int64) for r in rows]), np.concatenate(counts)
        if bucket >= 1 << open_bits:
            once = [_array(r, "body", np.uint64) for r in rows]
            again = [np.frombuffer(unpack(r["which"]), np.int32) for r in rows]
            distinct = np.unique(np.concatenate(once))
            best = np.full(len(distinct), NO_ID)
            at = [np.searchsorted(distinct, o)[w] for o, w in zip(once, again)]
            at, owner = np.concatenate(at), np.concatenate(doc)
            np.minimum.at(best, at, owner)
            return copies(FLAGS, bucket - (1 << open_bits), keys, per_key, (best[at] < owner).astype(np.uint8))
        hashes, masks = [], []
        for r, c in zip(rows, counts):
            n, body = int(c.sum()), unpack(r["body"])
            seed = np.frombuffer(body, np.uint64, n)
            mask = np.frombuffer(body, np.uint32, n, 8 * n)
            around = np.frombuffer(body, np.uint8, offset=12 * n).reshape(n, 2 * RIM)
            valid = (mask[:, None] >> np.arange(WINDOW, dtype=np.uint32)) & 1 == 1
            masks.append(valid)
            hashes.append(strings_of(seed, around)[valid])
        distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
        valid = np.concatenate(masks)
        owner = np.repeat(np.concatenate(doc), valid.sum(axis=1))
        best = np.full(len(distinct), NO_ID)
        np.minimum.at(best, which, owner)
        bits = np.zeros(valid.shape, np.uint32)
        bits[valid] = best[which] < owner
        return copies(BITS, bucket, keys, per_key, (bits << np.arange(WINDOW, dtype=np.uint32)).sum(axis=1, dtype=np.uint32))

    return dealt.groupBy("bucket").applyInArrow(run, ANSWER)


def _spans(own: Answered, open_bits: int) -> list[np.ndarray]:
    """Maximal removed runs (from, to) of each document of a block."""
    n = len(own.block.data)
    cover = np.zeros(n + 1, np.int32)
    full = own.code == FULL
    np.add.at(cover, np.maximum(own.place[full] - RIM, own.block.offsets[own.doc[full]]), 1)
    np.add.at(cover, np.minimum(own.place[full] + LENGTH, own.block.offsets[own.doc[full] + 1]), -1)
    which = np.flatnonzero(own.code == OPEN)
    start, hashes = own.hot_strings()
    bits, flags = np.zeros(len(which), np.uint32), np.zeros(len(start), np.uint8)
    own.given.apply(BITS, own.doc[which], _bucket(own.seeds[which], open_bits), bits)
    own.given.apply(FLAGS, np.searchsorted(own.block.offsets, start, "right") - 1, _bucket(hashes, open_bits), flags)
    rows, steps = np.nonzero((bits[:, None] >> np.arange(WINDOW, dtype=np.uint32)) & 1)
    copied = np.concatenate([own.place[which][rows] - steps, start[flags > 0]])
    np.add.at(cover, copied, 1)
    np.add.at(cover, copied + LENGTH, -1)
    gone = np.cumsum(cover[:-1]) > 0
    runs = B.runs(gone, own.block.offsets)
    ranges = np.stack([runs.start, runs.end], axis=1)
    return [ranges[runs.first[d] : runs.first[d + 1]] - own.block.offsets[d] for d in range(own.block.n)]


def with_spans(docs: DataFrame, finish, schema) -> tuple[DataFrame, Callable[[], None]]:
    """``finish(batch part, block, spans of each document)`` over all rows, with all columns of ``docs`` at hand.

    Also a function that drops the tables, to be called when the result is written.
    """
    spark = docs.sparkSession
    key, mark = B.unused(docs.columns, "__key", "__judged")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = _bits(size / ((WINDOW + 1) / 2), BUCKET_ENTRIES)
    # Texts by row key, in as many buckets as a shuffle has partitions: later joins leave them in place.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "texts")
    name = "suffix_texts_" + path[-12:]
    keyed = docs.withColumn(key, row_key())
    marked(keyed.repartition(parts, key), key, mark).write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    plain = texts.where(F.col(mark)).select(F.col(key).alias("key"), "doc_id", "text")
    codes = kept(judge(deal(plain, bits)), "suffix-codes")
    n_open = codes.agg(F.coalesce(F.sum("n_open"), F.lit(0))).first()[0]
    open_bits = _bits(n_open, OPEN_ENTRIES)
    rims = settle_rims(deal_rims(plain, codes, bits, open_bits), open_bits)
    rims = kept(rims, "suffix-rims")
    answers = _groups(codes.unionAll(rims))
    (given,) = B.unused(docs.columns, "answers")
    joined = texts.join(answers.select(F.col("key").alias(key), F.col("answers").alias(given)), key, "left").drop(key, mark)

    def run(batches):
        for batch in batches:
            for block in B.blocks(batch.column("text"), BATCH_BYTES):
                part = batch.slice(block.row, block.n)
                own = Answered(block, part.column(given), bits)
                yield finish(part.drop_columns([given]), block, _spans(own, open_bits))

    def drop():
        for table in (codes, rims, texts):
            dropped(table)
        spark.sql(f"DROP TABLE IF EXISTS {name}")

    return joined.mapInArrow(run, schema), drop


def _bits(entries: float, size: int) -> int:
    return min(30, max(0, math.ceil(math.log2(max(1.0, entries) / size))))


def _rest(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    gone = np.zeros(len(data), bool)
    for low, high in spans.tolist():
        gone[low:high] = True
    return gone


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed ranges."""

    def finish(part, block, spans):
        digests, removed = [], []
        for d, own in enumerate(spans):
            data = block.data[block.offsets[d] : block.offsets[d + 1]]
            gone = _rest(data, own)
            digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            removed.append(int(gone.sum()))
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").cast(pa.int64()), pa.array(np.diff(block.offsets)), pa.array(removed, pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()), pa.array(digests, pa.string()),
                pa.array([[{"low": a, "high": b} for a, b in s.tolist()] for s in spans], _RANGES),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:bigint,high:bigint>>"
    found, drop = with_spans(docs.select("doc_id", "text"), finish, schema)
    found = kept(found, "suffix-spans")
    drop()
    return found


_RANGES = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def cut(docs: DataFrame) -> DataFrame:
    """The documents without their repeated spans, with all their columns.

    A character goes only if all its bytes do, so texts stay valid UTF-8. A text
    of which nothing but white space is left is dropped; ``n_chars``, where there is
    such a column, is counted anew.
    """

    def finish(part, block, spans):
        texts = [t if not len(s) else without(t, s) for t, s in zip(part.column("text").to_pylist(), spans)]
        keep = [not len(s) or bool(t.strip()) for t, s in zip(texts, spans)]
        out = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
        if "n_chars" in out.schema.names:
            at = out.schema.get_field_index("n_chars")
            changed = pa.array([len(t) if len(s) else None for t, s in zip(texts, spans)], out.schema.field(at).type)
            out = out.set_column(at, out.schema.field(at), pa.compute.coalesce(changed, out.column(at)))
        return out.filter(pa.array(keep, pa.bool_()))

    return with_spans(docs, finish, docs.schema)[0]


def without(text: str, spans: np.ndarray) -> str:
    """A text without byte ranges, keeping characters that are not covered whole."""
    data = np.frombuffer(text.encode(), np.uint8)
    gone = _rest(data, spans)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, first)
    return data[~np.repeat(whole, np.diff(np.append(first, len(data))))].tobytes().decode()
