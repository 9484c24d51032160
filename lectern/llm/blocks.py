"""Texts of an Arrow batch as byte blocks, and array work on their words.

A block holds whole documents, about ``limit`` bytes of them, so a task's memory
follows the block and its longest document, never the batch or the partition.
UTF-8 needs no decoding here: both word rules treat every byte above 0x7F as a
part of a word, so byte positions split words exactly as code points would.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 512 << 10
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE = 0xD1342543DE82EF95
_PIECE = 1 << 20

SPACES = (0x20, *range(0x09, 0x0E))


ROWS_AT_ONCE = 1000
BYTES_AT_ONCE = 4 << 20


def modest(df):
    """The same table; its session passes texts to Python at most ``ROWS_AT_ONCE`` rows or about ``BYTES_AT_ONCE`` bytes at a time.

    Ten thousand texts, the usual number, are copied several times between the JVM
    and Python, and are most of a task's memory. Results do not depend on it.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ROWS_AT_ONCE), ("maxBytesPerBatch", BYTES_AT_ONCE)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub(r"\D", "", conf.get(name)) or 0) <= most:
            conf.set(name, str(most))
    return df


def remembered(file: str, make):
    """``make(file)``, once a worker process and state of the file.

    The package reaches workers by value, with new globals for each task; what is
    kept in ``sys`` stays as long as the process.
    """
    store = vars(sys).setdefault("_lectern_files", {})
    state = os.stat(file)
    key = (make.__name__, file, state.st_mtime_ns, state.st_size)
    if key not in store:
        store[key] = make(file)
    return store[key]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, longer where a table has a column of that name."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: the finalising steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit values that a seed decides."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD)) + np.uint64((seed * _BASE) & _MASK))


def byte_class(members) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


#: Letters, digits and every byte of a character beyond ASCII.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Everything but ASCII white space.
SOLID = ~byte_class(SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE_VALUE = constants(17, 256)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n`` of each; few enough to keep are kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        found.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 2 * _PIECE:
        _powers[:] = found
    return found[0], found[1]


@dataclass
class Block:
    """Documents ``row .. row + n`` of a batch as one byte string."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for each document."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    flat = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "").cast(pa.large_binary())
    n = len(flat)
    if not n:
        return
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n + 1]
    body = flat.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield Block(low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


@dataclass
class Words:
    """Byte ranges of words; ``first[d]`` is the first word of document ``d``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of flagged bytes that stay inside one document."""
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    if n:
        edges = offsets[(offsets > 0) & (offsets < n)]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edges] = False
        begins &= ~before
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edges - 1] = False
        ends &= ~after
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def words(block: Block, member: np.ndarray) -> Words:
    return runs(member[block.data], block.offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; the ranges are in order and do not overlap."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        base = int(start[low])
        high = max(low + 1, int(np.searchsorted(end, base + _PIECE, "right")))
        top = int(end[high - 1])
        power, inverse = powers(top - base + 1)
        total = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data[base:top]] * power[: top - base], out=total[1:])
        s, e = start[low:high] - base, end[low:high] - base
        out[low:high] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_GOLD)
        low = high
    return mixed(out)


def word_hash(word: str) -> int:
    """The hash that ``span_hashes`` gives to one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def gram_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` values, in order of its start; empty if there are fewer."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k, factor in enumerate(constants(1000 + seed, size) | np.uint64(1)):
        total += hashes[k : len(hashes) - size + 1 + k] * factor
        total ^= total >> np.uint64(29)
    return mixed(total)


def grams_inside(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the ``n - size + 1`` runs stay inside one document."""
    valid = np.ones(max(0, n - size + 1), bool)
    for step in range(1, size):
        cut = first[1:-1] - step
        valid[cut[(cut >= 0) & (cut < len(valid))]] = False
    return valid


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Integer sums of ``values[first[d]:first[d + 1]]``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
