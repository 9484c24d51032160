"""Token-ID files: static range asymmetric numeral system over one shared frequency table.

**Layout.** A folder with ``table`` (one row: the vocabulary's quantised frequencies),
``blocks`` (a folder a range of doc_ids; a row is a block) and ``files`` (tokens of
each range and of all ranges before it). A block holds whole documents, in ascending
doc_id order, ``BLOCK`` tokens or one longer document, and is decoded from its own
row and the table alone. Spark's Parquet writer and commit protocol put the rows
down, so a lost executor leaves no half file, in any store that Spark reaches.

**Coding.** ``LANES`` interleaved states of 64 bits take the tokens in turn: token i
goes to lane i modulo ``LANES``. A state x takes a token with frequency f of 2^20 as
``(x // f) * 2^20 + x mod f + start``; a state that would leave its range first gives
32 bits to the stream. Every id of the vocabulary has a frequency of at least one,
so a table fitted on some tokens encodes any others too.

**Checkpoints.** Each ``SEGMENT`` tokens the block notes its lanes' states and its
place in the stream. Segments are decoded side by side, as lanes of one array, and
so are all blocks that a task holds at once. Each segment has a checksum (crc32 of
its ids); one that does not match raises an error that names the block.

**As a job.** Documents are range-partitioned by doc_id and then a random salt, so
rows that share an id are spread. Each range is tokenized in order, once, and its
plain blocks are kept in the shared folder. Ids are counted per task and summed by
Spark; only the table, one number for each id of the vocabulary, meets the driver
and is broadcast. Plain blocks are coded row by row, and then dropped. The running
sum over ranges is one row a range.

A text is cut where the byte-level splitter never joins (``pieces``), so the ids of
its distinct pieces, worked out once by the library and remembered (at most
``MEMORY_PIECES`` a worker; then anew), are the ids of the text. Texts with the
string of a special token, and vocabularies with another splitter, are given to the
library whole.

Cases: a null or empty text has the end id alone. A null doc_id sorts first. Rows
that share a doc_id follow each other in no fixed order. Very long texts are one
block. An empty table writes no block and gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.session import dropped, scratch_path

SCALE = 20
LANES = 32
STEPS = 512
SEGMENT = LANES * STEPS
BLOCK = 4 * SEGMENT
LOW = 1 << 31
AT_ONCE = 24
MEMORY_PIECES = 1_000_000
_MASK = np.uint64((1 << SCALE) - 1)
_32 = np.uint64(32)
_S = np.uint64(SCALE)


# ---- the coder ----------------------------------------------------------------
def quantised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^scale, one at least, the rest by largest remainder."""
    n, total = len(counts), int(counts.sum())
    free = (1 << scale) - n
    if free < 0:
        raise ValueError(f"{n} ids do not fit into {1 << scale} places")
    if not total:
        counts, total = np.ones(n, np.int64), n
    exact = [int(c) * free for c in counts.tolist()]
    out = np.array([e // total for e in exact], np.int64)
    rest = np.array([e % total for e in exact], np.float64)
    order = np.lexsort((np.arange(n), -rest))
    out[order[: free - int(out.sum())]] += 1
    return out + 1


class Coder:
    """Encoder and decoder of one frequency table."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.start = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, groups: list[np.ndarray]) -> list[dict]:
        """A block for each array of ids: n, states and places at checkpoints, stream, checksums."""
        segments, owner = [], []
        for b, ids in enumerate(groups):
            for low in range(0, len(ids), SEGMENT):
                segments.append(ids[low : low + SEGMENT])
                owner.append(b)
        # Blocks are independent, and so are the steps of their lanes; the segments of a block are a chain.
        blocks = [{"n": len(ids), "states": [], "places": [], "sums": [], "words": []} for ids in groups]
        longest = max(map(owner.count, set(owner)), default=0)
        state = np.full((len(groups), LANES), LOW, np.uint64)
        by_block = [[s for s, o in zip(segments, owner) if o == b] for b in range(len(groups))]
        for turn in range(1, longest + 1):
            # From the last segment to the first: a decoder reads them the other way.
            rows = [b for b in range(len(groups)) if len(by_block[b]) >= turn]
            own = [by_block[b][-turn] for b in rows]
            state[rows], words = self._segment(own, state[rows])
            for b, ids, lanes, stream in zip(rows, own, state[rows], words):
                blocks[b]["states"].append(lanes.copy())
                blocks[b]["words"].append(stream)
                blocks[b]["sums"].append(zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))
        for block in blocks:
            for name in ("states", "words", "sums"):
                block[name].reverse()
            sizes = [len(w) for w in block["words"]]
            block["places"] = np.cumsum([0, *sizes])[:-1].astype(np.uint32) if sizes else np.empty(0, np.uint32)
        return blocks

    def _segment(self, own: list[np.ndarray], state: np.ndarray):
        n, width = len(own), max(-(-len(ids) // LANES) for ids in own)
        ids = np.zeros((n, width * LANES), np.int64)
        real = np.zeros((n, width * LANES), bool)
        for k, x in enumerate(own):
            ids[k, : len(x)], real[k, : len(x)] = x, True
        # With step first, each step is one contiguous row over all blocks and lanes.
        ids = ids.reshape(n, width, LANES).transpose(1, 0, 2).reshape(width, -1)
        real = real.reshape(n, width, LANES).transpose(1, 0, 2).reshape(width, -1)
        x = state.reshape(-1)
        out, gives = np.zeros((width, n * LANES), np.uint32), np.zeros((width, n * LANES), bool)
        full = real.all(axis=1)
        for step in range(width - 1, -1, -1):
            f, c = self.freq[ids[step]], self.start[ids[step]]
            give = (x >> np.uint64(63 - SCALE)) >= f
            if not full[step]:
                give &= real[step]
            out[step] = x.astype(np.uint32)
            gives[step] = give
            x = np.where(give, x >> _32, x)
            q = x // f
            moved = (q << _S) + (x - q * f) + c
            x = moved if full[step] else np.where(real[step], moved, x)
        out, gives = out.reshape(width, n, LANES), gives.reshape(width, n, LANES)
        return x.reshape(n, LANES), [out[:, k][gives[:, k]] for k in range(n)]

    def decode(self, blocks: list[dict]) -> list[np.ndarray]:
        """The ids of each block. All segments of all blocks are read side by side."""
        states, streams, sizes = [], [], []
        for block in blocks:
            ends = [*block["places"][1:].tolist(), len(block["stream"])]
            for k, place in enumerate(block["places"].tolist()):
                states.append(block["states"][k])
                streams.append(block["stream"][place : ends[k]])
                sizes.append(min(SEGMENT, block["n"] - k * SEGMENT))
        out = self._read(states, streams, np.array(sizes, np.int64)) if states else []
        found, at = [], 0
        for block in blocks:
            own = out[at : at + len(block["places"])]
            at += len(own)
            for k, ids in enumerate(own):
                if zlib.crc32(ids.tobytes()) != int(block["sums"][k]):
                    raise ValueError(f"checksum of segment {k} of block {block.get('name')} does not match")
            found.append(np.concatenate(own) if own else np.empty(0, np.uint32))
        return found

    def _read(self, states, streams, sizes: np.ndarray) -> list[np.ndarray]:
        n, width = len(states), int(-(-sizes.max() // LANES))
        x = np.stack(states)
        stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        lengths = np.array([len(s) for s in streams], np.int64)
        at = np.cumsum(lengths) - lengths
        out = np.zeros((width, n, LANES), np.uint32)
        least = int(sizes.min()) // LANES
        for step in range(width):
            slot = x & _MASK
            token = self.symbol[slot.astype(np.int64)]
            moved = self.freq[token] * (x >> _S) + slot - self.start[token]
            if step >= least:
                real = step * LANES + np.arange(LANES) < sizes[:, None]
                moved = np.where(real, moved, x)
            take = moved < LOW
            if step >= least:
                take &= real
            order = np.cumsum(take, axis=1)
            word = stream[np.where(take, at[:, None] + order - 1, len(stream) - 1)]
            x = np.where(take, (moved << _32) | word, moved)
            at += order[:, -1]
            out[step] = token
        return [np.ascontiguousarray(out[:, k].reshape(-1)[: sizes[k]], "<u4") for k in range(n)]


# ---- tokens -------------------------------------------------------------------
def _kinds() -> np.ndarray:
    """1 letter, 2 sign, 3 white space (ASCII), 4 lead byte of a character that is not white space, 0 other."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = 2
    for low, high in ((0x41, 0x5B), (0x61, 0x7B)):
        kinds[low:high] = 1
    kinds[0x30:0x3A] = 5  # a digit
    kinds[list(B.SPACES)] = 3
    kinds[0xC3:0xF5] = 4
    kinds[[0xE1, 0xE2, 0xE3]] = 0  # lead bytes of white space beyond ASCII
    return kinds


_KIND = _kinds()


def pieces(block: B.Block) -> np.ndarray:
    """Starts of pieces that the byte-level splitter never joins.

    A piece begins with a document; with a space that a character other than white
    space follows; with ASCII white space behind an ASCII letter, digit or sign; with
    a sign behind an ASCII letter; and with an ASCII letter behind a lone line end.
    """
    data, n = block.data, len(block.data)
    kind = _KIND[data]
    solid = (kind == 1) | (kind == 2) | (kind == 5)
    begins = np.zeros(n, bool)
    begins[:-1] = (data[:-1] == 0x20) & (solid | (kind == 4))[1:]
    begins[1:] |= ((kind[1:] == 3) & solid[:-1]) | ((kind[1:] == 2) & (kind[:-1] == 1))
    begins[2:] |= (kind[2:] == 1) & (data[1:-1] == 0x0A) & solid[:-2]
    begins[block.offsets[:-1][np.diff(block.offsets) > 0]] = True
    return np.flatnonzero(begins)


class Known:
    """Numbers of 64-bit keys in two sorted arrays, a large one and a small one that is merged into it when it grows."""

    SMALL = 1 << 16

    def __init__(self):
        self.arrays = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2)]

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.arrays)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that is not known."""
        out = np.full(len(keys), -1, np.int64)
        for known, numbers in self.arrays:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = numbers[at[hit]]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self._merge(1, keys, numbers)
        if len(self.arrays[1][0]) > self.SMALL:
            self._merge(0, *self.arrays[1])
            self.arrays[1] = (keys[:0], numbers[:0])

    def _merge(self, k: int, keys: np.ndarray, numbers: np.ndarray) -> None:
        keys, numbers = np.concatenate([self.arrays[k][0], keys]), np.concatenate([self.arrays[k][1], numbers])
        order = np.argsort(keys, kind="stable")
        self.arrays[k] = (keys[order], numbers[order])


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy with room for ``n`` entries."""
    return array if n <= len(array) else np.concatenate([array, np.empty(max(n, 2 * len(array)) - len(array), array.dtype)])


class Tokens:
    """Ids of texts by the library, each distinct piece of text worked on once."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as source:
            given = json.load(source)
        self.library = Tokenizer.from_file(file)
        splitter, added = given.get("pre_tokenizer") or {}, given["added_tokens"]
        self.cut = (
            splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
            and given.get("normalizer") is None and given["model"].get("type", "BPE") == "BPE"
            and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        )
        # Pieces are given to the library in one text, with a special token between them; pieces that may hold a part of one go alone.
        # Pieces are given to the library in one text, with a special token between them.
        self.mark = next((t for t in added if t["special"]), None) if self.cut else None
        # Signs part from letters, which would cut a special token in two, so texts that hold one are encoded whole.
        self.special = [t["content"].encode() for t in added]
        self.size = self.library.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.known, self.n, self.used = Known(), 0, 0
        self.flat, self.starts, self.counts = np.empty(1 << 16, np.uint32), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def _alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and each one's count."""
        if self.mark is None:
            found = self._alone(texts)
            return np.array([x for ids in found for x in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        ids = np.array(self._alone([self.mark["content"].join(texts)])[0], np.uint32)
        ends = np.append(np.flatnonzero(ids == self.mark["id"]), len(ids))
        return ids[ids != self.mark["id"]], np.diff(np.append(-1, ends)) - 1

    def _learn(self, texts: list[str]) -> np.ndarray:
        first = self.n
        for low in range(0, len(texts), 500):
            ids, counts = self._ids(texts[low : low + 500])
            self.flat = _room(self.flat, self.used + len(ids))
            self.starts, self.counts = _room(self.starts, self.n + len(counts)), _room(self.counts, self.n + len(counts))
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
            self.counts[self.n : self.n + len(counts)] = counts
            self.n, self.used = self.n + len(counts), self.used + len(ids)
        return np.arange(first, self.n)

    def of(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of a block one after the other, and each document's count."""
        data, n = block.data, len(block.data)
        if not n:
            return np.empty(0, np.uint32), np.zeros(block.n, np.int64)
        raw = data.tobytes()
        if not self.cut or any(s in raw for s in self.special):
            found = self._alone([raw[a:b].decode() for a, b in zip(block.offsets.tolist(), block.offsets[1:].tolist())])
            return np.array([x for ids in found for x in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        start = pieces(block)
        end = np.append(start[1:], n)
        distinct, at, which = np.unique(B.span_hashes(data, start, end), return_index=True, return_inverse=True)
        if self.n > MEMORY_PIECES or self.used > 8 * MEMORY_PIECES:
            self._forget()
        numbers = self.known.numbers(distinct)
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            first = at[fresh]
            numbers[fresh] = self._learn([raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())])
            self.known.add(distinct[fresh], numbers[fresh])
        numbers = numbers[which]
        counts = self.counts[numbers]
        return self.flat[B.gather(self.starts[numbers], counts)], B.segment_sums(counts, np.searchsorted(start, block.offsets))


def tokens(file: str) -> Tokens:
    return B.remembered(file, Tokens)


def _split(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.append(0, ends) * ids.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(ids).tobytes())]
    ).cast(pa.binary())


#: A block before it is coded: its file, number, tokens of the file's earlier blocks, and ids in the least width that holds the vocabulary.
RAW = "part int, block int, before long, n long, doc_ids array<long>, sizes array<long>, ids binary"
_RAW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()),
])


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def raw_blocks(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """The documents' ids with the end id, in blocks, in ascending doc_id order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        own, part = tokens(file), TaskContext.get().partitionId()
        kind = _width(max(own.size, end_id + 1))
        names, held, n, number, before = [], [], 0, 0, 0

        def block():
            return pa.RecordBatch.from_pylist(
                [{
                    "part": part, "block": number, "before": before, "n": n, "doc_ids": names, "sizes": [len(x) for x in held],
                    "ids": np.concatenate(held).tobytes(),
                }],
                schema=_RAW,
            )

        for batch in batches:
            doc_ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for some in B.blocks(batch.column("text")):
                ids, counts = own.of(some)
                ends = np.cumsum(counts)
                for d, (low, high) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    names.append(doc_ids[some.row + d])
                    held.append(np.append(ids[low:high], end_id).astype(kind))
                    n += high - low + 1
                    if n >= BLOCK:
                        yield block()
                        names, held, n, number, before = [], [], 0, number + 1, before + n
        if names:
            yield block()

    # A salt below the id: rows that share an id are spread over ranges.
    ranged = docs.select("doc_id", "text", F.rand(7).alias("salt")).repartitionByRange(parts, "doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    return B.modest(ranged.select("doc_id", "text")).mapInArrow(run, RAW)


def frequencies(raw: DataFrame, size: int) -> np.ndarray:
    """Quantised frequencies of all ids; each task gives one row an id at most."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), _width(size)), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    return quantised(counts)


# ---- files --------------------------------------------------------------------
BLOCKS = "block int, before long, n long, doc_ids array<long>, sizes array<long>, states binary, places binary, sums array<long>, stream binary, part int"
_BLOCKS = pa.schema([
    ("block", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("states", pa.binary()), ("places", pa.binary()), ("sums", pa.list_(pa.int64())), ("stream", pa.binary()), ("part", pa.int32()),
])


def write(docs: DataFrame, folder: str, file: str, end_id: int = 0) -> None:
    """Write the ids of all documents as files into a folder."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-blocks")
    raw_blocks(docs, file, end_id).write.option("compression", "zstd").parquet(path)
    raw = B.modest(spark.read.schema(RAW).parquet(path))
    size = max(tokens(file).size, end_id + 1)
    table = frequencies(raw, size)
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        coder = Coder(shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(low, AT_ONCE)
                made = coder.encode([np.frombuffer(ids.as_buffer(), _width(size)) for ids in batch.column("ids")])
                coded = {
                    "states": [np.stack(m["states"]).astype("<u8").tobytes() for m in made],
                    "places": [m["places"].astype("<u4").tobytes() for m in made],
                    "sums": [m["sums"] for m in made],
                    "stream": [np.concatenate(m["words"]).astype("<u4").tobytes() for m in made],
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array(coded[f.name], f.type) if f.name in coded else batch.column(f.name) for f in _BLOCKS], schema=_BLOCKS
                )

    raw.mapInArrow(run, BLOCKS).write.option("compression", "none").partitionBy("part").parquet(f"{folder}/blocks")
    spark.createDataFrame([(SCALE, end_id, table.tolist())], "scale int, end_id long, frequencies array<long>").coalesce(1).write.parquet(f"{folder}/table")
    sizes = raw.groupBy("part").agg(F.sum("n").alias("tokens"))
    sizes.select("part", "tokens", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("start")).write.parquet(f"{folder}/files")
    dropped(raw)


def _decoded(spark: SparkSession, folder: str, column: str, of) -> DataFrame:
    """doc_id, start, n_tokens of every document, and ``of(ids, ends)`` of each block as a column."""
    scale, _, table = spark.read.parquet(f"{folder}/table").first()
    if scale != SCALE:
        raise ValueError(f"frequencies of 2^{scale}, not of 2^{SCALE}")
    shared = spark.sparkContext.broadcast(np.array(table, np.int64))

    def run(batches):
        coder = Coder(shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, AT_ONCE):
                rows = whole.slice(low, AT_ONCE).to_pylist()
                found = coder.decode([
                    {
                        "n": r["n"], "states": np.frombuffer(r["states"], "<u8").reshape(-1, LANES), "places": np.frombuffer(r["places"], "<u4"),
                        "sums": r["sums"], "stream": np.frombuffer(r["stream"], "<u4"), "name": (r["part"], r["block"]),
                    }
                    for r in rows
                ])
                for r, ids in zip(rows, found):
                    ends = np.cumsum(r["sizes"])
                    inner = r["before"] + np.append(0, ends)[:-1].astype(np.int64)
                    part = pa.array(np.full(len(ends), r["part"], np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [part, pa.array(r["doc_ids"], pa.int64()), pa.array(inner), pa.array(r["sizes"], pa.int64()), of(ids, ends)],
                        ["part", "doc_id", "inner", "n_tokens", "own"],
                    )

    kind = "binary" if column == "ids" else "long"
    stored = B.modest(spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"))
    docs = stored.mapInArrow(run, f"part int, doc_id long, inner long, n_tokens long, own {kind}")
    # One row a file, as many as the writer had ranges.
    files = F.broadcast(spark.read.schema("part int, tokens long, start long").parquet(f"{folder}/files"))
    return docs.join(files, "part").select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", F.col("own").alias(column))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit) of every document of a folder, from its files."""
    return _decoded(spark, folder, "ids", _split)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a folder, from its files."""

    def of(ids, ends):
        raw = memoryview(ids).cast("B")
        edges = [0, *(4 * ends).tolist()]
        return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])], pa.int64())

    return _decoded(spark, folder, "ids_crc32", of)


def round_trip(docs: DataFrame, file: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written to the shared folder and read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "rans")
    write(docs, folder, file, end_id)
    return checksums(spark, folder)
