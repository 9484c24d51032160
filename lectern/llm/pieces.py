"""SentencePiece encoding and decoding: pieces from an Aho-Corasick automaton, merged in rank order.

The automaton holds all pieces. How they make an encoding is the model file's own
choice (``trainer_spec.model_type``):

* BPE: a score is a rank. A unit starts as single characters; of all neighbours
  that join to a piece of the automaton those with the highest score are joined
  first, the leftmost of equals, until none is left. A heap keeps the neighbours, so
  a unit of n characters takes n log n steps.
* unigram: the highest sum of scores (Viterbi). One pass over the characters
  yields, for each position, every piece that ends there: the automaton's output
  links. Each of them relaxes the best score of the position; the earliest start
  wins a tie, as in the library. Sums are double, so that a text's length does not
  blur them.

The ids are the library's. A character that is no piece is written as byte pieces
and counts in the score as the lowest score less ten.

Units (``units``) are encoded once each; pieces never cross them, so the encoding
of a text is that of its units. A worker remembers up to ``MEMORY_UNITS`` of them
from task to task; then those that were met only once are forgotten. Decoding joins pieces, turns byte pieces into
UTF-8 and drops the space put before the text.

Cases: a null or empty text has no ids, score 0.0 and decodes to an empty text.
The space mark U+2581 in a text means a space, so such a text comes back with
spaces (``round_trip`` compares with that). Very long texts are encoded whole.
Repeated rows are encoded row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from lectern.llm import blocks as B
from lectern.llm import units as U

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
MEMORY_UNITS = 400_000
#: Longer texts are merged from a heap: looking through all neighbours each time is quadratic.
SHORT = 40


class Encoder:
    """Pieces of one model file and the units met so far."""

    def __init__(self, model_file: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that leave the text as it is and put a space before it")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only BPE and unigram models")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("only models without pieces that users have set or left unused")
        self.best_path = self.viterbi if model.trainer_spec.model_type == UNIGRAM else self.ranked
        self.automaton = ahocorasick.Automaton()
        self.scores = np.zeros(len(model.pieces))
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        names = []
        for number, piece in enumerate(model.pieces):
            self.scores[number] = piece.score
            if piece.type == NORMAL:
                self.automaton.add_word(piece.piece, (len(piece.piece), number, piece.score))
                names.append(piece.piece)
                self.raw.append(piece.piece.replace(U.MARK, " ").encode())
            elif piece.type == BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_ids[value] = number
                self.raw.append(bytes([value]))
            else:
                self.raw.append(b"")
        if U.crosses_units(names):
            raise ValueError("a piece of this vocabulary crosses a space; units cannot be encoded alone")
        self.automaton.make_automaton()
        self.unknown = min(p.score for p in model.pieces if p.type == NORMAL) - UNKNOWN_PENALTY
        self.reset()

    def reset(self) -> None:
        self.memory = U.Memory(self._encode)
        self.ids: list[np.ndarray] = []
        self.pool = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)
        self.sums = np.empty(0)

    def forget(self) -> None:
        """Makes room: units met once go, or all where that is not enough."""
        stays = self.memory.forget()
        if 2 * len(stays) > MEMORY_UNITS:
            self.reset()
            return
        lengths = self.start[stays + 1] - self.start[stays]
        self.pool = self.pool[B.gather(self.start[stays], lengths)]
        self.start = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        self.sums = self.sums[stays]

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Ids and score of a text that already has its space marks."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(text)
        end, piece = next(matches, (n, None))
        for at in range(n):
            goal, single = at + 1, False
            while end == at and piece is not None:
                length, number, score = piece
                total = best[goal - length] + score
                if best[goal] is None or total > best[goal]:
                    best[goal], back[goal] = total, (goal - length, number)
                single = single or length == 1
                end, piece = next(matches, (n, None))
            if not single:
                total = best[at] + self.unknown
                if best[goal] is None or total > best[goal]:
                    best[goal], back[goal] = total, (at, -1)
        ids: list[int] = []
        at = n
        while at:
            low, number = back[at]
            ids += [number] if number >= 0 else [self.byte_ids[b] for b in reversed(text[low:at].encode())]
            at = low
        return ids[::-1], best[n]

    def merge(self, text: str) -> list[int]:
        """Where each part of a text begins, and its end, when neighbours are joined in rank order."""
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # first place of the next and of the last part
        known = self.automaton.get
        agenda = []
        for at in range(n - 1):
            piece = known(text[at : at + 2], None)
            if piece:
                agenda.append((-piece[2], at, at + 1, at + 2))
        heapify(agenda)
        while agenda:
            _, low, middle, high = heappop(agenda)
            # Parts that have changed since are not as the entry has them.
            if after[low] != middle or middle >= n or after[middle] != high:
                continue
            after[low], after[middle] = high, -1
            if high < n:
                before[high] = low
                piece = known(text[low : after[high]], None)
                if piece:
                    heappush(agenda, (-piece[2], low, high, after[high]))
            last = before[low]
            if last >= 0:
                piece = known(text[last:high], None)
                if piece:
                    heappush(agenda, (-piece[2], last, low, high))
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(after[cuts[-1]])
        return cuts

    def merge_short(self, text: str) -> tuple[list[int], float]:
        """Ids and score of a short text: one pass of the automaton finds all its pieces, the neighbours stand in a list."""
        width = len(text) + 1
        find = {(end + 1 - piece[0]) * width + end + 1: piece for end, piece in self.automaton.iter(text)}.get
        none = (0, 0, -math.inf)
        cuts = list(range(width))
        joined = [find(at * width + at + 2, none)[2] for at in range(len(text) - 1)]
        while joined and (best := max(joined)) > -math.inf:
            at = joined.index(best)
            del cuts[at + 1], joined[at]
            if at < len(joined):
                joined[at] = find(cuts[at] * width + cuts[at + 2], none)[2]
            if at:
                joined[at - 1] = find(cuts[at - 1] * width + cuts[at + 1], none)[2]
        ids: list[int] = []
        total = 0.0
        for low, high in zip(cuts, cuts[1:]):
            piece = find(low * width + high)
            if piece:
                ids.append(piece[1])
                total += piece[2]
            else:
                ids += [self.byte_ids[b] for b in text[low:high].encode()]
                total += self.unknown
        return ids, total

    def ranked(self, text: str) -> tuple[list[int], float]:
        """Ids and score by merging, of a text that already has its space marks."""
        if len(text) <= SHORT:
            return self.merge_short(text)
        ids: list[int] = []
        total = 0.0
        cuts = self.merge(text)
        for low, high in zip(cuts, cuts[1:]):
            piece = self.automaton.get(text[low:high], None)
            if piece:
                ids.append(piece[1])
                total += piece[2]
            else:
                ids += [self.byte_ids[b] for b in text[low:high].encode()]
                total += self.unknown
        return ids, total

    def _encode(self, texts: list[str]) -> None:
        found = [self.best_path(U.MARK + t.replace(" ", U.MARK)) for t in texts]
        lengths = np.array([len(ids) for ids, _ in found], np.int64)
        self.pool = np.concatenate([self.pool, np.fromiter((x for ids, _ in found for x in ids), np.int32, int(lengths.sum()))])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.sums = np.concatenate([self.sums, [s for _, s in found]])

    def encode_block(self, block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all documents of a block, the first id of each, and scores."""
        if len(self.sums) > MEMORY_UNITS:
            self.forget()
        found = U.units(block)
        numbers = self.memory.look(block, found)
        lengths = self.start[numbers + 1] - self.start[numbers]
        ids = self.pool[B.gather(self.start[numbers], lengths)]
        running = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(lengths, out=running[1:])
        # Scores are whole numbers in all files met so far, so these differences lose nothing.
        sums = np.zeros(len(numbers) + 1)
        np.cumsum(self.sums[numbers], out=sums[1:])
        return ids, running[found.first], sums[found.first[1:]] - sums[found.first[:-1]]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encoder(model_file: str) -> Encoder:
    return B.remembered(model_file, Encoder)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text, ids and score of each row."""

    def run(batches):
        own = encoder(model_file)
        for batch in batches:
            texts = batch.column("text")
            for block in B.blocks(U.unified(texts)):
                ids, first, scores = own.encode_block(block)
                part = batch.slice(block.row, block.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("text").cast(pa.string()),
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(scores, pa.float64()),
                    ],
                    ["doc_id", "text", "ids", "score"],
                )

    return B.modest(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, text string, ids array<int>, score double")


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text of its ``ids`` (null: empty)."""

    def run(batches):
        own = encoder(model_file)
        for batch in batches:
            texts = [own.decode(ids.values.to_pylist()) if ids.is_valid else "" for ids in batch.column("ids")]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, decoded string")


SUMMARY = (
    "doc_id long, n_bytes long, n_tokens long, score double, ids_sha256 string, decoded_sha256 string, round_trip boolean"
)


def round_trips(docs: DataFrame, model_file: str) -> DataFrame:
    """Encode and decode every text in one pass; digests of the ids (int32, little-endian) and of the decoded text."""

    def run(batches):
        own = encoder(model_file)
        for batch in batches:
            texts = U.unified(batch.column("text"))
            for block in B.blocks(texts):
                ids, first, scores = own.encode_block(block)
                raw, bounds, offsets = block.data.tobytes(), first.tolist(), block.offsets.tolist()
                ids_hash, text_hash, same = [], [], []
                for d in range(block.n):
                    mine = ids[bounds[d] : bounds[d + 1]]
                    back = own.decode(mine.tolist()).encode()
                    ids_hash.append(hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(back).hexdigest())
                    same.append(back == raw[offsets[d] : offsets[d + 1]])
                own_sizes = pa.compute.fill_null(
                    pa.compute.binary_length(batch.column("text").slice(block.row, block.n).cast(pa.string())), 0
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.row, block.n).cast(pa.int64()),
                        own_sizes.cast(pa.int64()),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(scores, pa.float64()),
                        pa.array(ids_hash), pa.array(text_hash), pa.array(same),
                    ],
                    [c.strip().split(" ")[0] for c in SUMMARY.split(",")],
                )

    return B.modest(docs).select("doc_id", "text").mapInArrow(run, SUMMARY)
