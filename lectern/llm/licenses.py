"""License scans: exact phrases, and short notices within a bounded number of edits.

Exact: a text's words (ASCII lower-cased) are hashed; a phrase stands where its
words' hashes stand consecutively.

Fuzzy: a document's words are joined by single spaces. A notice that may have
``e`` edits is split into ``e + 1`` pieces. Any text within ``e`` edits of it holds
one of the pieces unchanged (pigeonhole), so each exact place of a piece gives a
window around it that could hold the notice; windows of a notice that meet are
joined. The ``regex`` library then looks for the notice with at most ``e`` errors
inside the windows only, and reports spans and edits: the best match of a window,
then the best ones of what is left before and after it, so that of places that
overlap the better one stands and no other place is lost. Pieces are found by byte
search over the whole block, so a text without a piece costs no Python step.

Cases: a null or empty text, or one without a word, has zero figures, null places,
empty labels and score 0.0. Places are words from 0. Very long texts are searched
whole; matches never leave their document. Repeated rows are scanned row by row,
other columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm import blocks as B

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices, the label of a match, and the most edits.
NOTICES = (
    ("licensed under the gnu general public license", "gpl", 4),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1),
    ("creative commons attribution", "cc-by", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("all rights reserved", "all-rights-reserved", 2),
    ("spdx license identifier", "spdx", 2),
)

SPAN = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    f"score double, spans {SPAN}"
)
_SPAN_TYPE = pa.list_(
    pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
)


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int

    @property
    def pieces(self) -> list[tuple[int, bytes]]:
        """``edits + 1`` parts of near equal length with their offsets."""
        cuts = [len(self.text) * k // (self.edits + 1) for k in range(self.edits + 2)]
        return [(low, self.text[low:high]) for low, high in zip(cuts, cuts[1:])]

    @property
    def pattern(self):
        # Best match first, so that a span covers the notice and no more.
        return regex.compile(b"(?b)(?:" + regex.escape(self.text, literal_spaces=True) + b"){e<=%d}" % self.edits)


def notices(rows=NOTICES) -> list[Notice]:
    return [Notice(text.encode(), label, edits) for text, label, edits in rows]


def normal_form(block: B.Block, found: B.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by single spaces, the place of each word, and document bounds."""
    inside = B.ALNUM[block.data]
    keep = inside.copy()
    gap = found.end[found.end < len(block.data)]
    keep[gap] = True  # the byte after a word, as a space; a word of the next document needs none
    joined = np.where(inside, B.LOWER[block.data], np.uint8(0x20))[keep]
    place = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return joined.tobytes(), place[found.start], place[block.offsets]


def _places(text: bytes, piece: bytes):
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def _matches(pattern, text: bytes, low: int, high: int, least: int):
    """The best match, then those of the parts before and after it that can hold ``least`` bytes."""
    parts = [(low, high)]
    while parts:
        low, high = parts.pop()
        match = pattern.search(text, low, high) if high - low >= least else None
        if match:
            yield match
            parts += [(match.end(), high), (low, match.start())]


def fuzzy(text: bytes, bounds: np.ndarray, all_notices: list[Notice]) -> list[tuple[int, int, int, str, int, float]]:
    """(document, from, to, label, edits, similarity) of the matches in one block."""
    hits = []
    for notice in all_notices:
        size, e = len(notice.text), notice.edits
        windows = []
        for offset, piece in notice.pieces:
            for at in _places(text, piece):
                doc = int(np.searchsorted(bounds, at, "right")) - 1
                low, high = max(at - offset - e, int(bounds[doc])), min(at - offset + size + e, int(bounds[doc + 1]))
                if high - low >= size - e:
                    windows.append((low, high, doc))
        windows.sort()
        merged: list[list[int]] = []
        for low, high, doc in windows:
            if merged and low <= merged[-1][1] and doc == merged[-1][2]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high, doc])
        pattern = notice.pattern if merged else None
        for low, high, doc in merged:
            for match in _matches(pattern, text, low, high, size - e):
                edits = sum(match.fuzzy_counts)
                hits.append((doc, match.start(), match.end(), notice.label, edits, 1 - edits / size))
    return hits


def exact(hashes: np.ndarray, doc: np.ndarray, phrases: dict[str, str]) -> list[tuple[np.ndarray, str]]:
    """First words of each phrase's places, over the words of a block."""
    found = []
    for phrase, label in phrases.items():
        parts = [np.uint64(B.word_hash(w)) for w in phrase.split()]
        n = len(hashes) - len(parts) + 1
        at = np.flatnonzero(hashes[: max(n, 0)] == parts[0])
        for k, value in enumerate(parts[1:], 1):
            at = at[hashes[at + k] == value]
        found.append((at[doc[at] == doc[at + len(parts) - 1]], label))
    return found


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, rows=NOTICES) -> DataFrame:
    """One row per document: exact places, labels of both searches, best similarity and the notices' spans."""

    def run(batches):
        known = notices(rows)
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                yield _scan_block(batch.column("doc_id").slice(block.row, block.n), block, phrases, known)

    return B.modest(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def _scan_block(ids, block: B.Block, phrases: dict[str, str], known: list[Notice]) -> pa.RecordBatch:
    n = block.n
    found = B.words(block, B.ALNUM)
    doc = found.doc
    hashes = B.span_hashes(B.LOWER[block.data], found.start, found.end)
    n_base, low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    base: dict[int, set[str]] = {}
    for at, label in exact(hashes, doc, phrases):
        for word, d in zip(at.tolist(), doc[at].tolist()):
            place = word - int(found.first[d])
            n_base[d] += 1
            low[d] = place if low[d] < 0 else min(low[d], place)
            high[d] = max(high[d], place)
            base.setdefault(d, set()).add(label)
    text, word_at, bounds = normal_form(block, found)
    labels = {d: set(x) for d, x in base.items()}
    score = {d: 1.0 for d in base}
    spans: dict[int, list[dict]] = {}
    for d, start, end, label, edits, likeness in fuzzy(text, bounds, known):
        labels.setdefault(d, set()).add(label)
        score[d] = max(score.get(d, 0.0), likeness)
        first = max(int(np.searchsorted(word_at, start, "right")) - 1, int(found.first[d]))
        last = max(int(np.searchsorted(word_at, end, "left")) - 1, first)
        spans.setdefault(d, []).append(
            {"label": label, "first_word": first - int(found.first[d]), "last_word": last - int(found.first[d]), "edits": edits}
        )
    joined = lambda x: [",".join(sorted(x.get(d, ()))) for d in range(n)]
    order = lambda s: (s["first_word"], s["last_word"], s["label"])
    return pa.RecordBatch.from_arrays(
        [
            ids.cast(pa.int64()),
            pa.array(found.counts, pa.int64()),
            pa.array(n_base),
            pa.array(low, mask=low < 0),
            pa.array(high, mask=high < 0),
            pa.array(joined(base)),
            pa.array(joined(labels)),
            pa.array([score.get(d, 0.0) for d in range(n)], pa.float64()),
            pa.array([sorted(spans.get(d, []), key=order) for d in range(n)], _SPAN_TYPE),
        ],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
    )
