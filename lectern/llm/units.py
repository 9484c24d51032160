"""Texts cut into units that a piece vocabulary never crosses, each worked on once.

A unit is a run of spaces with what follows up to the next space. If no piece of
the vocabulary has the space mark after another character, no piece spans two
units, so the encoding of a text is the encodings of its units one after the
other. Distinct units of a block are worked on once and remembered in the Python
worker, at most ``MEMORY_UNITS`` of them; then the memory starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from lectern.llm import blocks as B
from lectern.llm.rans import Known

MARK = "▁"
MEMORY_UNITS = 300_000


def unified(texts: pa.Array) -> pa.Array:
    """The space mark itself, where a text holds one, means a space to the encoder."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    found = pa.compute.match_substring(texts, MARK)
    if pa.compute.any(found).as_py():
        return pa.compute.replace_substring(texts, MARK, " ")
    return texts


def units(block: B.Block) -> B.Words:
    """Byte ranges of the units without the one space that joins a unit to the last."""
    data = block.data
    space = data == 0x20
    n = len(data)
    begins = space.copy()
    edges = block.offsets[:-1][np.diff(block.offsets) > 0]
    if n:
        begins[1:] &= ~space[:-1]
        begins[edges] = True
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, block.offsets)
    end = np.append(start[1:], n) if n else start.copy()
    inner = np.ones(len(start), bool)
    inner[np.searchsorted(start, edges)] = False
    return B.Words(start + inner, end, first)


class Memory:
    """Numbers of units by hash, with whatever was worked out for each."""

    def __init__(self, work: Callable[[list[str]], None]):
        self.work = work
        self.known = Known()
        #: A flag for each number: was it met in a later block, too?
        self.again = np.empty(0, bool)

    def look(self, block: B.Block, found: B.Words) -> np.ndarray:
        """The number of each unit of a block; ``work`` has been given the new ones in order."""
        hashes = B.span_hashes(block.data, found.start, found.end)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        numbers = self.known.numbers(distinct)
        self.again[numbers[numbers >= 0]] = True
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            raw, first = block.data.tobytes(), at[fresh]
            self.work([raw[a:b].decode() for a, b in zip(found.start[first].tolist(), found.end[first].tolist())])
            numbers[fresh] = len(self.again) + np.arange(len(fresh))
            self.known.add(distinct[fresh], numbers[fresh])
            self.again = np.append(self.again, np.zeros(len(fresh), bool))
        return numbers[which]

    def forget(self) -> np.ndarray:
        """Leaves the units that were met in several blocks, numbered anew; returns their former numbers."""
        stays = np.flatnonzero(self.again)
        number = np.full(len(self.again), -1)
        number[stays] = np.arange(len(stays))
        known, self.known = self.known, Known()
        for hashes, former in known.arrays:
            left = number[former] >= 0
            self.known.add(hashes[left], number[former][left])
        self.again = np.zeros(len(stays), bool)
        return stays


def crosses_units(pieces: list[str]) -> bool:
    """Does a piece have the space mark after another character?"""
    return any(MARK in p.lstrip(MARK) for p in pieces)
