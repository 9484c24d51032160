"""The operators' results by plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def solid_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def key(row):
    return tuple((x is not None, x) for x in row)


def near_duplicates(docs, threshold=0.8):
    """Rows (doc_id, class_id, n_links, n_copies, n_shingles) in sorted order."""
    sets = []
    for _, text in docs:
        w = alnum_words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    classes = {}
    for k, s in enumerate(sets):
        if s:
            classes.setdefault(s, []).append(k)
    names = list(classes)
    root = {s: s for s in names}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    links = Counter()
    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            common = len(x & y)
            if 10 * common >= round(threshold * 10) * (len(x) + len(y) - common):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    groups = {}
    for s in names:
        groups.setdefault(find(s), []).extend(docs[k][0] for k in classes[s])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    out = [
        (d, least[find(s)] if s else d, links[s], len(classes[s]) if s else 1, len(s)) for (d, _), s in zip(docs, sets)
    ]
    return sorted(out, key=key)


def repeated_bytes(docs, length=50):
    big = 1 << 63
    first = {}
    for d, text in docs:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, big), big if d is None else d)
    out = []
    for d, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < (big if d is None else d):
                gone[k : k + length] = b"\x01" * length
        rest = bytes(x for x, g in zip(raw, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=key)


def contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = alnum_words(text)
        hit, named = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    named |= {str(x) for x in found if x is not None}
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


def base_figures(docs):
    out = []
    for d, text in docs:
        text = text or ""
        words = solid_words(text)
        lines = [x for x in text.split("\n") if solid_words(x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        symbols = sum(text.count(c) for c in "[#*$%&|<>]"[1:-1])
        out.append((d, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    return sorted(out, key=key)
