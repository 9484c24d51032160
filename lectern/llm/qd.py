"""Singular values and right singular vectors of a small upper triangular matrix by qd methods.

Householder reflections bring the matrix to an upper bidiagonal one. Its singular
values come from dqds (differential quotient-difference transforms with shifts),
which keeps relative accuracy, as no subtraction of unlike signs occurs at zero
shift. A vector comes from a twisted factorisation: the stationary transform from
the top and the progressive one from the bottom meet where the remainder is least.
Values that agree in their leading digits get a representation shifted close to
them, in which they differ in theirs.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
TINY = np.finfo(np.float64).tiny
#: Relative distance from which values count as apart.
APART = 1e-3
DEEPEST = 6


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit vector v so that x - 2 v (v.x) has zeros behind its first entry."""
    norm = np.linalg.norm(x)
    if norm == 0 or not np.any(x[1:]):
        return None
    v = x / norm
    v[0] += np.copysign(1.0, v[0])
    return v / np.linalg.norm(v)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of ``matrix = U B V'``."""
    m = matrix.astype(np.float64).copy()
    n = m.shape[1]
    right = np.eye(n)
    for k in range(n):
        v = _reflector(m[k:, k].copy())
        if v is not None:
            m[k:, k:] -= 2.0 * np.outer(v, v @ m[k:, k:])
        if k < n - 2:
            v = _reflector(m[k, k + 1 :].copy())
            if v is not None:
                m[k:, k + 1 :] -= 2.0 * np.outer(m[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2.0 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), right


#: A square this small beside the largest one is far below any rounding; it stands for zero.
NOTHING = 1e-40


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform and its least remainder; None if the shift is beyond the least value."""
    out_q, out_e = [], []
    d = q[0] - shift
    least = d
    for i in range(len(q) - 1):
        if d < 0:
            return None
        whole = d + e[i]
        if whole == 0:
            return None
        t = q[i + 1] / whole
        out_q.append(whole)
        out_e.append(e[i] * t)
        d = d * t - shift
        least = min(least, d)
    return None if d < 0 else ([*out_q, d], out_e, least)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    scale = float(max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    work = [(np.maximum((diagonal / scale) ** 2, NOTHING).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    while work:
        q, e, total = work.pop()
        shift, rounds = 0.0, 0
        while q:
            if len(q) == 1:
                found.append(q[0] + total)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (total + q[i + 1]) or e[i] <= NOTHING * EPS), None)
            if cut == len(e) - 1:
                found.append(q.pop() + total)
                e.pop()
                shift = 0.0
                continue
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], total))
                q, e, shift = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if rounds % 50 == 0 and q[-1] > 4 * q[0]:
                # Small values come out at the end: the end with the large ones goes first.
                q, e = q[::-1], e[::-1]
            while (moved := _step(q, e, shift)) is None:
                shift = shift * 0.25 if shift > NOTHING else 0.0
                if not shift and any(x <= 0 for x in q):
                    q = [max(x, NOTHING) for x in q]
            total += shift
            q, e, least = moved
            q = [max(x, NOTHING * EPS) for x in q]
            # The least remainder is a bound from above, and near the least value once the last off-diagonal is small.
            shift = max(0.0, least - e[-1]) * 0.98 if rounds else 0.0
            rounds += 1
            if rounds > 200 * (len(q) + 10):
                raise ArithmeticError("dqds does not converge")
    out = np.sort(np.array(found))[::-1] * scale * scale
    return np.where(out <= 4 * NOTHING * scale * scale, 0.0, out)


class Representation:
    """LDL' of a symmetric tridiagonal matrix less a shift."""

    def __init__(self, d: np.ndarray, l: np.ndarray):  # noqa: E741
        self.d, self.l = d, l
        self.floor = EPS * EPS * max(float(np.abs(d).max()), TINY)

    def _safe(self, x: float) -> float:
        return x if abs(x) > self.floor else (-self.floor if x < 0 else self.floor)

    def top_down(self, value: float):
        n = len(self.d)
        d, l, s = np.empty(n), np.empty(n - 1), np.empty(n)  # noqa: E741
        s[0] = -value
        for i in range(n - 1):
            d[i] = self._safe(s[i] + self.d[i])
            l[i] = self.d[i] * self.l[i] / d[i]
            s[i + 1] = l[i] * self.l[i] * s[i] - value
        d[-1] = self._safe(s[-1] + self.d[-1])
        return d, l, s

    def below(self, value: float) -> int:
        """How many values are less."""
        return int((self.top_down(value)[0] < 0).sum())

    def refined(self, rank: int, guess: float) -> float:
        """The value with ``rank`` smaller ones, by bisection around a guess."""
        wide = max(abs(guess) * 1e-10, self.floor)
        low, high = guess - wide, guess + wide
        while self.below(low) > rank:
            wide *= 8
            low -= wide
        while self.below(high) <= rank:
            wide *= 8
            high += wide
        while high - low > 2 * EPS * max(abs(low), abs(high)) and high - low > self.floor:
            middle = 0.5 * (low + high)
            if middle in (low, high):
                break
            if self.below(middle) > rank:
                high = middle
            else:
                low = middle
        return 0.5 * (low + high)

    def vector(self, value: float) -> np.ndarray:
        n = len(self.d)
        _, down, s = self.top_down(value)
        up, p = np.empty(n - 1), np.empty(n)
        p[-1] = self.d[-1] - value
        for i in range(n - 2, -1, -1):
            pivot = self._safe(self.d[i] * self.l[i] ** 2 + p[i + 1])
            t = self.d[i] / pivot
            up[i] = self.l[i] * t
            p[i] = p[i + 1] * t - value
        twist = int(np.argmin(np.abs(s + p + value)))
        z = np.zeros(n)
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(twist, n - 1):
            z[i + 1] = -up[i] * z[i]
        return z / np.linalg.norm(z)

    def vectors(self, ranks: list[int], values: list[float], depth: int = 0) -> list[np.ndarray]:
        """Vectors of values (rising, with their ranks in the whole matrix)."""
        values = [self.refined(r, v) for r, v in zip(ranks, values)]
        out: list[np.ndarray] = []
        low = 0
        while low < len(values):
            high = low + 1
            while high < len(values) and values[high] - values[high - 1] <= APART * max(abs(values[high]), abs(values[high - 1])):
                high += 1
            if high == low + 1 or depth == DEEPEST:
                out += [self.vector(v) for v in values[low:high]]
            else:
                spread = values[high - 1] - values[low]
                shift = values[low] - max(spread, 4 * EPS * abs(values[low]))
                d, l, _ = self.top_down(shift)  # noqa: E741
                out += Representation(d, l).vectors(ranks[low:high], [v - shift for v in values[low:high]], depth + 1)
            low = high
        return out


def _block_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Vectors of the ``wanted`` largest values of one unreduced block (values falling)."""
    n = len(a)
    if n == 1:
        return [np.ones(1)]
    scale = max(np.abs(a).max(), np.abs(b).max())
    a = np.where(np.abs(a) < EPS * scale, EPS * scale, a)
    more = wanted
    while more < n and values[more - 1] - values[more] <= APART * values[more - 1]:
        more += 1  # values close to the last wanted one share its cluster
    rising = values[:more][::-1]
    found = Representation(a * a, b / a[:-1]).vectors(list(range(n - more, n)), rising.tolist())[::-1]
    tri = np.zeros((n, n))
    tri[np.arange(n), np.arange(n)] = a * a + np.append(0, b * b)
    tri[np.arange(n - 1), np.arange(1, n)] = tri[np.arange(1, n), np.arange(n - 1)] = a[:-1] * b
    out: list[np.ndarray] = []
    for k, z in enumerate(found):
        start = 0
        for attempt in range(4):
            rest = z.copy()
            for _ in range(2):
                for other in out:
                    rest -= (other @ rest) * other
            size = np.linalg.norm(rest)
            if size > 0.5 or attempt == 3:
                break
            # Values that no shift tells apart: any vector of their space will do.
            z = np.linalg.solve(tri - (values[k] * (1 + 4 * EPS)) * np.eye(n), rest / size if size > EPS else np.eye(n)[start])
            z, start = z / np.linalg.norm(z), start + 1
        out.append(rest / size)
    return out[:wanted]


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of ``r``, falling, and its right singular vectors of the ``k`` largest as columns."""
    a, b, v = bidiagonal(r)
    values = dqds(a, b)
    n = len(a)
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    edges = [0, *(np.flatnonzero(np.abs(b) <= EPS * scale) + 1).tolist(), n]
    candidates: list[tuple[float, np.ndarray]] = []
    for low, high in zip(edges, edges[1:]):
        own = dqds(a[low:high], b[low : high - 1])
        for value, z in zip(own, _block_vectors(a[low:high], b[low : high - 1], own, min(k, high - low))):
            whole = np.zeros(n)
            whole[low:high] = z
            candidates.append((float(value), whole))
    candidates.sort(key=lambda c: -c[0])
    vectors = np.stack([v @ z for _, z in candidates[:k]], axis=1) if candidates else np.zeros((n, 0))
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1.0, signs)
