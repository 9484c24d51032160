"""Vector code compression: product codes by k-means with norm-of-sum bounds.

A vector on the grid is cut into equal consecutive parts. Each part position has a
codebook that starts as that part of the vectors with the smallest ids; ``rounds``
times every part is assigned to the nearest entry (squared Euclidean distance,
ties to the lower index) and entries move to the rounded-down mean of their parts.
All of it is whole-number arithmetic, so the result does not depend on how rows
are spread over tasks.

**Norm-of-sum bounds.** Entries of a codebook are split into groups. For each row,
part and group the state keeps a lower bound: the least distance to an entry of the
group other than the assigned one, when it was last computed, and the *stamp* of
that round. The history of codebooks is kept too. An entry that stood at ``c(s)``
in the stamp's round and stands at ``c(t)`` now has moved by ``|c(t) - c(s)|``, its
true net displacement, so the bound now is the old one less the greatest net
displacement in the group. Sums of the drifts of single rounds, the usual bound,
are never smaller and grow when an entry moves to and fro. The distance to the
assigned entry is computed exactly each round; only groups whose bound does not
exceed it are scanned exactly, entry by entry.

**As a job.** A round is two passes of the state table in the shared folder: one
assigns and writes the next state, one sums parts by entry (once per task, then by
Spark). Only codebooks pass through the driver: parts x entries x width numbers,
whatever the corpus; the history that is broadcast is ``rounds + 1`` times that.
A state is dropped when the next is written.

Cases: rows with a null vector, or a null, NaN or infinite component, are dropped.
Shorter vectors are filled with zeros, up to a multiple of the number of parts. With
fewer kept rows than entries a codebook has as many entries as rows. Null ids sort
last; rows that share an id are ordered by vector. Unused entries stay. Null labels
are one label. Whole numbers from 2^27 up would not leave a distance in a long, and
raise an error. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm import grids as G
from lectern.session import dropped, kept

SCALE = 1024
LIMIT = 1 << 27
#: Below this, sums of products of whole numbers are exact in doubles.
EXACT_IN_DOUBLES = 1 << 21
GROUPS = 16
SLACK = 1e-6
SALTS = 16
ROWS = 4096


def grouped(codebook: np.ndarray, groups: int) -> list[np.ndarray]:
    """Entries in groups of near ones, by halving along the widest dimension; indexes ascend in a group."""
    parts = [np.arange(len(codebook))]
    while len(parts) < groups and max(map(len, parts)) > 1:
        whole = max(range(len(parts)), key=lambda k: len(parts[k]))
        own = parts.pop(whole)
        points = codebook[own]
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if points.shape[1] else 0
        order = np.argsort(points[:, axis], kind="stable") if points.shape[1] else np.arange(len(own))
        half = len(own) // 2
        parts += [own[order[:half]], own[order[half:]]]
    return [np.sort(p) for p in sorted(parts, key=lambda p: int(p.min()))]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    if x.size == 0 or max(int(np.abs(x).max()), int(np.abs(entries).max(initial=0))) < EXACT_IN_DOUBLES:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        step = x - entry
        out[:, k] = (step * step).sum(axis=1)
    return out


def net_moves(history: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
    """For each past round and group: the greatest distance of an entry's place now from its place then."""
    now = history[-1].astype(np.float64)
    out = np.zeros((len(history), len(groups)))
    for s, then in enumerate(history):
        moved = np.sqrt(((now - then) ** 2).sum(axis=1))
        out[s] = [moved[g].max() for g in groups]
    return out * (1 + 1e-12)


class Part:
    """The codebook history of one part position."""

    def __init__(self, history: list[np.ndarray], groups: list[np.ndarray]):
        self.history, self.groups = history, groups
        self.now, self.stamp = history[-1], len(history) - 1
        self.group_of = np.zeros(len(self.now), np.int64)
        for g, own in enumerate(groups):
            self.group_of[own] = g
        self.moves = net_moves(history, groups)

    def assign(self, x: np.ndarray, code: np.ndarray | None, bound: np.ndarray, stamp: np.ndarray):
        """Nearest entry and exact squared distance of each row, and how many distances that took; bounds change in place."""
        n = len(x)
        if code is None:
            code, best, taken = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
            scan = np.ones((n, len(self.groups)), bool)
        else:
            code = code.astype(np.int64)
            step = x - self.now[code]
            best, taken = (step * step).sum(axis=1), np.ones(n, np.int64)
            left = bound - np.take_along_axis(self.moves, stamp.astype(np.int64), axis=0)
            scan = left <= (np.sqrt(best.astype(np.float64)) * (1 + SLACK) + SLACK)[:, None]
            # The bound of the assigned entry's group does not hold for that entry once another is assigned.
            scan[np.arange(n), self.group_of[code]] |= scan.any(axis=1)
        least, next_least = np.zeros(bound.shape, np.int64), np.zeros(bound.shape, np.int64)
        for g, own in enumerate(self.groups):
            rows = np.flatnonzero(scan[:, g])
            if not len(rows):
                continue
            taken[rows] += len(own)
            found = squared(x[rows], self.now[own])
            near = np.argmin(found, axis=1)
            value = found[np.arange(len(rows)), near]
            least[rows, g] = value
            found[np.arange(len(rows)), near] = np.iinfo(np.int64).max
            next_least[rows, g] = found.min(axis=1)
            entry = own[near]
            better = (value < best[rows]) | ((value == best[rows]) & (entry < code[rows]))
            best[rows[better]], code[rows[better]] = value[better], entry[better]
        mine = np.zeros(scan.shape, bool)
        mine[np.arange(n), self.group_of[code]] = True
        exact = np.sqrt(np.where(mine, next_least, least).astype(np.float64))
        bound[scan] = np.nextafter(exact[scan].astype(np.float32), np.float32(0))
        stamp[scan] = self.stamp
        return code, best, taken


STATE = "vec_id long, label {label}, x array<int>, code binary, bound binary, stamp binary, error long, distances long"


def _assigned(state: DataFrame, parts: list[Part], width: int, label: str) -> DataFrame:
    """The next state: codes, bounds and stamps under the newest codebooks."""
    shared = state.sparkSession.sparkContext.broadcast(parts)
    first = "code" not in state.columns

    def run(batches):
        own = shared.value
        part_width = width // len(own)
        n_groups = len(own[0].groups)
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                n = batch.num_rows
                x = G.matrix(batch.column("x"), width).astype(np.int64)
                if first:
                    codes = None
                    bounds, stamps = np.zeros((n, len(own) * n_groups), np.float32), np.zeros((n, len(own) * n_groups), np.uint8)
                else:
                    codes = G.unpacked(batch.column("code"), np.uint8, len(own))
                    bounds = G.unpacked(batch.column("bound"), np.float32, len(own) * n_groups).copy()
                    stamps = G.unpacked(batch.column("stamp"), np.uint8, len(own) * n_groups).copy()
                found = np.zeros((n, len(own)), np.uint8)
                error, taken = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if not first:
                    taken += batch.column("distances").to_numpy()
                for p, part in enumerate(own):
                    at = slice(p * n_groups, (p + 1) * n_groups)
                    bound, stamp = np.ascontiguousarray(bounds[:, at]), np.ascontiguousarray(stamps[:, at])
                    code, best, more = part.assign(x[:, p * part_width : (p + 1) * part_width], None if first else codes[:, p], bound, stamp)
                    bounds[:, at], stamps[:, at] = bound, stamp
                    found[:, p] = code
                    error += best
                    taken += more
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"), batch.column("label"), batch.column("x"), G.packed(found), G.packed(bounds), G.packed(stamps),
                        pa.array(error), pa.array(taken),
                    ],
                    ["vec_id", "label", "x", "code", "bound", "stamp", "error", "distances"],
                )

    return state.mapInArrow(run, STATE.format(label=label))


def _sums(state: DataFrame, n_parts: int, width: int) -> pa.Table:
    """part, entry, dimension, total and count of each used entry, at most one row a task before the shuffle."""

    def run(batches):
        part_width = width // n_parts
        total, count = np.zeros((n_parts, 256, part_width), np.int64), np.zeros((n_parts, 256), np.int64)
        for batch in batches:
            x = G.matrix(batch.column("x"), width).astype(np.int64)
            codes = G.unpacked(batch.column("code"), np.uint8, n_parts)
            for p in range(n_parts):
                np.add.at(total[p], codes[:, p], x[:, p * part_width : (p + 1) * part_width])
                count[p] += np.bincount(codes[:, p], minlength=256)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
                pa.array(list(total[part, entry]), pa.list_(pa.int64())),
            ],
            ["part", "entry", "rows", "total"],
        )

    partial = state.select("x", "code").mapInArrow(run, "part int, entry int, rows long, total array<long>")
    each = partial.select("part", "entry", "rows", F.posexplode("total").alias("at", "value"))
    return each.groupBy("part", "entry", "at").agg(F.sum("value").alias("total"), F.sum("rows").alias("rows")).toArrow()


def moved(codebooks: list[np.ndarray], sums: pa.Table) -> list[np.ndarray]:
    """Entries at the rounded-down means of their parts; unused ones stay."""
    out = [c.copy() for c in codebooks]
    for part, entry, at, total, rows in zip(*(sums.column(c).to_pylist() for c in ("part", "entry", "at", "total", "rows"))):
        out[part][entry, at] = total // rows
    return out


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def fit(points: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame | None, list[np.ndarray]]:
    """The last state (None for an empty table) and the final codebooks, for points ``vec_id, label, x``."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    label = dict(points.dtypes)["label"]
    state = kept(points.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("x").cast("array<int>").alias("x")), "code-points")
    start = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    if not start.num_rows:
        return None, []
    first = np.array(start.column("x").to_pylist(), np.int64).reshape(start.num_rows, width)
    step = width // parts
    history = [[first[:, p * step : (p + 1) * step]] for p in range(parts)]
    groups = [grouped(h[0], min(GROUPS, len(first))) for h in history]
    for number in range(rounds + 1):
        books = [Part(h, g) for h, g in zip(history, groups)]
        new = kept(_assigned(B.modest(state), books, width, label), "code-state")
        dropped(state)
        state = new
        if number < rounds:
            for h, book in zip(history, moved([h[-1] for h in history], _sums(state, parts, width))):
                h.append(book)
    return state, [h[-1] for h in history]


def compress(table: DataFrame, vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and distances (exact ones computed, of parts x entries x (rounds + 1))."""
    points, width = G.on_grid(table, vector, ["vec_id", "label"], SCALE, LIMIT, parts)
    state, codebooks = fit(points, width, parts, entries, rounds)
    if state is None:
        return points.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), F.lit(0).cast("long").alias("distances"),
        ).limit(0)
    # One row a label, kept so that its size is known; a label with a third of the rows is dealt out by salt.
    labels = kept(state.groupBy("label").agg(F.sum("error").alias("label_error")), "code-labels")
    salted = labels.select(F.col("label").alias("own"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = state.withColumn("at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col("at") == F.col("salt")) & F.col("label").eqNullSafe(F.col("own"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"), "distances"
    )


def decode(codes: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id and the vector that a hex ``code`` stands for, off the grid by half a step."""
    table = F.array(*[F.array(*[F.array(*[F.lit((float(v) + 0.5) / SCALE) for v in row]) for row in c.tolist()]) for c in codebooks])
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.select("vec_id", F.flatten(F.array(*[F.get(F.get(table, F.lit(p)), entry(p)) for p in range(len(codebooks))])).alias("vector"))
