"""Threshold join of two vector tables without all pairs.

Items lie in cells: the nearest of a few pivots, and a ring of angles around it.
Angles obey the triangle inequality, so a query's angles to the pivots bound its
angle to every item of a cell from below. Cells of near pivots are put together
until they make a bundle worth a product, and a query is sent only to the bundles
with a cell that may hold an item within the threshold; there the product is
exact. Nothing is lost with any pivots: they only decide how much is skipped.

A cell with a third of all items is a bundle of its own, cut into blocks of
bounded size, and so are the queries that reach one bundle. The driver and the
tasks hold one row a cell, ``MAX_PIVOTS * RINGS`` at most, and the pivots.

Vectors without clusters lie at nearly the same angle to every pivot: then a
threshold that is not very high skips nothing, and this costs as much as all
pairs in blocks (``multiplied`` tells).

Vectors that are null, of no length or with a component that is null or not
finite have no angle and no pair. Repeated rows give repeated pairs. Empty
tables give an empty one. Columns beyond the ids and vectors are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import vectors as V
from lectern.session import kept

MAX_PIVOTS = 1024
RINGS = 32
#: Items for each pivot, as long as there are no more than ``MAX_PIVOTS``.
PER_PIVOT = 8
#: A side is cut into so many blocks where links are counted, and into more once a block would be larger than that.
SIDE_BLOCKS = 16
WIDE_BLOCK = 1 << 14
#: Bounds (rows by cells) worked out together in a task.
_BOUNDS = 1 << 21


@dataclass(frozen=True)
class Cells:
    """Items in their cells: (cell, angle, item_id, vector), one row a cell in order of its bundle, and the unit pivots."""

    items: DataFrame
    table: pd.DataFrame
    pivots: np.ndarray


def _usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _angles(vectors, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(V._unit_rows(vectors) @ pivots.T, -1.0, 1.0))


def classes(items: DataFrame) -> DataFrame:
    """One row for each distinct vector: (item_id: the smallest, vector, copies).

    A join of a table with itself runs over these, so a vector with many copies
    makes no pair for each two of them. ``members`` says who belongs to whom.
    """
    return items.filter(F.col("vector").isNotNull()).groupBy("vector").agg(
        F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies")
    ).select("item_id", "vector", "copies")


def members(items: DataFrame) -> DataFrame:
    """(item_id, class_id, copies) of every row; a null vector has no class."""
    found = classes(items).select(F.col("item_id").alias("class_id"), "vector", "copies")
    return items.select("item_id", "vector").join(found, "vector", "left").select("item_id", "class_id", "copies")


def _chain(centres: np.ndarray) -> np.ndarray:
    """Place of each pivot on a walk that always goes on to the nearest one left."""
    near, place = centres @ centres.T, np.empty(len(centres), np.int64)
    at = 0
    for step in range(len(centres)):
        place[at] = step
        near[:, at] = -np.inf
        at = int(near[at].argmax())
    return place


def _bundled(table: pd.DataFrame, centres: np.ndarray, rows: int) -> pd.DataFrame:
    """Cells in the order of their pivots' walk, neighbours in bundles of at most ``rows`` items or one cell."""
    walk = _chain(centres)[table["cell"].to_numpy() // RINGS]
    table = table.iloc[np.lexsort((table["cell"], walk))].reset_index(drop=True)
    bundles, bundle, held = [], -1, rows
    for n in table["rows"]:
        if held + n > rows:
            bundle, held = bundle + 1, 0
        held += n
        bundles.append(bundle)
    return table.assign(bundle=np.array(bundles, np.int32))


def _wide(rows: int) -> int:
    """Rows of a block, so that what is moved grows with the rows and not with their square."""
    return max(V.QUERY_BLOCK, min(WIDE_BLOCK, -(-rows // SIDE_BLOCKS)))


def build_cells(items: DataFrame, pivots: int | None = None, bundle_rows: int | None = V.QUERY_BLOCK) -> Cells:
    """Deal the items (item_id, vector) into cells; written once in the shared folder.

    Pivots are the items with the smallest hashes of their ids: one for every
    ``PER_PIVOT`` items, and at most ``MAX_PIVOTS``. Without ``bundle_rows`` a
    bundle holds one part in ``SIDE_BLOCKS`` of the items.
    """
    usable = items.filter(_usable("vector")).select("item_id", "vector")
    count = usable.count() if pivots is None or bundle_rows is None else 0
    wanted = pivots or -(-count // PER_PIVOT)
    bundle_rows = bundle_rows or _wide(count)
    rows = usable.orderBy(F.xxhash64("item_id"), "item_id").limit(max(1, min(MAX_PIVOTS, wanted))).collect()
    if not rows:
        empty = pd.DataFrame({"cell": [], "rows": [], "low": [], "high": [], "bundle": []})
        return Cells(usable.select(F.lit(0).alias("cell"), F.lit(0.0).alias("angle"), "item_id", "vector"), empty, np.empty((0, 0)))
    centres = V._unit_rows([r["vector"] for r in rows])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), V.ITEM_BLOCK):
                part = batch.iloc[at : at + V.ITEM_BLOCK]
                angles = _angles(part["vector"], centres)
                nearest = angles.argmin(axis=1)
                angle = angles[np.arange(len(part)), nearest]
                ring = np.minimum((angle * (RINGS / np.pi)).astype(np.int32), RINGS - 1)
                yield part.assign(cell=nearest.astype(np.int32) * RINGS + ring, angle=angle)

    placed = usable.mapInPandas(place, f"cell int, angle double, {_typed(usable)}")
    stored = kept(placed, "cells")
    table = stored.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    return Cells(stored, _bundled(pd.DataFrame(table.collect(), columns=table.columns), centres, bundle_rows), centres)


def _typed(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def reached_bundles(queries: DataFrame, cells: Cells, floor: float) -> DataFrame:
    """(query_id, bundle) for every bundle that may hold an item with a cosine of ``floor`` or more."""
    cell, bundle = cells.table["cell"].to_numpy(np.int32), cells.table["bundle"].to_numpy(np.int32)
    pivot, low, high = cell // RINGS, cells.table["low"].to_numpy(), cells.table["high"].to_numpy()
    starts = np.searchsorted(bundle, np.unique(bundle))
    centres, rows = cells.pivots, max(1, _BOUNDS // max(1, len(cell)))
    # Scores are rounded before they meet the floor; the angle allows for that and for its own last bits.
    radius = float(np.arccos(np.clip(floor - 10.0 ** (1 - V.DIGITS), -1.0, 1.0))) + 1e-6

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                angles = _angles(part["vector"], centres)
                to_pivot = angles[:, pivot]
                # An item of a cell is no nearer to the query's own pivot than to its own.
                apart = (to_pivot - angles.min(axis=1, keepdims=True)) / 2.0
                np.maximum(apart, to_pivot - high, out=apart)
                np.maximum(apart, low - to_pivot, out=apart)
                row, place = np.nonzero(np.logical_or.reduceat(apart <= radius, starts, axis=1))
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "bundle": bundle[starts[place]]})

    asked = queries.filter(_usable("vector")).select("query_id", "vector")
    return asked.mapInPandas(route, "query_id bigint, bundle int")


def near_pairs(queries: DataFrame, items: DataFrame | Cells, floor: float) -> DataFrame:
    """Every (query_id, item_id, score) with a cosine of ``floor`` (over 0) or more.

    ``items`` may be cells built before.
    """

    def pairs(qids, ids, scores):
        return V._best(qids, ids, scores, None, floor)

    return _products(queries, items, floor, pairs, V._HITS)


def near_links(queries: DataFrame, items: DataFrame | Cells, floor: float) -> DataFrame:
    """(query_id, links): how many items have a cosine of ``floor`` (over 0) or more.

    Counted where the product is, so a group of near copies makes no row a pair.
    A task holds a block of either side and multiplies it in parts, so rows are moved
    once for each of the other side's few blocks.
    Queries without such an item are left out; rows that share an id count together.
    """

    def counts(qids, ids, scores):
        links = (np.round(scores, V.DIGITS) + 0.0 >= floor).sum(axis=1)
        return pd.DataFrame({"query_id": qids, "links": links.astype(np.int64)})[links > 0]

    cells = items if isinstance(items, Cells) else build_cells(items, bundle_rows=None)
    rows = _wide(queries.count())
    found = _products(queries, cells, floor, counts, "query_id bigint, links bigint", max(V.ITEM_BLOCK, rows), rows)
    return found.groupBy("query_id").agg(F.sum("links").alias("links"))


def _products(
    queries: DataFrame, items: DataFrame | Cells, floor: float, digest, schema: str,
    item_rows: int = V.ITEM_BLOCK, query_rows: int = V.QUERY_BLOCK,
) -> DataFrame:
    """What ``digest`` makes of the scores of every part of the blocks of queries and items that meet."""
    if floor <= 0:
        raise ValueError("a floor of 0 or less reaches every cell; use similar_pairs")
    cells = items if isinstance(items, Cells) else build_cells(items)
    spark = queries.sparkSession
    if cells.table.empty:
        return spark.createDataFrame([], schema)
    # Rows that share a query_id share the bundles of all of them.
    reached = kept(reached_bundles(queries, cells, floor).distinct(), "reached")
    # One row a bundle: bounded by MAX_PIVOTS * RINGS, whatever the tables hold.
    ids = queries.filter(_usable("vector")).select("query_id")
    asked = dict(reached.join(ids, "query_id").groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = cells.table.groupby("bundle")["rows"].sum()
    grid = [
        (int(c), int(b), -(-int(sizes[b]) // item_rows), -(-asked[b] // query_rows))
        for c, b in zip(cells.table["cell"], cells.table["bundle"]) if b in asked
    ]
    if not grid:
        return spark.createDataFrame([], schema)
    by_cell = spark.createDataFrame(grid, "cell int, bundle int, item_blocks int, query_blocks int")
    by_bundle = by_cell.drop("cell").distinct()
    keys = ["bundle", "item_block", "query_block"]

    def block(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        cells.items.join(F.broadcast(by_cell), "cell")
        .withColumn("item_block", block("item_id", "item_blocks")).withColumn("query_block", every("query_blocks"))
        .select(*keys, "item_id", "vector")
    )
    right = (
        queries.filter(_usable("vector")).select("query_id", F.col("vector").alias("query_vector"))
        .join(reached, "query_id").join(F.broadcast(by_bundle), "bundle")
        .withColumn("query_block", block("query_id", "query_blocks")).withColumn("item_block", every("item_blocks"))
        .select(*[F.col(c).alias(c) for c in keys], "query_id", "query_vector")
    )

    def multiply(item_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if item_rows.empty or query_rows.empty:
            return digest(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 0)))
        asked, given = V._unit_rows(query_rows["query_vector"]), V._unit_rows(item_rows["vector"])
        qids, ids = query_rows["query_id"].to_numpy(), item_rows["item_id"].to_numpy()
        return pd.concat([
            digest(qids[q : q + V.QUERY_BLOCK], ids[i : i + V.ITEM_BLOCK], asked[q : q + V.QUERY_BLOCK] @ given[i : i + V.ITEM_BLOCK].T)
            for q in range(0, len(qids), V.QUERY_BLOCK) for i in range(0, len(ids), V.ITEM_BLOCK)
        ])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(multiply, schema)


def multiplied(queries: DataFrame, cells: Cells, floor: float) -> DataFrame:
    """One row: the (query, item) pairs that a product holds (met), and all that there are (pairs)."""
    zero = F.lit(0).cast("bigint")
    if cells.table.empty:
        return queries.agg(zero.alias("met"), zero.alias("pairs"))
    sizes = [(int(b), int(n)) for b, n in cells.table.groupby("bundle")["rows"].sum().items()]
    rows = queries.sparkSession.createDataFrame(sizes, "bundle int, rows bigint")
    met = reached_bundles(queries, cells, floor).join(F.broadcast(rows), "bundle").select("rows", zero.alias("n"))
    # Both figures by one aggregation.
    asked = queries.filter(_usable("vector")).select(zero.alias("rows"), F.lit(sum(n for _, n in sizes)).cast("bigint").alias("n"))
    return met.unionByName(asked).agg(F.coalesce(F.sum("rows"), zero).alias("met"), F.coalesce(F.sum("n"), zero).alias("pairs"))
