"""Stored vector lists: an approximate index, built once, searched and extended.

Three tables in one folder:

* ``cells``: the first level, about n^(1/4) centres (cell, centre, lists);
* ``centres``: the second level, about √n centres (cell, list_id, centre);
* ``vectors``: item_id and vector, in a folder for each ``list_id``.

Only the first level travels with a task: 178 centres for 10^9 vectors, half a
megabyte. Vectors and queries meet the second level in blocks of bounded size that
share a cell, so a cell with a third of all rows is spread over many tasks.

Centres are fitted on a sample: the rows with the smallest hashes of their ids, at most
``SAMPLE`` for each list and ``MAX_SAMPLE`` in all, of which the first level takes
``SAMPLE`` for each cell, and the second ``CELL_SAMPLE`` in a cell. Every vector is then put into the list of its nearest centre; vectors that come
later need no new fit.

Rows without a vector are left out. Equal vectors always share a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import vectors as V
from lectern.operators.ranking import top_per_group
from lectern.session import dropped, kept, scratch_path

SAMPLE = 64
MAX_SAMPLE = 1_000_000
CELL_SAMPLE = 20_000
ROUNDS = 10
#: Rows of a cell, and of a file of a list, that one task takes.
BLOCK = 65_536
#: Lists of a cell are numbered from cell * CELL_LISTS.
CELL_LISTS = 1 << 16


@dataclass(frozen=True)
class Lists:
    folder: str
    cells: DataFrame
    centres: DataFrame
    vectors: DataFrame


def open_lists(spark: SparkSession, folder: str) -> Lists:
    """The index as it is stored now; after an append it is opened anew."""
    return Lists(folder, *(spark.read.parquet(f"{folder}/{name}") for name in ("cells", "centres", "vectors")))


# ---- fit --------------------------------------------------------------------
def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2.0 * (points @ centres.T), axis=1)


def fit_centres(points: np.ndarray, wanted: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``wanted`` centres of bounded points; the start is drawn from distinct ones with a fixed seed."""
    distinct = np.unique(points, axis=0)
    wanted = min(wanted, len(distinct))
    centres = distinct[np.sort(np.random.default_rng(7).choice(len(distinct), wanted, replace=False))]
    for _ in range(rounds):
        own = _nearest(points, centres)
        order = np.argsort(own, kind="stable")
        used, starts = np.unique(own[order], return_index=True)
        means = np.add.reduceat(points[order], starts) / np.diff(np.append(starts, len(points)))[:, None]
        if np.array_equal(centres[used], means):
            break
        centres = centres.copy()
        centres[used] = means
    return centres


def _first_fit(cells: int):
    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        centres = fit_centres(_matrix(sample["vector"]), cells)
        return pd.DataFrame({"cell": np.arange(len(centres)), "centre": list(centres)})

    return fit


def _cell_fit(lists: int, rows: int):
    def fit(key, sample: pd.DataFrame) -> pd.DataFrame:
        share = max(1, round(lists * int(sample["in_cell"].iloc[0]) / rows))
        centres = fit_centres(_matrix(sample["vector"]), min(share, CELL_LISTS))
        return pd.DataFrame({"cell": key[0], "list_id": key[0] * CELL_LISTS + np.arange(len(centres)), "centre": list(centres)})

    return fit


def _cell_of(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=_nearest(_matrix(batch["vector"]), centres).astype("int32"))

    return run


def _with_cell(rows: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    named = rows.select(key, F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
    return named.mapInPandas(_cell_of(centres), f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>, cell int")


def build_lists(items: DataFrame, folder: str | None = None) -> Lists:
    """Fit ⌊√n⌋ lists for items (item_id, vector), write every item into its list and open the index."""
    spark = items.sparkSession
    folder = folder or scratch_path(spark, "lists")
    given = items.select("item_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
    rows = given.count()
    lists = max(1, int(rows**0.5))
    drawn = kept(given.orderBy(F.xxhash64("item_id"), "item_id").limit(min(SAMPLE * lists, MAX_SAMPLE)), "sample")
    if rows:
        cells = max(1, round(lists**0.5))
        few = drawn.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE * cells)
        fitted = few.withColumn("level", F.lit(0)).groupBy("level").applyInPandas(_first_fit(cells), "cell int, centre array<double>").collect()
        first = _matrix([r["centre"] for r in sorted(fitted, key=lambda r: r["cell"])])
        placed = kept(_with_cell(drawn, "item_id", first), "placed")
        by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("item_id"), "item_id")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell"))
        bounded = placed.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= CELL_SAMPLE).join(sizes, "cell")
        fitted = bounded.groupBy("cell").applyInPandas(
            _cell_fit(lists, placed.count()), "cell int, list_id int, centre array<double>"
        )
        fitted.write.parquet(f"{folder}/centres")
        dropped(placed)
    else:
        first = np.empty((0, 0))
        spark.createDataFrame([], "cell int, list_id int, centre array<double>").write.parquet(f"{folder}/centres")
    dropped(drawn)
    named = [(n, centre.tolist()) for n, centre in enumerate(first)]
    cells = spark.createDataFrame(named, "cell int, centre array<double>")
    counted = spark.read.parquet(f"{folder}/centres").groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("lists"))
    # A cell that no row of the sample fell into has no list and is never chosen.
    cells.join(counted, "cell").coalesce(1).write.parquet(f"{folder}/cells")
    _write(assigned(given, _stored_tables(spark, folder), "item_id"), folder, "overwrite")
    return open_lists(spark, folder)


def _stored_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/cells"), spark.read.parquet(f"{folder}/centres")


def _write(rows: DataFrame, folder: str, mode: str) -> None:
    # A list is written by as many tasks as it has blocks, so one of a third of all rows is not one file.
    staged = kept(rows.select("item_id", "vector", "list_id"), "listed")
    sizes = staged.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("files"))
    split = staged.join(sizes, "list_id").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("files")))
    out = split.repartition("list_id", "part").sortWithinPartitions("list_id").select("item_id", "vector", "list_id")
    out.write.mode(mode).partitionBy("list_id").parquet(f"{folder}/vectors")
    if not _folders(staged):
        # A partitioned table without rows has no file; its columns are kept by an empty one.
        rows.sparkSession.createDataFrame([], staged.select("item_id", "vector", "list_id").schema).write.mode(mode).parquet(f"{folder}/vectors")
    dropped(staged)


def _folders(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


# ---- assignment -------------------------------------------------------------
def _ordered_cells(cells: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first level: numbers, centres and how many lists each has; n^(1/4) rows."""
    rows = sorted(cells.collect(), key=lambda r: r["cell"])
    return np.array([r["cell"] for r in rows], np.int32), _matrix([r["centre"] for r in rows]), np.array([r["lists"] for r in rows])


def _met(rows: DataFrame, centres: DataFrame, key: str, match, schema: str) -> DataFrame:
    """Rows (key, vector, cell) meet the lists of their cell, block by block."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    left = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")
    right = centres.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select(F.col("cell").alias("c"), F.col("block").alias("b"), "list_id", "centre")
    return left.groupBy("cell", "block").cogroup(right.groupBy("c", "b")).applyInPandas(match, schema)


def assigned(items: DataFrame, tables: tuple[DataFrame, DataFrame], key: str = "item_id") -> DataFrame:
    """Items (key, vector, list_id) with the list of the nearest centre in the nearest cell."""
    cells, centres = tables
    name = items.schema[key].dataType.simpleString()
    schema = f"{key} {name}, vector array<double>, list_id int"
    if cells.isEmpty():
        return items.sparkSession.createDataFrame([], schema)
    numbers, first, _ = _ordered_cells(cells)
    placed = _with_cell(items, key, first)
    # Cells are numbered with gaps where one got no list.
    own = F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("cell") + 1)

    def match(rows: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        lists = lists.sort_values("list_id")
        near = _nearest(_matrix(rows["vector"]), _matrix(lists["centre"])) if len(rows) else np.empty(0, int)
        return pd.DataFrame({key: rows[key], "vector": rows["vector"], "list_id": lists["list_id"].to_numpy()[near]})

    return _met(placed.withColumn("cell", own), centres, key, match, schema)


def add_items(index: Lists, items: DataFrame) -> Lists:
    """Append new items to their lists, with the stored centres, and open the index anew.

    Only the touched lists are read, to leave out items that are there: a repeated run
    changes nothing. An id must keep its vector.
    """
    spark = items.sparkSession
    fresh = kept(assigned(items, (index.cells, index.centres)), "added")
    touched = F.broadcast(fresh.select("list_id").distinct())
    there = index.vectors.select("list_id", "item_id").join(touched, "list_id", "left_semi")
    _write(fresh.join(there, ["list_id", "item_id"], "left_anti").dropDuplicates(["item_id"]), index.folder, "append")
    dropped(fresh)
    return open_lists(spark, index.folder)


# ---- search -----------------------------------------------------------------
def _asked(queries: DataFrame) -> DataFrame:
    named = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    return named.filter("vector is not null")


def probes(index: Lists, queries: DataFrame, k: int, lists: int = 1, breadth: int = 4) -> DataFrame:
    """Lists (query_id, vector, list_id) that a query looks into.

    Of the nearest cells, taken until they have ``breadth`` times ``lists`` lists and at
    least ``k`` items, the ``lists`` nearest lists, and more until those hold ``k`` items.
    """
    asked = _asked(queries)
    wanted = ranked_lists(index, asked, k, breadth * lists).filter((F.col("place") <= lists) | (F.col("before") < k))
    return asked.join(wanted.select("query_id", "list_id"), "query_id").select("query_id", "vector", "list_id")


def ranked_lists(index: Lists, asked: DataFrame, k: int, at_least: int) -> DataFrame:
    """Lists of a query's nearest cells (query_id, list_id, items, place, before), nearest first.

    Cells are taken until they have ``at_least`` lists and ``k`` items; ``before`` counts the items of nearer lists.
    """
    schema = "query_id bigint, vector array<double>, cell int"
    sizes = index.vectors.groupBy("list_id").agg(F.count(F.lit(1)).alias("items"))
    filled = index.centres.join(sizes, "list_id")
    held = filled.groupBy("cell").agg(F.sum("items").alias("items"), F.count(F.lit(1)).cast("int").alias("lists"))
    near = index.cells.drop("lists").join(held, "cell").collect()
    if not near:
        return asked.sparkSession.createDataFrame([], "query_id bigint, list_id int, items bigint, place int, before bigint")
    near.sort(key=lambda r: r["cell"])
    numbers, first = np.array([r["cell"] for r in near], np.int32), _matrix([r["centre"] for r in near])
    items, counts = np.array([r["items"] for r in near]), np.array([r["lists"] for r in near])

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch["vector"])
            order = np.argsort((first * first).sum(axis=1)[None, :] - 2.0 * (m @ first.T), axis=1, kind="stable")
            before = lambda n: np.cumsum(n[order], axis=1) - n[order]
            taken = (before(counts) < at_least) | (before(items) < k)
            out = batch.loc[batch.index.repeat(taken.sum(axis=1))].copy()
            out["cell"] = numbers[order[taken]]
            yield out

    def match(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"query_id": [], "list_id": [], "distance": []})
        own = own.sort_values("list_id")
        m, c = _matrix(rows["vector"]), _matrix(own["centre"])
        # The best of a cell are enough, but each must be known by its distance over all cells.
        distance = (m * m).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (m @ c.T)
        return pd.DataFrame({
            "query_id": np.repeat(rows["query_id"].to_numpy(), len(own)), "list_id": np.tile(own["list_id"].to_numpy(), len(rows)),
            "distance": distance.ravel(),
        })

    pairs = _met(asked.mapInPandas(chosen, schema), filled.select("cell", "list_id", "centre"), "query_id", match, "query_id bigint, list_id int, distance double")
    nearest = Window.partitionBy("query_id").orderBy("distance", "list_id")
    return pairs.join(sizes, "list_id").select(
        "query_id", "list_id", "items", F.row_number().over(nearest).alias("place"),
        F.coalesce(F.sum("items").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )


def lists_for(index: Lists, k: int, recall: float = 0.95, asked: int = 128) -> int:
    """How many lists must be probed for a recall, from the exact neighbours of ``asked`` stored items.

    These are the items with the smallest hashes of their ids; one scan of the vectors finds the neighbours.
    """
    order = [F.xxhash64("item_id"), F.col("item_id")]
    sample = index.vectors.orderBy(*order).limit(asked).select(F.col("item_id").alias("query_id"), "vector")
    sample = kept(sample, "asked")
    # An item is its own nearest neighbour and says nothing.
    exact = V.top_similar(sample, index.vectors, k + 1).filter("query_id <> item_id").select("query_id", "item_id")
    homes = exact.join(index.vectors.select("item_id", "list_id"), "item_id")
    places = homes.join(ranked_lists(index, _asked(sample), k, 1 << 30), ["query_id", "list_id"])
    found = places.agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY place)")).first()[0]
    dropped(sample)
    return int(found or 1)


def top_in_lists(index: Lists, queries: DataFrame, k: int, lists: int = 1) -> DataFrame:
    """Best ``k`` items of the probed lists (query_id, item_id, score, rank); scores are exact.

    With as many ``lists`` as there are, the result is that of the exact search.
    """
    partial = V._block_search(probes(index, queries, k, lists), index.vectors, k, None, "list_id")
    return top_per_group(partial, ["query_id"], [F.desc("score"), F.col("item_id")], k)
