"""Similarity over stored vectors.

Exact search never pairs rows in a join. A small, measured query set travels to
the vector scan as one matrix; otherwise both sides are cut into blocks of
bounded size that meet by equi-join keys. Each task multiplies two matrices and
keeps only its own best rows, so what is shuffled is ``k`` rows per query and
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ranking import top_per_group

BROADCAST_BYTES = 32 * 1024 * 1024
ITEM_BLOCK = 4096
QUERY_BLOCK = 1024
#: Equal vectors may differ in the last bits of a product; they must tie.
DIGITS = 12
_HITS = "query_id bigint, item_id bigint, score double"


# ---- column form, for pairs that a plan already has -------------------------
def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when a vector has no length."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))


def vector_checks(vectors: DataFrame, vector: str, declared: int) -> DataFrame:
    """Numeric, dimension and unit-length checks per vector."""
    v = F.col(vector)
    return vectors.withColumns(
        {
            "numeric": F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)),
            "dimension_ok": F.size(v) == declared,
            "unit_norm": F.abs(F.sqrt(_dot(v, v)) - 1.0) < 1e-3,
        }
    )


# ---- blocks -----------------------------------------------------------------
def _unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _best(qids, ids, scores, k: int | None, floor: float | None) -> pd.DataFrame:
    """Best ``k`` per row of ``scores`` (ties by id), or all at or above ``floor``."""
    scores = np.round(scores, DIGITS) + 0.0
    if floor is not None:
        keep = scores >= floor
    elif scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep = scores >= cut[:, None]
    else:
        keep = np.ones(scores.shape, dtype=bool)
    rows, cols = np.nonzero(keep)
    values, names = scores[rows, cols], ids[cols]
    if k is not None:
        order = np.lexsort((names, -values, rows))
        rows, values, names = rows[order], values[order], names[order]
        starts = np.searchsorted(rows, rows, side="left")
        first = np.arange(len(rows)) - starts < k
        rows, values, names = rows[first], values[first], names[first]
    return pd.DataFrame({"query_id": qids[rows], "item_id": names, "score": values})


def _scan(qids: np.ndarray, queries: np.ndarray, k: int | None, floor: float | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple[np.ndarray, np.ndarray]] = [
            (np.empty((min(QUERY_BLOCK, len(qids) - at), 0)), np.empty((min(QUERY_BLOCK, len(qids) - at), 0), np.int64))
            for at in range(0, len(qids), QUERY_BLOCK)
        ]
        for batch in batches:
            for low in range(0, len(batch), ITEM_BLOCK):
                part = batch.iloc[low : low + ITEM_BLOCK]
                items, ids = _unit_rows(part["vector"]).T, part["item_id"].to_numpy()
                for n, at in enumerate(range(0, len(qids), QUERY_BLOCK)):
                    scores = queries[at : at + QUERY_BLOCK] @ items
                    if k is None:
                        yield _best(qids[at : at + QUERY_BLOCK], ids, scores, None, floor)
                    else:
                        best[n] = _kept_best(*best[n], np.round(scores, DIGITS) + 0.0, ids, k)
        if k is not None:
            for n, at in enumerate(range(0, len(qids), QUERY_BLOCK)):
                scores, ids = best[n]
                rows = np.repeat(qids[at : at + QUERY_BLOCK], scores.shape[1])
                yield pd.DataFrame({"query_id": rows, "item_id": ids.ravel(), "score": scores.ravel()})

    return run


def _kept_best(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, names: np.ndarray, k: int):
    """The best ``k`` columns of each row (ties by id) of what is kept and what is new."""
    if more.shape[1] > k:
        # A column under a row's k-th best of the new ones cannot stay; the others come in order.
        order = np.lexsort((np.broadcast_to(names, more.shape), -more), axis=1)[:, :k] if more.shape[1] <= 4 * k else _top(more, names, k)
        more, names = np.take_along_axis(more, order, 1), names[order]
    else:
        names = np.broadcast_to(names, more.shape)
    both, both_ids = np.concatenate([scores, more], axis=1), np.concatenate([ids, names], axis=1)
    order = np.lexsort((both_ids, -both), axis=1)[:, :k]
    return np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)


def _top(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of the best ``k`` of each row, with the smallest ids among those equal to the k-th."""
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    # Everything over the cut goes first, then the cut's equals by id; the rest never. Ids stay whole numbers.
    kind = np.where(scores > cut, 0, np.where(scores == cut, 1, 2))
    place = np.empty(len(names), np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))
    return np.argpartition(kind * len(names) + place, k - 1, axis=1)[:, :k]


def _scan_search(queries: DataFrame, items: DataFrame, k: int | None, floor: float | None, rows) -> DataFrame:
    qids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    matrix = _unit_rows([r["vector"] for r in rows])
    return items.select("item_id", "vector").mapInPandas(_scan(qids, matrix, k, floor), _HITS)


def _blocks_for(rows: Column, size: int) -> Column:
    return F.ceil(rows / size).cast("int")


def _block_search(
    queries: DataFrame, items: DataFrame, k: int | None, floor: float | None, group: str | None
) -> DataFrame:
    """Both sides in blocks; a large group is spread over many blocks."""
    if group is None:
        # One group: its block counts are two numbers, no join is needed for them.
        grid = {
            "item_blocks": _blocks_for(F.lit(max(1, items.count())), ITEM_BLOCK),
            "query_blocks": _blocks_for(F.lit(max(1, queries.count())), QUERY_BLOCK),
        }
        items, queries = items.withColumns(grid), queries.withColumns(grid)
        keys = ["item_block", "query_block"]
    else:
        rows = F.count(F.lit(1))
        sizes = items.groupBy(group).agg(_blocks_for(rows, ITEM_BLOCK).alias("item_blocks"))
        asked = queries.groupBy(group).agg(_blocks_for(rows, QUERY_BLOCK).alias("query_blocks"))
        # One row per group on this side; the other side may be split where it is skewed.
        grid = sizes.join(asked, group)
        items, queries = items.join(grid, group), queries.join(grid, group)
        keys = [group, "item_block", "query_block"]

    def block(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        items.withColumn("item_block", block("item_id", "item_blocks"))
        .withColumn("query_block", every("query_blocks"))
        .select(*keys, "item_id", "vector")
    )
    right = (
        queries.withColumn("query_block", block("query_id", "query_blocks"))
        .withColumn("item_block", every("item_blocks"))
        # Both sides may come from one table; fresh keys tell them apart.
        .select(*[F.col(c).alias(c) for c in keys], "query_id", F.col("vector").alias("query_vector"))
    )

    def multiply(item_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if item_rows.empty or query_rows.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        scores = _unit_rows(query_rows["query_vector"]) @ _unit_rows(item_rows["vector"]).T
        return _best(query_rows["query_id"].to_numpy(), item_rows["item_id"].to_numpy(), scores, k, floor)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(multiply, _HITS)


def _search(queries: DataFrame, items: DataFrame, k: int | None, floor: float | None, group: str | None, broadcast_bytes: int):
    if group is None:
        probe = queries.select("query_id", "vector").limit(1).collect()
        if not probe:
            return items.sparkSession.createDataFrame([], _HITS)
        fits = broadcast_bytes // (8 * max(1, len(probe[0]["vector"])))
        # At most one row more than fits is fetched; that row decides the way.
        rows = queries.select("query_id", "vector").limit(fits + 1).collect()
        if len(rows) <= fits:
            return _scan_search(queries, items, k, floor, rows)
        if k is None and floor > 0:
            from lectern.operators.pivots import near_pairs

            return near_pairs(queries, items, floor)
    return _block_search(queries, items, k, floor, group)


def top_similar(
    queries: DataFrame, items: DataFrame, k: int, group: str | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Best ``k`` items per query (query_id, item_id, score, rank).

    ``queries`` has query_id and vector, ``items`` item_id and vector. With
    ``group`` a query sees only the items of its own group.
    """
    partial = _search(queries, items, k, None, group, broadcast_bytes)
    return top_per_group(partial, ["query_id"], [F.desc("score"), F.col("item_id")], k)


def similar_pairs(
    queries: DataFrame, items: DataFrame, floor: float, group: str | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every (query_id, item_id, score) with a score of ``floor`` or more."""
    return _search(queries, items, None, floor, group, broadcast_bytes)
