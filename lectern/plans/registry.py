"""Where queries are registered, each with its SQL check and the rows it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


PARTITIONS = "lectern.input.partitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, in the partitions of its scan.

    A session may set ``lectern.input.partitions`` where its text tables are one
    small row group each, as on a laptop: they are then dealt out to so many tasks.
    Without the setting, as on a cluster, nothing is moved. Filters and column
    pruning reach the scan either way.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    wanted = spark.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted and name in ("documents", "pages") else df


_STORED: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    """What ``build`` writes for a folder of given tables, once a Spark application.

    An index outlives the searches that read it; the tables it was built from do not change.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]
