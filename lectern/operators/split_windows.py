"""Windows over groups that may be very large.

A plain window puts a whole group into one task. Here a group is cut into
ordered buckets; each bucket is a window partition of its own and only one
summary row per bucket travels through the per-group step. Results equal those
of the plain window.

``bucket`` is any expression that never decreases along the order, such as
``turn div 1024`` or a truncated timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BUCKET = "__bucket"


def _with_carry(df: DataFrame, keys: list[str], bucket: Column, summary: list[Column], carry: list[Column]) -> DataFrame:
    """Attach to every row the ``carry`` columns computed over the earlier buckets."""
    cut = df.withColumn(_BUCKET, bucket)
    per_bucket = cut.groupBy(*keys, _BUCKET).agg(*summary)
    carried = per_bucket.select(*keys, _BUCKET, *carry)
    return cut.join(carried, [*keys, _BUCKET])


def _earlier_buckets(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def _in_bucket(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys, _BUCKET).orderBy(*order)


def positions(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "position") -> DataFrame:
    """1-based place of each row in its group."""
    carried = _with_carry(
        df, keys, bucket,
        [F.count(F.lit(1)).alias("__n")],
        [F.coalesce(F.sum("__n").over(_earlier_buckets(keys)), F.lit(0)).alias("__before")],
    )
    place = F.col("__before") + F.row_number().over(_in_bucket(keys, order))
    return carried.withColumn(name, place).drop("__before", _BUCKET)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    carried = _with_carry(
        df.withColumn("__v", value), keys, bucket,
        [F.sum("__v").alias("__s")],
        [F.coalesce(F.sum("__s").over(_earlier_buckets(keys)), F.lit(0)).alias("__before")],
    )
    window = _in_bucket(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn(name, F.col("__before") + F.sum("__v").over(window)).drop("__v", "__before", _BUCKET)


def last_before(df: DataFrame, keys: list[str], order: Column, bucket: Column, values: dict[str, Column]) -> DataFrame:
    """For each row and name, the latest non-null value on an earlier row."""
    staged = df
    for name, value in values.items():
        staged = staged.withColumn(f"__v_{name}", value)
    staged = staged.withColumn("__order", order)
    summary = [
        F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col("__order"))).alias(f"__l_{n}") for n in values
    ]
    carry = [
        F.last(f"__l_{n}", ignorenulls=True).over(_earlier_buckets(keys)).alias(f"__c_{n}") for n in values
    ]
    out = _with_carry(staged, keys, bucket, summary, carry)
    window = _in_bucket(keys, [F.col("__order")]).rowsBetween(Window.unboundedPreceding, -1)
    for name in values:
        local = F.last(f"__v_{name}", ignorenulls=True).over(window)
        out = out.withColumn(name, F.coalesce(local, F.col(f"__c_{name}")))
    return out.drop("__order", _BUCKET, *[f"__{p}_{n}" for n in values for p in ("v", "c")])


def recent_rows(
    df: DataFrame, keys: list[str], position: str, count: int, row: Column, name: str, bucket_size: int = 1024
) -> DataFrame:
    """Array of the ``count`` rows before each row, oldest first.

    ``position`` numbers the rows of a group without gaps. The last ``count``
    rows of a bucket are copied into the next one, so no bucket needs another.
    """
    place = F.col(position)
    bucket = F.floor(place / bucket_size)
    near_end = (place % bucket_size) >= bucket_size - count
    homes = F.when(near_end, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    spread = df.withColumn("__row", row).withColumn(_BUCKET, F.explode(homes))
    window = _in_bucket(keys, [F.col(position)]).rowsBetween(-count, -1)
    listed = spread.withColumn(name, F.collect_list("__row").over(window))
    return listed.filter(F.col(_BUCKET) == bucket).drop("__row", _BUCKET)
