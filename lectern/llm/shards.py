"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of doc_id (then text checksum and size). A
keyed permutation of 0 .. n-1 gives each number a new place: ``shard`` is the place
modulo the shard count, ``slot`` the quotient. Both can be computed from the row
number, n and the seed alone, and the other way round. Shards' row counts differ
by one at most (law ``rows``), and slots have no gap.

The network runs on pairs (left, right) of Z_a x Z_b with a = ceil(sqrt n) and
b = ceil(n / a): in turn, left takes a function of right and right one of left. The
domain a*b exceeds n by less than a; a place beyond n is sent through the network
again until it falls below n. A walk stays outside 0 .. n-1 until it ends, so it
never takes more than a*b - n + 1 steps.

Only DataFrame functions are used. Texts are reduced to size and checksum in the
scan and never shuffled. Rows are numbered by a range partitioning on the key and
a random salt (so rows that share a doc_id are spread too), the rows per partition,
and their running sum: one row per partition, the only thing that is broadcast.

Cases: a null text has size 1 and checksum 0, a null doc_id sorts first. Rows
equal in doc_id, checksum and size get neighbouring numbers; which of the equal
rows gets which cannot be told from the result. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import kept

PRIME = 2_147_483_647
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multiplier, summand and second multiplier of each round, below the prime."""
    keys, state = [], (seed * 48_271 + 11) % PRIME
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            state = (state * 48_271 + 12_345) % PRIME
            row.append(max(1, state))
        keys.append(tuple(row))
    return keys


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(number: int, n: int, seed: int) -> int:
    """The same permutation for one number, to look up a row's shard and slot."""
    a, b = domain(n)
    while True:
        left, right = number % a, number // a
        for k, (m, c, m2) in enumerate(round_keys(seed)):
            x = right if k % 2 == 0 else left
            t = (x * m + c) % PRIME
            t = ((t ^ (t >> 15)) * m2) % PRIME
            if k % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        number = right * a + left
        if number < n:
            return number


def network(number: Column, n: int, seed: int) -> Column:
    """One pass of the network as a column."""
    a, b = domain(n)
    keys = F.array(*[
        F.struct(F.lit(k % 2 == 0).alias("even"), F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c"), F.lit(m2).cast("long").alias("m2"))
        for k, (m, c, m2) in enumerate(round_keys(seed))
    ])

    def turn(state: Column, key: Column) -> Column:
        seen = F.when(key["even"], state["right"]).otherwise(state["left"])
        t = (seen * key["m"] + key["c"]) % PRIME
        # transform over one element names the value, so it is computed once
        added = F.transform(F.array(t), lambda x: (x.bitwiseXOR(F.shiftright(x, 15)) * key["m2"]) % PRIME)[0]
        return F.transform(
            F.array(added),
            lambda x: F.struct(
                F.when(key["even"], (state["left"] + x) % a).otherwise(state["left"]).alias("left"),
                F.when(key["even"], state["right"]).otherwise((state["right"] + x) % b).alias("right"),
            ),
        )[0]

    start = F.struct((number % a).alias("left"), F.floor(number / a).cast("long").alias("right"))
    return F.aggregate(keys, start, turn, lambda s: s["right"] * a + s["left"])


def place(number: Column, n: int, seed: int) -> Column:
    """Cycle walking: the network again while the place is not below n."""
    a, b = domain(n)
    once = network(number, n, seed)
    steps = a * b - n
    if not steps:
        return once
    # A walk's length has a geometric tail of ratio steps / (a * b); 64 steps leave less than 1e-38.
    return F.aggregate(
        F.array_repeat(F.lit(0), min(steps, 64)),
        once,
        lambda at, _: F.when(at < n, at).otherwise(network(at, n, seed)),
    )


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size and text_crc32 with ``number`` from 0 in their order, and the row count."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.rand(7).alias("salt"),
    )
    order = ["doc_id", "text_crc32", "size", "salt"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    # The id holds the partition above bit 33 and the row's place in it below.
    ranged = kept(ranged.withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    ranged = ranged.withColumn("part", F.shiftright("at", 33)).withColumn("inner", F.col("at").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    starts = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base"))
    whole = ranged.join(F.broadcast(starts), "part")
    return whole.select("doc_id", "size", "text_crc32", (F.col("base") + F.col("inner")).alias("number")), ranged.count()


def shard(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under law ``rows``)."""
    rows, n = numbered(docs)
    return rows.withColumn("place", place(F.col("number"), n, seed)).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
