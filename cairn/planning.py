"""Decisions that depend on sizes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Estimated bytes up to which a side is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, measured: DataFrame, strings: tuple[str, ...] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if ``measured``, which bounds its rows, is small.

    The size is 96 bytes a row and the bytes of the string columns named, both
    counted. Beyond ``limit`` no hint is given and the join shuffles.
    """
    size = F.count("*") * 96
    for c in strings:
        size = size + F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    return F.broadcast(df) if measured.agg(size.alias("b")).first().b <= limit else df


def row_hash(*cols: Column) -> Column:
    """A 64-bit hash in which nulls count: xxhash64 alone passes over them."""
    nulls = F.lit("")
    for c in cols:
        nulls = F.concat(nulls, F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")))
    return F.xxhash64(*cols, nulls)


def row_order(loaded_at: Column, tie: Column) -> Column:
    """One number that orders rows by time of arrival and, at equal times, by a hash.

    A decimal fits the buffer of a hash aggregate, so ``max_by`` over it combines
    before the shuffle; a struct would force a sort.
    """
    at = F.coalesce(F.unix_micros(loaded_at.cast("timestamp")), F.lit(0)).cast("decimal(17,0)")
    return (at * F.lit(str(2**64)).cast("decimal(20,0)") + tie.cast("decimal(20,0)")).cast("decimal(38,0)")


#: Most keys that can be found hot at once, and entries of the sketch for each.
HOT_KEYS, SKETCH = 50_000, 16
#: Sketches that meet in one task at the end.
SKETCHES = 64


def hot_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """(key, _pieces) of the keys of ``df`` that have more than ``most`` rows: into how many pieces of that size to cut each.

    One scan of the key, kept in frequency sketches that are merged in two steps.
    Four keys for each shuffle partition can come out: none of more than ``most``
    rows, nor of more than a quarter of a partition's share, is missed, and a key
    is cut once too often at worst. So few rows can be broadcast.
    """
    keys = min(HOT_KEYS, max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    size = keys * SKETCH
    some = df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias(key))  # a sketch of nothing can't be merged
    parts = df.select(key).union(some).groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES))).agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate({key}, {size})").alias("s"))
    got = parts.agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {size}), {keys})").alias("top")).first()
    least = max(most, got.n // keys)
    hot = [(int(x["item"]), -(-int(x["count"]) // most)) for x in got.top if x["item"] is not None and x["count"] > least]
    rows = F.from_json(F.lit(json.dumps([{key: k, "_pieces": n} for k, n in hot])), f"array<struct<{key}: bigint, _pieces: int>>")
    return df.sparkSession.range(1).select(F.inline(rows))


#: Rows of one key that a task gathers as they are.
GATHERED_ROWS = 1_000_000


def hot_groups(df: DataFrame, *keys: str, most: int = GATHERED_ROWS) -> DataFrame:
    """hot_keys of groups: (_k, _pieces), _k being the hash of the key columns."""
    return hot_keys(df.select(F.xxhash64(*keys).alias("_k")), "_k", most)


def gather(rows: DataFrame, keys: list[str], hot: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows partitioned by ``keys``, so that all that is grouped or windowed within them needs no other shuffle.

    Rows of the groups in ``hot`` (hot_groups) pass ``combine`` first, which brings
    them down to few, grouping by more than the keys; they keep their columns.
    """
    known = rows.withColumn("_k", F.xxhash64(*keys))
    cold = known.join(F.broadcast(hot), "_k", "left_anti").drop("_k")
    warm = combine(known.join(F.broadcast(hot), "_k", "left_semi").drop("_k"))
    return cold.unionByName(warm.select(cold.columns)).repartition(*keys)
