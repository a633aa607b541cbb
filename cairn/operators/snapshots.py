"""Order of a bucket's snapshots, and the row that stands for an inode in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.spelling import low_mode
from cairn.planning import row_hash, row_order

#: Epochs of one block of a bucket; a block is what one task orders.
BLOCK = 4096


def snapshot_index(snapshots: DataFrame) -> DataFrame:
    """(bucket, epoch, created_ns, idx, prev_epoch, next_epoch), one row per snapshot.

    idx counts a bucket's snapshots from 0 in the order of their epochs. Rows
    delivered several times count once and the latest stands; rows without
    bucket or epoch name no snapshot. A bucket is cut into blocks of epochs, so
    one that holds most of the table is ordered by many tasks: only the blocks'
    bounds meet in one.
    """
    at = row_order(F.col("loaded_at"), F.coalesce("created_ns", F.lit(0)))
    one = (
        snapshots.filter("bucket IS NOT NULL AND epoch IS NOT NULL")
        .groupBy("bucket", "epoch").agg(F.max_by("created_ns", at).alias("created_ns"))
        .withColumn("_block", F.floor(F.col("epoch") / BLOCK))
    )
    blocks = Window.partitionBy("bucket").orderBy("_block")
    bounds = one.groupBy("bucket", "_block").agg(F.count("*").alias("_n"), F.min("epoch").alias("_lo"), F.max("epoch").alias("_hi")).select(
        "bucket", "_block",
        F.coalesce(F.sum("_n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_hi").over(blocks).alias("_prev"), F.lead("_lo").over(blocks).alias("_next"),
    )
    inside = Window.partitionBy("bucket", "_block").orderBy("epoch")
    own = one.select("*", F.row_number().over(inside).alias("_rn"), F.lag("epoch").over(inside).alias("_lag"), F.lead("epoch").over(inside).alias("_lead"))
    return own.join(bounds, ["bucket", "_block"]).select(
        "bucket", "epoch", "created_ns", (F.col("_before") + F.col("_rn") - 1).alias("idx"),
        F.coalesce("_lag", "_prev").alias("prev_epoch"), F.coalesce("_lead", "_next").alias("next_epoch"),
    )


def standing_inodes(inodes: DataFrame, attrs: dict[str, Column], *keep: str) -> DataFrame:
    """One row per (bucket, epoch, id): that of the latest loaded_at.

    ``attrs`` are the attributes that matter, by output name; ``keep`` those of
    them to return, besides gen and ``attr_hash``, the hash of all of them. Rows
    of equal loaded_at that differ are settled by the hash. Rows without bucket,
    epoch or id are dropped. Combined before the shuffle, so a row repeated
    without end travels once a task.
    """
    return attributed(inodes, attrs).groupBy("bucket", "epoch", "id").agg(
        F.max_by("gen", "_at").alias("gen"), F.max_by("_hash", "_at").alias("attr_hash"), *[F.max_by(f"_{n}", "_at").alias(n) for n in keep]
    )


def attributed(inodes: DataFrame, attrs: dict[str, Column]) -> DataFrame:
    """(bucket, epoch, id, gen, _hash, _at, _<attribute>…): every row with its hash and its order among the rows of its key."""
    rows = inodes.filter("bucket IS NOT NULL AND epoch IS NOT NULL AND id IS NOT NULL").select(
        "bucket", "epoch", "id", "gen", "loaded_at", *[c.alias(f"_{n}") for n, c in attrs.items()]
    ).withColumn("_hash", row_hash(F.col("gen"), *[F.col(f"_{n}") for n in attrs]))
    return rows.withColumn("_at", row_order(F.col("loaded_at"), F.col("_hash"))).drop("loaded_at")


def attribute(name: str) -> Column:
    return low_mode(F.col("mode")) if name == "mode" else F.col(name)
