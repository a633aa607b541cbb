"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.spelling import chunk_hash
from cairn.operators.snapshots import attribute, snapshot_index
from cairn.planning import broadcast_if_small, gather, hot_groups, row_hash, row_order

#: Attributes whose change makes an inode changed; the chunk list counts besides.
COMPARED = ("mode", "uid", "gid", "nlink", "size", "mtime_ns", "parent", "target")
KEY = ["bucket", "id"]


def _rows(inodes: DataFrame, chunk_refs: DataFrame, index: DataFrame) -> DataFrame:
    """Inodes and their chunks as rows of one shape; ``part`` is the chunk's idx, null of the inode itself."""
    known = inodes.filter("bucket IS NOT NULL AND epoch IS NOT NULL AND id IS NOT NULL")
    own = known.select("bucket", "epoch", "id", "gen", row_hash(F.col("gen"), *[attribute(n) for n in COMPARED]).alias("h"), "loaded_at").join(index, ["bucket", "epoch"])
    plain = F.coalesce(chunk_hash(F.col("hash")), F.lit(""))
    chunks = chunk_refs.filter("bucket IS NOT NULL AND epoch IS NOT NULL AND inode_id IS NOT NULL AND idx IS NOT NULL")
    parts = chunks.select("bucket", "epoch", F.col("inode_id").alias("id"), F.col("idx").cast("bigint").alias("part"), F.xxhash64(plain).alias("h"), "loaded_at")
    none = {"list_hash": F.lit(None).cast("bigint"), "list_len": F.lit(None).cast("bigint")}
    return own.unionByName(parts, allowMissingColumns=True).withColumns(none)


def _states(rows: DataFrame) -> DataFrame:
    """One row per inode and snapshot: its latest row, with the XOR of hashes of its chunk list's parts, each once.

    A part delivered several times counts once, the latest standing; every hole
    gives the same. Lists already brought together (list_hash, list_len) are kept.
    """
    at = row_order(F.col("loaded_at"), F.col("h"))
    once = rows.withColumn("_at", at).groupBy(*KEY, "epoch", "part").agg(
        F.max_by("h", "_at").alias("h"), F.max_by("gen", "_at").alias("gen"), *[F.max(c).alias(c) for c in ("loaded_at", "idx", "next_epoch", "list_hash", "list_len")])
    own = F.col("part").isNull()
    part = F.when(~own, F.xxhash64("part", "h"))
    of = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    return once.groupBy(*KEY, "epoch").agg(
        *[of(c) for c in ("h", "gen", "loaded_at", "idx", "next_epoch")], F.bit_xor(part).alias("_x"), F.count(part).alias("_n"), F.max("list_hash").alias("_lh"), F.max("list_len").alias("_ll")
    ).select(
        *KEY, "epoch", F.lit(None).cast("bigint").alias("part"), "h", "gen", "loaded_at", "idx", "next_epoch",
        F.coalesce("_x", F.lit(0)).bitwiseXOR(F.coalesce("_lh", F.lit(0))).alias("list_hash"), (F.col("_n") + F.coalesce("_ll", F.lit(0))).alias("list_len"))


def snapshot_changes(snapshots: DataFrame, inodes: DataFrame, chunk_refs: DataFrame) -> DataFrame:
    """(bucket, epoch, id, gen, change) between each snapshot and the one before.

    Each inode (bucket, id, gen) is windowed by snapshot index: a lagged hash of
    attributes and chunk list that differs is a change, a gap in the index a
    removal and a later addition. A bucket's first snapshot yields nothing.
    Inodes without gen are one identity of their id; rows of snapshots that the
    snapshots table does not know are left out; empty tables give no rows.

    Inodes and chunks are gathered by inode in one shuffle, which serves the
    states of all snapshots and the window. Those of an inode that has very many
    rows, as a file of a third of all chunks, are first brought together by
    snapshot and place in the list.
    """
    index = snapshot_index(snapshots).select("bucket", "epoch", "idx", "next_epoch")
    rows = _rows(inodes, chunk_refs, broadcast_if_small(index, snapshots, ("bucket",)))
    asked = inodes.select("bucket", "id").unionByName(chunk_refs.select("bucket", F.col("inode_id").alias("id")))
    state = _states(gather(rows, KEY, hot_groups(asked, *KEY), _states)).filter("idx IS NOT NULL").select(
        *KEY, "epoch", "gen", "idx", "next_epoch", F.xxhash64("h", "list_len", "list_hash").alias("_h"))
    by = Window.partitionBy("bucket", "id", "gen").orderBy("idx")
    seen = state.select("*", F.lag("idx").over(by).alias("_pi"), F.lag("_h").over(by).alias("_ph"), F.lead("idx").over(by).alias("_ni"))
    gap = F.col("_pi").isNull() | (F.col("_pi") < F.col("idx") - 1)
    now = F.when(gap & (F.col("idx") > 0), "added").when(~gap & (F.col("_ph") != F.col("_h")), "changed")
    gone = F.col("next_epoch").isNotNull() & (F.col("_ni").isNull() | (F.col("_ni") > F.col("idx") + 1))
    both = F.array(F.struct(F.col("epoch").alias("epoch"), now.alias("change")), F.struct(F.col("next_epoch").alias("epoch"), F.when(gone, "removed").alias("change")))
    return (
        seen.select("bucket", "id", "gen", F.explode(both).alias("_e")).filter("_e.change IS NOT NULL")
        .select("bucket", "_e.epoch", "id", "gen", "_e.change")
    )
