"""History of changing attributes as type-two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.snapshots import attribute, snapshot_index
from cairn.planning import broadcast_if_small, gather, hot_groups, row_hash, row_order
from cairn.scratch import Scratch

#: valid_to of a version that still holds.
OPEN = -1
KEY = ["bucket", "id"]
_ROW = [*KEY, "gen", "epoch", "size", "mode", "loaded_at", "idx", "next_epoch", "_from"]


def _hash():
    return row_hash(F.col("gen"), F.col("size"), F.col("mode"))


def _standing(rows: DataFrame) -> DataFrame:
    """One row per inode and snapshot, the latest."""
    held = rows.withColumn("_at", row_order(F.col("loaded_at"), _hash()))
    return held.groupBy(*KEY, "epoch").agg(*[F.max_by(c, "_at").alias(c) for c in ("gen", "size", "mode")], *[F.max(c).alias(c) for c in ("loaded_at", "idx", "next_epoch", "_from")])


def merge_versions(current: DataFrame | None, batch: DataFrame, index: DataFrame, merged: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Merge whole snapshots into a type-two dimension of inodes.

    ``current`` has (bucket, id, gen, size, mode, attr_hash, valid_from,
    valid_to), or is None at the start. ``batch`` has (bucket, epoch, id, gen,
    size, mode) of the inodes of the new snapshots; where it has loaded_at, rows
    may be repeated and the latest stands. ``index`` is snapshot_index of all
    snapshots so far, which a batch that has idx and next_epoch is already joined
    with; ``merged`` gives the newest epoch of each bucket already in ``current``.

    A row whose hash equals that of the version open in the snapshot before
    extends it; another closes it at its own epoch and opens a new one; a version
    whose inode is absent is closed at the epoch that lacks it. Closed versions
    pass through untouched and unsorted. Any number of snapshots may come at
    once: rows are gathered by inode, the only shuffle, and compared with the
    version before them in a window. Inodes in ``hot`` (hot_groups) are brought
    down to one row per snapshot before.
    """
    rows = (batch if "idx" in batch.columns else batch.join(index, ["bucket", "epoch"])).withColumn("_from", F.col("epoch"))
    if "loaded_at" not in rows.columns:
        rows = rows.withColumn("loaded_at", F.lit(None).cast("timestamp"))
    rows, done = rows.select(_ROW), None
    if current is not None:
        done = current.filter(F.col("valid_to") != OPEN)
        newest = merged.select("bucket", "epoch").join(index, ["bucket", "epoch"])
        held = current.filter(F.col("valid_to") == OPEN).join(broadcast_if_small(newest, newest, ("bucket",)), "bucket")
        rows = held.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c == "loaded_at" else F.col("valid_from").alias(c) if c == "_from" else c for c in _ROW]).unionByName(rows)
    here = _standing(gather(rows, KEY, hot if hot is not None else hot_groups(rows, *KEY), _standing)).withColumn("attr_hash", _hash())
    by = Window.partitionBy("bucket", "id", "gen").orderBy("idx")
    near = here.select("*", *[f("idx").over(by).alias(f"_{n}i") for f, n in ((F.lag, "p"), (F.lead, "n"))], *[f("attr_hash").over(by).alias(f"_{n}h") for f, n in ((F.lag, "p"), (F.lead, "n"))])
    first = F.coalesce((F.col("_pi") != F.col("idx") - 1) | (F.col("_ph") != F.col("attr_hash")), F.lit(True))
    last = F.coalesce((F.col("_ni") != F.col("idx") + 1) | (F.col("_nh") != F.col("attr_hash")), F.lit(True))
    ends = near.select("*", first.alias("_first"), last.alias("_last")).filter("_first OR _last")
    to = F.when(F.col("_last"), F.col("next_epoch")).otherwise(F.lead("next_epoch").over(by))
    new = ends.select("*", F.coalesce(to, F.lit(OPEN)).alias("valid_to")).filter("_first").select(
        "bucket", "id", "gen", "size", "mode", "attr_hash", F.col("_from").alias("valid_from"), "valid_to"
    )
    return new if done is None else done.select(new.columns).unionByName(new)


def inode_versions(snapshots: DataFrame, inodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """All versions of size and mode of every inode: the first half of a bucket's snapshots is loaded, the rest merged in.

    The load, into an empty dimension, is written; what comes after is compared
    with its open versions. Of an inode's rows in a snapshot the latest stands;
    nulls are values like any other; rows of unknown snapshots are left out;
    empty tables give no rows.
    """
    scratch = scratch or Scratch(snapshots.sparkSession, "versions")
    index = scratch.write(snapshot_index(snapshots).select("bucket", "epoch", "idx", "next_epoch"))
    cut = index.groupBy("bucket").agg(F.floor(F.max("idx") / 2).alias("_cut"))
    cut = index.join(cut, "bucket")
    early, late = cut.filter("idx <= _cut"), cut.filter("idx > _cut").drop("_cut")
    # the load does not know what follows: its last snapshot has no next one
    early = early.withColumn("next_epoch", F.when(F.col("idx") < F.col("_cut"), F.col("next_epoch"))).drop("_cut")
    small = lambda df: broadcast_if_small(df, index, ("bucket",))
    rows = inodes.filter("bucket IS NOT NULL AND epoch IS NOT NULL AND id IS NOT NULL").select("bucket", "epoch", "id", "gen", "size", attribute("mode").alias("mode"), "loaded_at")
    hot = hot_groups(rows, *KEY)
    loaded = scratch.write(merge_versions(None, rows.join(small(early), ["bucket", "epoch"]), early, None, hot))
    merged = early.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return merge_versions(loaded, rows.join(small(late), ["bucket", "epoch"]), index, merged, hot)
