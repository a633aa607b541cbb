"""Which snapshots and chunks are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.spelling import chunk_hash, is_hash

KEEP = 10


def prunable(snapshots: DataFrame, current: DataFrame, keep: int = KEEP) -> DataFrame:
    """(bucket, key) of snapshots below the current one (bucket, current), but for the newest ``keep``."""
    below = snapshots.select("bucket", "key").distinct().join(current, "bucket").filter(F.col("key") < F.col("current"))
    if keep <= 0:
        return below.select("bucket", "key")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("key").desc()))
    newest = below.withColumn("_r", rank).filter(F.col("_r") <= keep)  # a limit within each task first, so no bucket is sorted in one
    return below.join(newest, ["bucket", "key"], "left_anti").select("bucket", "key")


def at_epoch(relation: DataFrame, epochs: DataFrame) -> DataFrame:
    """A relation as of one epoch per bucket (bucket, epoch): pinned, so a later commit is not seen."""
    return relation.join(epochs.select("bucket", "epoch"), ["bucket", "epoch"], "left_semi")


def reachable(chunk_refs: DataFrame, retained: DataFrame) -> DataFrame:
    """(hash): chunks that a retained snapshot (bucket, epoch) refers to."""
    plain = chunk_hash(F.col("hash"))
    return chunk_refs.join(retained.select("bucket", "epoch"), ["bucket", "epoch"], "left_semi").select(plain.alias("hash")).filter(is_hash(F.col("hash"))).distinct()


def sweepable(chunks: DataFrame, marked: DataFrame, started_ns: int, complete: bool = True) -> DataFrame:
    """Chunks that may be deleted: stored, not marked, not newer than the start of the mark.

    Nothing if not all roots are known (``complete`` false). Deleting is the
    caller's, so this is the dry run.
    """
    stored = chunks.filter(F.col("deleted_ns").isNull() & (F.col("stored_ns") < started_ns)).withColumn("hash", chunk_hash(F.col("hash")))
    if not complete:
        stored = stored.limit(0)
    return stored.join(marked, "hash", "left_anti").select("hash", "len", "stored_ns").distinct()
