"""References to records that do not exist at the time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.spelling import chunk_hash, snapshot_key
from cairn.operators.snapshots import snapshot_index
from cairn.planning import broadcast_if_small, hot_keys, row_hash, row_order

#: References and parents of one range, and references of one piece of a hot key.
SPLIT_ROWS = 1_000_000
#: Ranges for each shuffle partition, at least.
RANGES_A_TASK = 16
NO_START, NO_STOP = -(2**63), 2**63 - 1
_STEP = 1 << 24


def key_columns(*parts: Column) -> list[Column]:
    """128 bits that stand for a key: two hashes, the first of which orders it."""
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(17), *reversed(parts)).alias("_k2")]


def probe_missing(refs: DataFrame, parents: DataFrame, ranges: int | None = None, split_rows: int = SPLIT_ROWS, asked: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """The references whose parent is not there at their time, with a reason.

    ``refs`` has _k1, _k2 (key_columns), _t and any further columns, which come
    out; ``parents`` has _k1, _k2, _start, _stop, a lifetime each: the parent is
    there from _start up to but not at _stop, null being without bound. A key may
    have many lifetimes. reason is 'deleted' if one ended at or before _t, else
    'late' if one starts after, else 'missing'.

    Both sides are cut into ranges of the first key hash, as many as keep
    ``split_rows`` of ``rows`` in one and every task busy (or ``ranges`` of them). A range's parents
    are kept as sorted arrays in the task that reads the range, and its
    references come by as Arrow batches that are looked up by binary search. A
    key of more than ``split_rows`` references is probed in several places, each
    with a copy of that key's lifetimes and of no other's. Hot keys are found in
    ``asked`` (_k1), by default ``refs``.
    """
    ranges = ranges or max(RANGES_A_TASK * int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // split_rows))
    hot = F.broadcast(hot_keys(refs if asked is None else asked, "_k1", split_rows))
    in_range = F.least(F.floor((F.col("_k1") / F.lit(2.0**64) + 0.5) * ranges).cast("bigint"), F.lit(ranges - 1)) * _STEP
    route = lambda piece, is_ref: ((in_range + piece) * 2 + is_ref).alias("_route")
    payload = [f for f in refs.schema if f.name not in ("_k1", "_k2", "_t")]
    no = [F.lit(None).cast(f.dataType).alias(f.name) for f in payload]
    own = [f.name for f in payload]
    piece = F.coalesce(F.pmod(F.xxhash64("_k2", "_t", *own), F.col("_pieces")) + 1, F.lit(0))
    left = refs.join(hot, "_k1", "left").select(route(piece, 1), "_k1", "_k2", "_t", F.lit(0).cast("bigint").alias("_stop"), *own)
    copies = F.explode(F.when(F.col("_pieces").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.coalesce("_pieces", F.lit(1))))).alias("_piece")
    right = parents.join(hot, "_k1", "left").select("*", copies).select(
        route(F.col("_piece"), 0), "_k1", "_k2", F.coalesce("_start", F.lit(NO_START)).alias("_t"), F.coalesce("_stop", F.lit(NO_STOP)).alias("_stop"), *no,
    )
    routed = left.unionByName(right).repartition(F.shiftright("_route", 1)).sortWithinPartitions("_route")
    out = T.StructType([*payload, T.StructField("reason", T.StringType())])
    return routed.mapInArrow(_Probe(own), out)


class _Probe:
    def __init__(self, own: list[str]):
        self.own = own

    def __call__(self, batches):
        held, index, at = [], None, None
        for batch in batches:
            route = batch.column("_route").to_numpy()
            cuts = np.flatnonzero(np.diff(route)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(route)]):
                if lo == hi:
                    continue
                if route[lo] >> 1 != at:
                    held, index, at = [], None, route[lo] >> 1
                part = batch.slice(lo, hi - lo)
                columns = [part.column(c).to_numpy() for c in ("_k1", "_k2", "_t", "_stop")]
                if not route[lo] & 1:
                    held.append(columns)
                    continue
                if index is None:
                    index = _Lifetimes(*(np.concatenate(c) for c in zip(*held))) if held else _Lifetimes(*[np.zeros(0, np.int64)] * 4)
                    held = []
                reason = index.reasons(*columns[:3])
                miss = np.flatnonzero(reason)
                if len(miss):
                    kept = part.select(self.own).take(pa.array(miss))
                    word = pc.take(pa.array([None, "deleted", "late", "missing"]), pa.array(reason[miss]))
                    yield pa.RecordBatch.from_arrays([*kept.columns, word], [*self.own, "reason"])


class _Lifetimes:
    """Lifetimes sorted by key and start, with what a probe needs of each key."""

    def __init__(self, k1, k2, start, stop):
        order = np.lexsort((start, k2, k1))
        k1, k2, self.start, stop = k1[order], k2[order], start[order], stop[order]
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        self.first = np.flatnonzero(new)
        self.k1, self.k2 = k1[self.first], k2[self.first]
        self.end = np.append(self.first[1:], len(k1)).astype(np.int64)
        self.least = np.minimum.reduceat(stop, self.first) if len(k1) else stop
        self.most = stop.copy()  # the latest stop so far within the key
        step, group = 1, np.cumsum(new)
        longest = int((self.end - self.first).max()) if len(k1) else 0
        while step < longest:
            same = group[step:] == group[:-step]
            self.most[step:] = np.where(same, np.maximum(self.most[step:], self.most[:-step]), self.most[step:])
            step *= 2

    def reasons(self, k1, k2, t):
        """0 there, 1 deleted, 2 late, 3 missing."""
        out = np.full(len(t), 3, np.int64)
        if not len(self.k1):
            return out
        g = np.searchsorted(self.k1, k1)
        top = len(self.k1) - 1
        while True:  # keys that share the first hash lie side by side
            here = np.minimum(g, top)
            other = (g <= top) & (self.k1[here] == k1) & (self.k2[here] != k2)
            if not other.any():
                break
            g = g + other
        found = np.flatnonzero((g <= top) & (self.k1[here] == k1))
        g, t = g[found], t[found]
        first, end = self.first[g], self.end[g]
        lo, hi = first.copy(), end.copy()
        while (lo < hi).any():  # the lifetimes of the key that start at or before t
            mid = (lo + hi) >> 1
            go = (lo < hi) & (self.start[np.minimum(mid, len(self.start) - 1)] <= t)
            hi = np.where((lo < hi) & ~go, mid, hi)
            lo = np.where(go, mid + 1, lo)
        there = (lo > first) & (self.most[np.maximum(lo - 1, 0)] > t)
        out[found] = np.where(there, 0, np.where(self.least[g] <= t, 1, np.where(lo < end, 2, 3)))
        return out


def orphan_references(
    snapshots: DataFrame, roots: DataFrame, inodes: DataFrame, dirents: DataFrame, chunk_refs: DataFrame, chunks: DataFrame, base_chunks: DataFrame, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """(src, bucket, epoch, owner_id, item, reason), one row per orphan reference.

    Chunk references are looked up among the lifetimes of their hash, base
    contents always being there; directory entries among the epochs of their
    bucket's inode; root pointers within the lifetime of their snapshot's key, of
    whose rows the latest stands.
    Holes and null keys are no references. References of snapshots that the
    snapshots table does not know have no time and are left out. References and
    parents delivered several times count once. Empty parent tables make every
    reference an orphan.
    """
    index = snapshot_index(snapshots).select("bucket", "epoch", F.col("created_ns").alias("_t"))
    index = broadcast_if_small(index, snapshots, ("bucket",))
    row = lambda src, owner, item: [F.lit(src).alias("src"), "bucket", "epoch", owner.cast("bigint").alias("owner_id"), item.alias("item")]

    own = F.col("_h")
    stored = broadcast_if_small(base_chunks.select(chunk_hash(F.col("hash")).alias("_h")).distinct(), base_chunks, ("hash",))
    hashes = chunk_refs.select("bucket", "epoch", "inode_id", "idx", chunk_hash(F.col("hash")).alias("_h")).filter("_h IS NOT NULL").join(stored, "_h", "left_anti")
    asked = [hashes.select(*key_columns(F.lit("chunk"), own)[:1])]
    hashes = hashes.join(index, ["bucket", "epoch"]).filter("_t IS NOT NULL")
    refs = [hashes.select(*key_columns(F.lit("chunk"), own), "_t", *row("chunk_refs", F.col("inode_id"), F.col("idx").cast("string")))]
    parents = [
        chunks.select(chunk_hash(F.col("hash")).alias("_h"), "stored_ns", "deleted_ns").filter("_h IS NOT NULL")
        .select(*key_columns(F.lit("chunk"), own), F.col("stored_ns").alias("_start"), F.col("deleted_ns").alias("_stop"))
    ]

    entries = dirents.filter("bucket IS NOT NULL AND epoch IS NOT NULL AND child_id IS NOT NULL")
    refs.append(entries.select(*key_columns(F.lit("inode"), F.col("bucket"), F.col("child_id")), F.col("epoch").alias("_t"), *row("dirents", F.col("dir_id"), F.col("name"))))
    there = inodes.select("bucket", "epoch", "id").filter("bucket IS NOT NULL AND epoch IS NOT NULL AND id IS NOT NULL")
    parents.append(there.select(*key_columns(F.lit("inode"), F.col("bucket"), F.col("id")), F.col("epoch").alias("_start"), (F.col("epoch") + 1).alias("_stop")))

    key = snapshot_key(F.col("snapshot"))
    refs.append(roots.filter("bucket IS NOT NULL AND snapshot IS NOT NULL AND written_ns IS NOT NULL").select(*key_columns(F.lit("key"), F.col("bucket"), key), F.col("written_ns").alias("_t"), *row("roots", F.lit(0), key)))
    at = row_order(F.col("loaded_at"), row_hash(F.col("created_ns"), F.col("pruned_ns")))
    lives = snapshots.groupBy("bucket", "key").agg(F.max_by("created_ns", at).alias("_start"), F.max_by("pruned_ns", at).alias("_stop"))
    parents.append(lives.select(*key_columns(F.lit("key"), F.col("bucket"), F.col("key")), "_start", "_stop"))

    union = lambda frames: reduce(DataFrame.unionByName, frames)
    asked += [r.select("_k1") for r in refs[1:]]
    rows = sum(t.count() for t in (roots, inodes, dirents, chunk_refs, chunks, snapshots))
    return probe_missing(union(refs), union(parents), split_rows=split_rows, asked=union(asked), rows=rows).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(src, bucket, epoch, reason, n): orphans per table and period."""
    return orphans.groupBy("src", "bucket", "epoch", "reason").agg(F.count("*").alias("n"))
