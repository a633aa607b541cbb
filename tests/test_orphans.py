"""Orphans: snapshots delivered again, hot keys in pieces with copies of their own parents only."""

from pyspark.sql import functions as F

from cairn.operators import orphans
from tests.conftest import as_set
from tests.test_found import INODE, REF, SNAP, H, at, inode, snap


def _tables(rows, snaps, roots=(), chunks=(), refs=()):
    return (
        rows(SNAP, *snaps), rows("bucket string, version int, epoch bigint, snapshot string, written_ns bigint, writer string", *roots), rows(INODE, inode("a", 1, 1)).limit(0),
        rows("bucket string, epoch bigint, dir_id bigint, name string, child_id bigint", ("a", 1, 1, "p", 5)).limit(0), rows(REF, *refs) if refs else rows(REF, ("a", 1, 1, 0, None, 1, at(0), "x", "x")),
        rows("hash string, len bigint, stored_ns bigint, deleted_ns bigint", *chunks) if chunks else rows("hash string, len bigint, stored_ns bigint, deleted_ns bigint", ("x", 1, 1, 2)).limit(0), rows("hash string, len bigint, label string", (H[0], 1, "zero")))


def test_the_latest_delivery_of_a_snapshot_stands(rows):
    first, later = snap("a", 1, 100, None, "snapshots/1", 0), snap("a", 1, 100, 150, "snapshots/1", 9)
    root = ("a", 1, 1, "/snapshots/1", 200, "w")
    for snaps in ([first, later], [later, first], [later], [later, later, first, first]):
        assert as_set(orphans.orphan_references(*_tables(rows, snaps, [root])), "src", "item", "reason") == {("roots", "snapshots/1", "deleted")}
    kept = snap("a", 1, 100, None, "snapshots/1", 20)
    assert orphans.orphan_references(*_tables(rows, [later, kept], [root])).count() == 0


def test_copies_go_with_hot_keys_only(rows):
    refs = rows("k int, t bigint, n int", *[(0, k % 100, k) for k in range(900)], *[(k, 50, 1000 + k) for k in range(1, 60)])
    refs = refs.select(*orphans.key_columns(F.col("k")), F.col("t").alias("_t"), "n")
    lives = [(k, 0, 40) for k in range(60)] + [(0, 60, None)]
    parents = rows("k int, _start bigint, _stop bigint", *lives).select(*orphans.key_columns(F.col("k")), "_start", "_stop")
    got = as_set(orphans.probe_missing(refs, parents, split_rows=100, rows=1000))
    assert got == {(k, "deleted") for k in range(900) if 40 <= k % 100 < 60} | {(1000 + k, "deleted") for k in range(1, 60)}
    hot = {r._pieces for r in orphans.hot_keys(refs, "_k1", 100).collect()}
    assert hot == {9}


def test_split_references_give_the_same(rows):
    snaps = [snap("a", e, e * 100, None, f"snapshots/{e}") for e in range(1, 5)]
    refs = [("a", e, 1, k, H[1 + k % 3], 1, at(0), "x", "x") for e in range(1, 5) for k in range(40)]
    chunks = [(H[1], 1, 50, 250), (H[2], 1, 350, None)]
    want = {(e, str(k), "missing" if k % 3 == 2 else "deleted" if k % 3 == 0 else "late") for e in range(1, 5) for k in range(40) if k % 3 == 2 or (k % 3 == 0 and e > 2) or (k % 3 == 1 and e < 4)}
    for split in (10, 10_000):
        assert as_set(orphans.orphan_references(*_tables(rows, snaps, (("a", 1, 1, "snapshots/1", 100, "w"),), chunks, refs), split_rows=split), "epoch", "item", "reason") == want
