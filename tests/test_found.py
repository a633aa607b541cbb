"""The general operators on small cases: nulls, repeats, ties, empty tables, clashing names, hot keys."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import changes, hierarchy, nested, orphans, snapshots, versions
from tests.conftest import as_set

SNAP = "bucket string, epoch bigint, created_ns bigint, pruned_ns bigint, key string, loaded_at timestamp, idx int, prev_epoch int"
INODE = "bucket string, epoch bigint, id bigint, gen bigint, mode int, uid bigint, gid bigint, nlink bigint, size bigint, mtime_ns bigint, parent bigint, target string, loaded_at timestamp, part string, _h string"
REF = "bucket string, epoch bigint, inode_id bigint, idx int, hash string, size bigint, loaded_at timestamp, id string, _t string"
H = ["%064x" % i for i in range(5)]


def at(k):
    import datetime

    return datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=k)


def snap(b, e, created=None, pruned=None, key=None, k=0):
    return (b, e, created if created is not None else (e or 0) * 100, pruned, key, at(k), 7, 7)


def inode(b, e, i, gen=1, mode=0o644, size=10, parent=1, k=0, **more):
    v = dict(uid=1, gid=1, nlink=1, mtime=5, target=None) | more
    return (b, e, i, gen, mode, v["uid"], v["gid"], v["nlink"], size, v["mtime"], parent, v["target"], at(k), "x", "x")


def test_snapshot_index_over_blocks(rows):
    epochs = sorted(random.Random(1).sample(range(0, 40_000), 60))
    df = snapshots.snapshot_index(rows(SNAP, *[snap("a", e) for e in epochs], *[snap("a", epochs[3])], snap("b", 9), snap(None, 1), snap("b", None)))
    got = {(r.bucket, r.epoch): (r.idx, r.prev_epoch, r.next_epoch) for r in df.collect()}
    assert got[("b", 9)] == (0, None, None) and len(got) == len(epochs) + 1
    for k, e in enumerate(epochs):
        assert got[("a", e)] == (k, epochs[k - 1] if k else None, epochs[k + 1] if k + 1 < len(epochs) else None)


def test_changes(rows):
    s = rows(SNAP, *[snap("a", e) for e in (1, 3, 7, 9)], snap("a", 3, k=5), snap("b", 1))
    i = rows(
        INODE, inode("a", 1, 1), inode("a", 3, 1), inode("a", 7, 1), inode("a", 9, 1, mode=0o100644),  # type bits do not count
        inode("a", 1, 2), inode("a", 3, 2, size=11), inode("a", 3, 2, size=99, k=-5), inode("a", 9, 2, size=11),  # corrected, then a gap
        inode("a", 1, 3), inode("a", 3, 3, gen=2),  # an id that comes back
        inode("a", 1, 4, gid=None, parent=1), inode("a", 3, 4, gid=1, parent=None), inode("a", 7, 4, gid=1, parent=None), inode("a", 9, 4, gid=1, parent=None),
        inode("a", 1, 5), inode("a", 3, 5), inode("a", 7, 5), inode("a", 9, 5), inode("a", 9, 5),
        inode("b", 1, 1), inode("c", 1, 1), inode(None, 1, 1), inode("a", None, 1), inode("a", 1, None),
    )
    ref = lambda e, idx, h, k=0: ("a", e, 5, idx, h, 4, at(k), "x", "x")
    c = rows(REF, ref(1, 0, H[0]), ref(3, 0, f"chunks/{H[0].upper()}"), ref(3, 0, H[0], 3), ref(7, 0, H[0]), ref(7, 1, None), ref(9, 0, H[0]), ref(9, 1, ""), ("a", 1, 77, 0, H[0], 4, at(0), "x", "x"))
    got = as_set(changes.snapshot_changes(s, i, c), "epoch", "id", "gen", "change")
    assert got == {
        (3, 2, 1, "changed"), (7, 2, 1, "removed"), (9, 2, 1, "added"), (3, 3, 1, "removed"), (3, 3, 2, "added"), (7, 3, 2, "removed"), (3, 4, 1, "changed"), (7, 5, 1, "changed")}
    none = changes.snapshot_changes(s.limit(0), i.limit(0), c.limit(0))
    assert none.columns == ["bucket", "epoch", "id", "gen", "change"] and none.count() == 0
    assert changes.snapshot_changes(s, i.limit(0), c).count() == 0


def test_ties_are_settled_the_same_way(rows):
    s = rows(SNAP, snap("a", 1), snap("a", 2))
    tied = [inode("a", 2, 1, size=n) for n in range(20)]
    out = set()
    for seed in range(3):
        random.Random(seed).shuffle(tied)
        out.add(tuple(versions.inode_versions(s, rows(INODE, inode("a", 1, 1), *tied)).filter("valid_from = 2").select("size").collect()))
    assert len(out) == 1


def _history(rng):
    data, epochs = [], {"a": [1, 4, 5, 9, 12], "b": [2, 3]}
    for b, es in epochs.items():
        for e in es:
            for i in range(1, 9):
                if rng.random() < 0.75:
                    data.append(inode(b, e, i, gen=rng.choice([1, 1, 2]), size=rng.choice([1, 2]), mode=rng.choice([0o644, 0o600, 0o100644])))
    return epochs, data


def test_versions_at_once_and_one_by_one(spark, rows):
    epochs, data = _history(random.Random(3))
    s, i = rows(SNAP, *[snap(b, e) for b, es in epochs.items() for e in es]), rows(INODE, *data)
    state = {(r[0], r[1], r[2]): (r[3], r[8], r[4] & 4095) for r in data}
    want = set()
    for b, es in epochs.items():
        for k in {(i_, state[b, e, i_][0]) for e in es for i_ in range(1, 9) if (b, e, i_) in state}:
            held = [state[b, e, k[0]][1:] if (b, e, k[0]) in state and state[b, e, k[0]][0] == k[1] else None for e in es]
            for n, v in enumerate(held):
                if v is not None and (n == 0 or held[n - 1] != v):
                    m = n
                    while m < len(es) and held[m] == v:
                        m += 1
                    want.add((b, k[0], k[1], v[0], v[1], es[n], es[m] if m < len(es) else -1))
    cols = ["bucket", "id", "gen", "size", "mode", "valid_from", "valid_to"]
    whole = versions.inode_versions(s, i)
    assert as_set(whole, *cols) == want
    batch = snapshots.standing_inodes(i, {n: snapshots.attribute(n) for n in ("size", "mode")}, "size", "mode")
    dim, merged = None, None
    for upto in (3, 4, 9, 12):
        index = snapshots.snapshot_index(s.filter(F.col("epoch") <= upto))
        before = merged.select("bucket", F.col("epoch").alias("_e")) if merged is not None else None
        new = batch.filter(F.col("epoch") <= upto)
        if before is not None:
            new = new.join(before, "bucket", "left").filter("_e IS NULL OR epoch > _e").drop("_e")
        dim = versions.merge_versions(dim, new, index, merged)
        dim = spark.createDataFrame(dim.collect(), dim.schema)
        merged = s.filter(F.col("epoch") <= upto).groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    assert as_set(dim, *cols) == want
    assert versions.inode_versions(s.limit(0), i.limit(0)).count() == 0


BODY = {"version": 1, "epoch": 3, "inodes": {"1": {"id": 1, "gen": 5, "t": 2, "e": {"ü b": 2, "x": None}}, "2": {"id": "2", "t": 1, "lt": "q", "c": [{"h": "aa", "s": 4}, {"s": 3}, None]}, "3": None}}
DOC = "raw_id bigint, bucket string, epoch bigint, body string, rel string, item string"


@pytest.mark.parametrize("shape", ["plain", "list", "wrapped", "pretty"])
def test_flat_tables_of_every_layout(rows, shape):
    body = json.loads(json.dumps(BODY))
    if shape == "list":
        body["inodes"] = [v for v in body["inodes"].values()]
    if shape == "wrapped":
        body = {"root": {"version": 9}, "snapshot": body}
    text = json.dumps(body, indent=1 if shape == "pretty" else None)
    bad = [text[:-2], text.replace('"version": 1', '"version": 2'), "", None, "[]", "7", '{"version": 1}', '{"version": true, "inodes": {}}', text + "x", "[" * 100_000, '{"version": 1, "inodes": {"1": {"id": NaN}}}']
    docs = rows(DOC, (1, "b", 3, text, "r", "i"), (2, "b", 3, text, "r", "i"), *[(k, "b", 4, x, "r", "i") for k, x in enumerate(bad, 3)])
    got = nested.flatten(docs, payload=False).select("bucket", "epoch", "rel", "owner_id", "item").distinct()
    assert as_set(got) == {("b", 3, "inode", 1, ""), ("b", 3, "inode", 2, ""), ("b", 3, "entry", 1, "ü b"), ("b", 3, "entry", 1, "x"), *[("b", 3, "chunk", 2, str(k)) for k in range(3)]}
    assert nested.flatten(docs.limit(0)).count() == 0


def test_flat_tables_typed_and_written(spark, rows, tmp_path):
    docs = rows(DOC, (1, "b", 3, json.dumps(BODY), "r", "i"))
    nested.write_flat(docs, str(tmp_path / "flat"))
    read = lambda rel: nested.read_flat(spark, str(tmp_path / "flat"), rel)
    assert as_set(read("chunk")) == {("b", 3, 2, 0, "aa", 4), ("b", 3, 2, 1, None, 3), ("b", 3, 2, 2, None, None)}
    assert as_set(read("entry")) == {("b", 3, 1, "ü b", 2), ("b", 3, 1, "x", None)}
    assert as_set(read("inode").select("id", "gen", "t", "lt")) == {(1, 5, 2, None), (2, None, 1, "q")}


@pytest.mark.parametrize("split", [1_000_000, 7])
def test_probe_against_brute_force(rows, split):
    rng = random.Random(5)
    lives = [(rng.randrange(20), a := rng.choice([None, *range(50)]), rng.choice([None, *range(51, 99)]) if rng.random() < 0.4 else (a or 0) + rng.randrange(1, 20)) for _ in range(60)]
    asks = [(rng.choice([0, 0, 0, *range(30)]), rng.randrange(100), k) for k in range(400)]
    parents = rows("k int, _start bigint, _stop bigint", *lives).select(*orphans.key_columns(F.col("k")), "_start", "_stop")
    refs = rows("k int, t bigint, n int", *asks).select(*orphans.key_columns(F.col("k")), F.col("t").alias("_t"), "n")
    want = set()
    for k, t, n in asks:
        own = [(a if a is not None else -1e18, b if b is not None else 1e18) for x, a, b in lives if x == k]
        if not any(a <= t < b for a, b in own):
            want.add((n, "deleted" if any(b <= t for _, b in own) else "late" if any(a > t for a, _ in own) else "missing"))
    assert as_set(orphans.probe_missing(refs, parents, 8, split)) == want
    assert orphans.probe_missing(refs, parents.limit(0), 8, split).filter("reason = 'missing'").count() == 400
    assert orphans.probe_missing(refs.limit(0), parents, 8, split).count() == 0


def test_orphan_references(rows):
    s = rows(SNAP, snap("a", 1, 100, None, "snapshots/1"), snap("a", 2, 200, 250, "snapshots/2"), snap("a", 2, 200, 250, "snapshots/2", 9))
    i = rows(INODE, inode("a", 1, 1), inode("a", 1, 5), inode("a", 2, 6))
    d = rows("bucket string, epoch bigint, dir_id bigint, name string, child_id bigint, _k1 string", ("a", 1, 1, "p", 5, ""), ("a", 1, 1, "p", 5, ""), ("a", 2, 1, "q", 5, ""), ("a", 1, 1, "r", 6, ""), ("a", 1, 1, "s", 9, ""), ("a", 1, 1, "n", None, ""))
    c = rows(REF, *[("a", e, 1, k, h, 1, at(0), "x", "x") for e, k, h in ((1, 0, H[1]), (2, 0, H[1].upper()), (1, 1, H[2]), (1, 2, H[3]), (1, 3, H[0]), (1, 4, None), (1, 5, H[1][:9]), (9, 0, H[4]))])
    k = rows("hash string, len bigint, stored_ns bigint, deleted_ns bigint, _t int", (H[1], 1, 50, 150, 0), (H[2].upper(), 1, 101, None, 0), (H[2].upper(), 1, 101, None, 0))
    b = rows("hash string, len bigint, label string", (H[0], 1, "zero"))
    r = rows("bucket string, version int, epoch bigint, snapshot string, written_ns bigint, writer string", ("a", 1, 1, "/snapshots/1", 150, None), ("a", 1, 2, "./snapshots/2 ", 260, None), ("a", 1, 3, "snapshots/2", 150, "w"), ("a", 1, 4, "snapshots/9", 150, "w"), ("a", 1, 5, None, 1, "w"))
    got = as_set(orphans.orphan_references(s, r, i, d, c, k, b), "src", "epoch", "owner_id", "item", "reason")
    assert got == {
        ("chunk_refs", 2, 1, "0", "deleted"), ("chunk_refs", 1, 1, "1", "late"), ("chunk_refs", 1, 1, "2", "missing"), ("chunk_refs", 1, 1, "5", "missing"),
        ("dirents", 2, 1, "q", "deleted"), ("dirents", 1, 1, "r", "late"), ("dirents", 1, 1, "s", "missing"),
        ("roots", 2, 0, "snapshots/2", "deleted"), ("roots", 3, 0, "snapshots/2", "late"), ("roots", 4, 0, "snapshots/9", "missing")}
    empty = [x.limit(0) for x in (s, r, i, d, c, k, b)]
    assert orphans.orphan_report(orphans.orphan_references(*empty)).count() == 0


def brute_tree(nodes):
    out = {}
    for (b, i) in nodes:
        at_, names, ids, seen = i, [], [], set()
        while True:
            parent, name = nodes[b, at_]
            if at_ == 1 or parent is None or (b, parent) not in nodes:
                top = "" if at_ == 1 else f"#{at_}"
                out[b, i] = (at_, len(names), (top + "".join("/" + n for n in reversed(names))) or "/", ids[::-1])
                break
            if at_ in seen:
                out[b, i] = (-1, -1, "", [])
                break
            seen.add(at_)
            names.append(name if name is not None else f"#{at_}")
            ids.append(parent)
            at_ = parent
    return out


def test_hierarchy_against_brute_force(rows):
    rng = random.Random(8)
    nodes = {}
    for i in range(1, 120):
        nodes["t", i] = (rng.choice([None, i, *range(1, i)]) if rng.random() < 0.05 else rng.randrange(1, i) if i > 1 else rng.choice([None, 5]), rng.choice([None, f"n {i}", "ü"]))
    for i in range(200, 400):  # a chain of 200 below a root of its own
        nodes["t", i] = (i - 1 if i > 200 else 999_999, f"c{i}")
    for i in range(500, 520):  # circles, and what hangs below them
        nodes["t", i] = (500 + (i - 499) % 3 if i < 503 else i - 1, "x")
    for i in range(600, 700):
        nodes["u", i] = (600 + (i - 599) % 100, "y")
    data = [(b, i, p, n, "x") for (b, i), (p, n) in nodes.items()]
    df = rows("bucket string, id bigint, parent bigint, name string, at string", *data, *data[:30], ("t", None, 1, "z", "x"), (None, 7, 1, "z", "x"))
    want = brute_tree(nodes)
    for split in (4, 64):
        found = hierarchy.hierarchy(df, split, trail=True)
        assert {(r.bucket, r.id): (r.root_id, r.depth, r.path, list(r.above)) for r in found.collect()} == want
    below = as_set(hierarchy.descendants(found))
    assert below == {(b, a, i, len(w[3]) - k) for (b, i), w in want.items() for k, a in enumerate(w[3])}
    assert hierarchy.hierarchy(df.limit(0)).count() == 0


def test_newest_tree(rows):
    s = rows(SNAP, snap("a", 1), snap("a", 2))
    i = rows(INODE, inode("a", 1, 9), inode("a", 2, 1, parent=None), inode("a", 2, 2, parent=1), inode("a", 2, 2, parent=9, k=-3), inode("a", 2, 3, parent=2))
    d = rows("bucket string, epoch bigint, dir_id bigint, name string, child_id bigint, id string", ("a", 2, 1, "b", 2, ""), ("a", 2, 1, "B", 2, ""), ("a", 2, 1, "other", 3, ""), ("a", 1, 1, "A", 2, ""), ("a", 2, 1, None, 2, ""))
    assert as_set(hierarchy.hierarchy(hierarchy.newest_tree(s, i, d))) == {("a", 1, 1, 0, "/"), ("a", 2, 1, 1, "/B"), ("a", 3, 1, 2, "/B/#3")}
