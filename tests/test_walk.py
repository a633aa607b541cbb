"""Paths of any length, walked as repeated lookup."""

import os
from collections import defaultdict

import duckdb
import pytest

from cairn.operators import namespace as N
from cairn.plans import reference
from tests.conftest import as_set

DATA = "/root/testdata/sf0.001"
INODES = "bucket string, id bigint, type int, parent bigint"
DIRENTS = "bucket string, dir_id bigint, name string, child_id bigint"
DIR, FILE = 2, 1


def model(inodes, dirents, bucket, path):
    """Lookup after lookup, in plain Python."""
    at, entries = 1, {(d, n): c for b, d, n, c in dirents if b == bucket}
    nodes = {i: (t, p) for b, i, t, p in inodes if b == bucket}
    for name in [x for x in path.split("/") if x]:
        if at not in nodes:
            return None, 70
        if nodes[at][0] != DIR:
            return None, 20
        child = at if name == "." else (1 if at == 1 else nodes[at][1]) if name == ".." else entries.get((at, name))
        if child not in nodes:
            return None, 2
        at = child
    return at, 0


def test_walk_of_any_length(rows):
    deep = 21
    inodes = [("x", i, DIR, i - 1) for i in range(1, deep)] + [("x", deep, FILE, deep - 1), ("x", 50, DIR, 1), ("y", 1, DIR, None)]
    dirents = [("x", i, f"d{i}", i + 1) for i in range(1, deep)] + [("x", 5, "gone", 99), ("x", 1, "round", 50), ("x", 50, "again", 50), ("x", 50, "up", 1)]
    to = lambda n: "".join(f"/d{i}" for i in range(1, n))
    paths = [to(n) for n in range(1, deep + 1)] + ["/", to(deep) + "/more", to(5) + "/gone", to(5) + "/gone/on", to(7) + "/no/such", to(9) + "/../../d7/./d8", to(deep) + "/.", "/..//d1", "/round/again/again/up/d1", "/round" + "/again" * 40, "/no" * 37]
    asked = [("x", p) for p in paths] + [("y", "/"), ("y", "/d1"), ("z", "/d1/d2")]
    got = as_set(N.walk_paths(rows("bucket string, path string", *asked), rows(INODES, *inodes), rows(DIRENTS, *dirents)), "bucket", "path", "id", "status")
    assert got == {(b, p, *model(inodes, dirents, b, p)) for b, p in asked}


def test_every_entry_has_its_paths(rows):
    # 2 has two names; 4 names 2 again, a circle; 7 is named by no one
    dirents = [("x", 1, "a", 2), ("x", 1, "b", 2), ("x", 2, "c", 4), ("x", 4, "d", 5), ("x", 4, "back", 2), ("x", 4, "self", 4), ("x", 7, "e", 8), ("y", 1, "f", 3)]
    got = as_set(N.entry_paths(rows(DIRENTS, *dirents)), "bucket", "path")
    below = ("", "/c", "/c/d", "/c/back", "/c/self")
    assert got == {("x", top + p) for top in ("/a", "/b") for p in below} | {("y", "/f")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_walk_of_the_newest_snapshots(spark):
    newest = f"(SELECT bucket, max(epoch) AS epoch FROM '{DATA}/snapshots.parquet' GROUP BY bucket)"
    of = lambda t, c: duckdb.sql(f"SELECT {c} FROM '{DATA}/{t}.parquet' SEMI JOIN {newest} USING (bucket, epoch)").fetchall()
    inodes = {(b, i): (b, i, t, p) for b, i, t, p, _ in sorted(of("inodes", "bucket, id, type, parent, loaded_at"), key=lambda r: r[4])}.values()
    dirents = set(of("dirents", "bucket, dir_id, name, child_id"))
    kids = defaultdict(list)
    for b, at, name, child in dirents:
        kids[b, at].append((name, child))
    paths, todo = set(), [(b, 1, "", (1,)) for b in {r[0] for r in dirents}]
    while todo:
        b, at, path, above = todo.pop()
        for name, child in kids[b, at]:
            paths.add((b, f"{path}/{name}"))
            if child not in above:
                todo.append((b, child, f"{path}/{name}", (*above, child)))
    assert max(p.count("/") for _, p in paths) > 2
    assert as_set(reference.ns_02_walk(spark, DATA)) == {(b, p, *model(inodes, dirents, b, p)) for b, p in paths}
