"""Ordered changes against a tree in plain Python."""

import random

from cairn.functions import status as S
from cairn.operators import mutations as M
from tests.conftest import as_set

COLUMNS = [c.split()[0] for c in M.REQUESTS.split(", ")]


class Tree:
    def __init__(self):
        self.kind, self.entries, self.parent, self.links, self.next = {1: 2}, {1: {}}, {1: 1}, {1: 2}, 2

    def make(self, d, name, kind, exclusive):
        if d not in self.kind:
            return S.STALE
        if self.kind[d] != 2:
            return S.NOTDIR
        old = self.entries[d].get(name)
        if old:
            return S.EXIST if kind != 1 or exclusive or self.kind[old] == 2 else S.OK
        i, self.next = self.next, self.next + 1
        self.kind[i], self.parent[i], self.links[i] = kind, d, 2 if kind == 2 else 1
        self.entries[d][name] = i
        if kind == 2:
            self.entries[i] = {}
            self.links[d] += 1
        return S.OK

    def drop(self, i, d):
        if self.kind[i] == 2:
            self.links[d] -= 1
            del self.entries[i]
        del self.kind[i]

    def cut(self, d, name, want_dir):
        if d not in self.kind:
            return S.STALE
        if self.kind[d] != 2:
            return S.NOTDIR
        i = self.entries[d].get(name)
        if not i:
            return S.NOENT
        if want_dir != (self.kind[i] == 2):
            return S.NOTDIR if want_dir else S.ISDIR
        if want_dir and self.entries[i]:
            return S.NOTEMPTY
        del self.entries[d][name]
        self.drop(i, d)
        return S.OK

    def move(self, d, name, to, new):
        if d not in self.kind or to not in self.kind:
            return S.STALE
        if self.kind[d] != 2 or self.kind[to] != 2:
            return S.NOTDIR
        i = self.entries[d].get(name)
        if not i:
            return S.NOENT
        at = to
        while self.kind[i] == 2:
            if at == i:
                return S.INVAL
            if at == 1:
                break
            at = self.parent[at]
        v = self.entries[to].get(new)
        if v == i:
            return S.OK
        if v:
            if self.kind[v] == 2 and self.kind[i] != 2:
                return S.ISDIR
            if self.kind[v] != 2 and self.kind[i] == 2:
                return S.NOTDIR
            if self.kind[v] == 2 and self.entries[v]:
                return S.NOTEMPTY
            self.drop(v, to)
        del self.entries[d][name]
        self.entries[to][new] = i
        self.parent[i] = to
        if self.kind[i] == 2 and d != to:
            self.links[d] -= 1
            self.links[to] += 1
        return S.OK


def request(**v):
    return tuple(({"bucket": "b", "uid": 0, "gid": 0, "gids": []} | v).get(c) for c in COLUMNS)


def namespace(rows):
    inodes = rows("bucket string, id bigint, gen bigint, type int, mode int, uid bigint, gid bigint, nlink bigint, size bigint, atime_ns bigint, mtime_ns bigint, ctime_ns bigint, parent bigint, target string", ("b", 1, 1, 2, 0o755, 0, 0, 2, 0, 1, 1, 1, 1, None))
    return M.Namespace(inodes, rows("bucket string, dir_id bigint, name string, child_id bigint").limit(0), rows("bucket string, next_ino bigint", ("b", 2)))


def test_tree_model(rows):
    rng, tree, asked, want = random.Random(5), Tree(), [], []
    for seq in range(9):
        d, name = rng.choice([1, 1, 1, *[i for i in tree.kind]]), rng.choice("abc")
        op = rng.choice(["mkdir", "mkdir", "create", "symlink", "remove", "rmdir", "rename"])
        if op in ("mkdir", "create", "symlink"):
            ex = rng.random() < 0.5
            want.append((seq, tree.make(d, name, {"mkdir": 2, "create": 1, "symlink": 5}[op], ex)))
            asked.append(request(seq=seq, op=op, dir_id=d, name=name, exclusive=ex, target="t"))
        elif op == "rename":
            to, new = rng.choice([1, *[i for i in tree.kind]]), rng.choice("abc")
            want.append((seq, tree.move(d, name, to, new)))
            asked.append(request(seq=seq, op=op, dir_id=d, name=name, to_dir=to, to_name=new))
        else:
            want.append((seq, tree.cut(d, name, op == "rmdir")))
            asked.append(request(seq=seq, op=op, dir_id=d, name=name))
    after, got = M.apply_requests(namespace(rows), rows(M.REQUESTS, *asked), 1000)
    assert sorted((r.seq, r.status) for r in got.collect()) == want
    paths = lambda edges, kinds: {(p, kinds[i]) for p, i in walk(edges)}

    def walk(edges, at=1, path=""):
        for name, i in edges.get(at, {}).items():
            yield f"{path}/{name}", i
            yield from walk(edges, i, f"{path}/{name}")

    edges = {}
    for r in after.dirents.collect():
        edges.setdefault(r.dir_id, {})[r.name] = r.child_id
    kinds = {r.id: r.type for r in after.inodes.collect()}
    assert paths(edges, kinds) == paths(tree.entries, tree.kind)
    links = {p: n for p, n in ((p, {r.id: r.nlink for r in after.inodes.collect()}[i]) for p, i in walk(edges))}
    assert links == {p: tree.links[i] for p, i in walk(tree.entries)} and len(kinds) == len(tree.kind)


def test_attributes_and_refusals(rows):
    asked = rows(
        M.REQUESTS, request(seq=1, op="create", dir_id=1, name="f", new_mode=0o640, new_gid=7, new_uid=9), request(seq=2, op="setattr", id=2, new_mode=0o100600, new_mtime_ns=5), request(seq=3, op="setattr", id=2, uid=5, gid=5, new_mode=0),
        request(seq=4, op="setattr", id=2, guard_ns=1, new_mode=0), request(seq=5, op="mkdir", dir_id=1, name=".."), request(seq=6, op="mkdir", dir_id=1, name="x" * 256), request(seq=7, op="create", dir_id=1, name="g", new_size=2**60),
        request(seq=8, op="symlink", dir_id=1, name="s", target=""), request(seq=9, op="mkdir", dir_id=1, name="d", uid=5, gid=5), request(seq=10, op="mknod", dir_id=1, name="d"), request(seq=11, op="remove", dir_id=99, name="d"))
    after, got = M.apply_requests(namespace(rows), asked, 1000)
    assert {r.seq: r.status for r in got.collect()} == {1: 0, 2: 0, 3: S.PERM, 4: S.NOT_SYNC, 5: S.INVAL, 6: S.NAMETOOLONG, 7: S.FBIG, 8: S.INVAL, 9: S.ACCES, 10: S.SERVERFAULT, 11: S.STALE}
    assert as_set(after.inodes.filter("id = 2"), "mode", "uid", "gid", "mtime_ns") == {(0o600, 9, 7, 5)}
    _, closed = M.apply_requests(namespace(rows), asked.limit(1), 1000, mode="ReadOnly")
    assert [r.status for r in closed.collect()] == [S.ROFS]
    assert M.apply_requests(namespace(rows), M.empty_requests(asked.sparkSession), 1)[1].count() == 0
