"""Runs of renames: those of files go together, those of directories in their order."""

import random

from cairn.operators import mutations as M
from tests.test_mutations import Tree, namespace, request


def test_runs_of_renames(rows):
    rng, tree, asked, want = random.Random(1), Tree(), [], []
    for d, name, op in ((1, "p", "mkdir"), (1, "q", "mkdir"), *((1, f"f{k}", "create") for k in range(6)), *((1, f"g{k}", "create") for k in range(3))):
        want.append((len(asked), tree.make(d, name, 2 if op == "mkdir" else 1, False)))
        asked.append(request(seq=len(asked), op=op, dir_id=d, name=name))
    names = ["p", "q", *(f"f{k}" for k in range(6)), *(f"g{k}" for k in range(3)), "n"]
    for _ in range(9):
        d, to, old, new = rng.choice([1, 1, 2, 3]), rng.choice([1, 2, 3]), rng.choice(names), rng.choice(names)
        want.append((len(asked), tree.move(d, old, to, new)))
        asked.append(request(seq=len(asked), op="rename", dir_id=d, name=old, to_dir=to, to_name=new))
    after, got = M.apply_requests(namespace(rows), rows(M.REQUESTS, *asked), 1000)
    assert sorted((r.seq, r.status) for r in got.collect()) == want
    assert {(r.dir_id, r.name, r.child_id) for r in after.dirents.collect()} == {(d, n, i) for d, es in tree.entries.items() for n, i in es.items()}
    assert {(r.id, r.type, r.parent, r.nlink) for r in after.inodes.collect()} == {(i, k, tree.parent[i], tree.links[i]) for i, k in tree.kind.items()}


def test_a_thousand_file_renames_are_one_pass(rows, monkeypatch):
    asked = [request(seq=k, op="create", dir_id=1, name=f"a{k}") for k in range(1000)] + [request(seq=1000 + k, op="rename", dir_id=1, name=f"a{k}", to_dir=1, to_name=f"b{k}") for k in range(1000)]
    passes, real = [], M._apply_wave
    monkeypatch.setattr(M, "_apply_wave", lambda *a: passes.append(1) or real(*a))
    after, got = M.apply_requests(namespace(rows), rows(M.REQUESTS, *asked), 1000)
    assert got.filter("status <> 0").count() == 0 and {r.name for r in after.dirents.collect()} == {f"b{k}" for k in range(1000)}
    assert len(passes) == 2
