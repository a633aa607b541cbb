"""Hot keys, and the operators with every inode taken for a hot one."""

import random

import pytest
from pyspark.sql import functions as F

from cairn import planning
from cairn.operators import changes, versions
from tests.conftest import as_set
from tests.test_found import INODE, REF, SNAP, H, at, inode, snap


def test_hot_keys(rows):
    df = rows("k bigint", *[(7,)] * 250, *[(8,)] * 101, *[(9,)] * 100, *[(None,)] * 500, *[(k,) for k in range(1000, 3000)])
    assert as_set(planning.hot_keys(df, "k", 100)) == {(7, 3), (8, 2)}
    assert planning.hot_keys(df.limit(0), "k", 100).count() == 0


@pytest.mark.parametrize("most", [0, 15])
def test_changes_and_versions_of_hot_inodes(rows, monkeypatch, most):
    rng = random.Random(most)
    s = rows(SNAP, *[snap("a", e) for e in range(1, 9)])
    data = [inode("a", e, i, size=rng.randrange(2), k=k) for e in range(1, 9) for i in (1, 2, 3) if rng.random() < 0.8 for k in range(rng.randrange(1, 4))]
    refs = [("a", e, i, k, H[rng.randrange(1, 3)], 1, at(0), "x", "x") for e in range(1, 9) for i in (1, 2) for k in range(6)]
    i, c = rows(INODE, *data, *data[:9]), rows(REF, *refs, *refs[:20])
    plain = as_set(changes.snapshot_changes(s, i, c)), as_set(versions.inode_versions(s, i))
    for module in (changes, versions):
        monkeypatch.setattr(module, "hot_groups", lambda df, *keys: planning.hot_groups(df, *keys, most=max(most, 1)))
    assert (as_set(changes.snapshot_changes(s, i, c)), as_set(versions.inode_versions(s, i))) == plain


def test_gather_keeps_rows_of_cold_groups(rows):
    df = rows("k bigint, v bigint", *[(1, v) for v in range(9)], (2, 5), (None, 1))
    got = planning.gather(df, ["k"], planning.hot_groups(df, "k", most=5), lambda x: x.groupBy("k").agg(F.max("v").alias("v")))
    assert as_set(got) == {(1, 8), (2, 5), (None, 1)}
