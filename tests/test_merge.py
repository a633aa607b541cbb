"""The query of versions merges later snapshots into a written dimension."""

from datetime import datetime

from cairn.operators import versions
from tests.conftest import as_set


def test_later_snapshots_are_merged(rows, monkeypatch):
    at, calls, real = datetime(2025, 1, 1), [], versions.merge_versions
    monkeypatch.setattr(versions, "merge_versions", lambda current, *rest: calls.append(current is None) or real(current, *rest))
    snapshots = rows("bucket string, epoch bigint, created_ns bigint, loaded_at timestamp", *[("x", e, e, at) for e in (1, 3, 4, 7)], ("y", 2, 2, at))
    # 1 never changes, 2 changes in the first half, 3 where the halves meet, 4 in the second; 5 goes and returns, 6 ends with the first half, 7 comes with the second
    held = {1: {1: 8, 3: 8, 4: 8, 7: 8}, 2: {1: 8, 3: 9, 4: 9, 7: 9}, 3: {1: 8, 3: 8, 4: 9, 7: 9}, 4: {1: 8, 3: 8, 4: 8, 7: None}, 5: {1: 8, 4: 8, 7: 8}, 6: {1: 8, 3: 8}, 7: {4: 8, 7: 8}}
    inodes = rows("bucket string, epoch bigint, id bigint, gen bigint, size bigint, mode int, loaded_at timestamp", *[("x", e, i, 0, size, 420, at) for i, by in held.items() for e, size in by.items()], ("y", 2, 1, 0, 5, 420, at))
    got = as_set(versions.inode_versions(snapshots, inodes), "bucket", "id", "size", "valid_from", "valid_to")
    assert calls == [True, False]
    assert got == {("x", 1, 8, 1, -1), ("x", 2, 8, 1, 3), ("x", 2, 9, 3, -1), ("x", 3, 8, 1, 4), ("x", 3, 9, 4, -1), ("x", 4, 8, 1, 7), ("x", 4, None, 7, -1),
                   ("x", 5, 8, 1, 3), ("x", 5, 8, 4, -1), ("x", 6, 8, 1, 4), ("x", 7, 8, 4, -1), ("y", 1, 5, 2, -1)}
