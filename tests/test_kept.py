"""The mark starts from every snapshot that is kept, so the sweep spares what older ones refer to."""

import glob
import os

import duckdb
import pytest

from cairn.plans import reference
from tests.conftest import as_set

DATA = "/root/testdata/sf0.001"
A, B, C, D = ("{:064x}".format(i) for i in (10, 11, 12, 13))


def test_sweep_spares_older_snapshots(rows, tmp_path):
    # epoch 1 is pruned, 2 is kept, 3 is the newest; bucket y has only its newest, marked as pruned
    rows("bucket string, epoch bigint, pruned_ns bigint", ("x", 1, 9), ("x", 2, None), ("x", 2, None), ("x", 3, None), ("y", 5, 9)).write.parquet(f"{tmp_path}/snapshots.parquet")
    rows("bucket string, epoch bigint, hash string", ("x", 1, A), ("x", 2, "sha256:" + B.upper()), ("x", 3, C), ("x", 3, None), ("y", 5, D)).write.parquet(f"{tmp_path}/chunk_refs.parquet")
    rows("hash string, len bigint, stored_ns bigint, deleted_ns bigint", *[(h, 7, 1, None) for h in (A, B, C, D)]).write.parquet(f"{tmp_path}/chunks.parquet")
    spark = rows("x int", (1,)).sparkSession
    assert as_set(reference.cmt_17_mark(spark, str(tmp_path))) == {(B,), (C,), (D,)}
    assert as_set(reference.cmt_18_sweep(spark, str(tmp_path)), "hash") == {(A,)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_mark_and_sweep_of_all_kept_snapshots(spark):
    duck = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    plain = r"lower(regexp_replace(trim(hash), '^(chunks/|sha256:)\s*', '', 'i'))"
    marked = f"SELECT DISTINCT {plain} AS h FROM chunk_refs SEMI JOIN (SELECT bucket, epoch FROM snapshots WHERE pruned_ns IS NULL UNION SELECT bucket, max(epoch) FROM snapshots GROUP BY bucket) USING (bucket, epoch) WHERE regexp_full_match({plain}, '[0-9a-f]{{64}}')"
    swept = f"SELECT DISTINCT {plain}, len, stored_ns FROM chunks WHERE deleted_ns IS NULL AND stored_ns < 1745000000000000000 AND {plain} NOT IN ({marked})"
    assert as_set(reference.cmt_17_mark(spark, DATA)) == set(duck.execute(marked).fetchall())
    assert as_set(reference.cmt_18_sweep(spark, DATA)) == set(duck.execute(swept).fetchall())
