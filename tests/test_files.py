"""Chunks, reads, writes, truncation and extents against plain bytes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import attributes as A
from cairn.operators import filedata as D
from tests.conftest import as_set

CS = 16


def test_dedup_and_empty_files(rows):
    files = rows("id bigint, data binary, idx string", (1, b"x" * CS, "q"), (2, b"x" * CS, "q"), (3, b"x" * CS + b"y", "q"), (4, b"", "q"), (5, None, "q"))
    cut = D.chunk_files(files, ["id"], "data", CS)
    assert as_set(cut.select("id", "idx", "size")) == {(1, 0, 16), (2, 0, 16), (3, 0, 16), (3, 1, 1)}
    assert D.stored_chunks(cut).count() == 2 and D.stored_chunks(cut, D.stored_chunks(cut)).count() == 0
    assert as_set(D.dedup_report(cut)) == {(hashlib.sha256(b"x" * CS).hexdigest(), 3, 16)}


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_model(spark, rows, seed):
    """Writes, truncation and growth of one file with trims that wait, read back after each."""
    rng, keys = random.Random(seed), ["bucket", "id"]
    model = bytearray(rng.randbytes(3 * CS))
    key = F.lit("b").alias("bucket"), F.lit(1).cast("bigint").alias("id")
    cut = D.chunk_files(rows("data binary", (bytes(model),)).select(*key, "data"), keys, "data", CS)
    fix = lambda df: spark.createDataFrame(df.collect(), df.schema)
    refs, chunks = fix(cut.select(*keys, "idx", "hash", "size")), fix(D.stored_chunks(cut))
    for _ in range(4):
        if rng.random() < 0.5:
            ops = [(s, rng.randrange(len(model) + 9), rng.randbytes(rng.randrange(1, 2 * CS))) for s in range(3)]
            for _, off, data in ops:
                model[len(model):] = bytes(max(0, off + len(data) - len(model)))
                model[off : off + len(data)] = data
            dirty = fix(D.apply_writes(rows("seq int, off bigint, data binary", *ops).select(*key, "seq", "off", "data"), refs, chunks, keys, CS))
            refs, up = D.flush(dirty, refs, keys, chunks)
            refs, chunks = fix(refs), fix(chunks.unionByName(up))
        else:
            new = rng.randrange(4 * CS)
            cuts = rows("old_size bigint, new_size bigint", (len(model), new)).select(*key, "old_size", "new_size")
            refs, trims = D.truncate(refs, cuts, keys, CS)
            refs, trims = fix(refs), D.least_trims(trims, trims, keys=keys)
            del model[new:]
            model[len(model):] = bytes(new - len(model))
            # the cut is applied: the trimmed chunk is written anew before anything else
            kept = fix(trims.join(refs, [*keys, "idx"]).join(chunks, "hash").select(*keys, "idx", F.substring("data", F.lit(1), F.col("to_len").cast("int")).alias("data")))
            asked = [(k, rng.randrange(4 * CS + 4), rng.randrange(3 * CS)) for k in range(6)]
            reads = rows("req int, off bigint, count bigint", *asked).select("req", *key, F.lit(len(model)).cast("bigint").alias("size"), "off", "count")
            for r in D.read_ranges(reads, refs, chunks, CS, trims).collect():
                assert bytes(r.data) == bytes(model[r.off : r.off + r["count"]]) and r.status == 0
            if kept.count():
                refs, up = D.flush(kept, refs, keys, chunks)
                refs, chunks = fix(refs), fix(chunks.unionByName(up))
        asked = [(k, rng.randrange(len(model) + 4), rng.randrange(3 * CS)) for k in range(6)]
        reads = rows("req int, off bigint, count bigint", *asked).select("req", *key, F.lit(len(model)).cast("bigint").alias("size"), "off", "count")
        for r in D.read_ranges(reads, refs, chunks, CS).collect():
            assert bytes(r.data) == bytes(model[r.off : r.off + r["count"]]) and r.eof == (r.off >= len(model) or r.off + r["count"] >= len(model))


def test_lost_chunk_fails_the_read(rows):
    refs = rows("bucket string, id bigint, idx int, hash string", ("b", 1, 0, "gone"), ("b", 2, 0, None))
    asked = rows("req int, bucket string, id bigint, size bigint, off bigint, count bigint", (1, "b", 1, 9, 0, 9), (2, "b", 2, 9, 0, 9), (3, "b", 2, 9, 9, 1))
    got = {r.req: (r.data and bytes(r.data), r.eof, r.status) for r in D.read_ranges(asked, refs, rows("hash string, data binary").limit(0), CS).collect()}
    assert got[1] == (None, True, 5) and got[2] == (bytes(9), True, 0) and got[3][1:] == (True, 0) and not got[3][0]


def test_extents_holes_and_clones(rows):
    refs = rows("bucket string, id bigint, idx int, hash string, size bigint", *[("b", 1, k, h, 16) for k, h in enumerate(["a", "b", None, None, "c"])])
    assert as_set(D.extents(refs, ["bucket", "id"]), "off", "len", "hole") == {(0, 32, False), (32, 32, True), (64, 16, False)}
    holed = D.punch(refs, rows("bucket string, id bigint, off bigint, len bigint", ("b", 1, 10, 30)), ["bucket", "id"], CS)
    assert {r.idx for r in holed.collect() if r.hash is None} == {1, 2, 3}
    clones = rows("bucket string, src_id bigint, src_idx int, n int, dst_id bigint, dst_idx int", ("b", 1, 1, 2, 7, 5), ("b", 1, 3, 9, 8, 0), ("b", 1, 0, 3, 1, 1))
    assert as_set(D.clone_range(refs, clones), "id", "idx", "hash") == {(7, 5, "b"), (7, 6, None)}
    assert as_set(D.unpinned(rows("bucket string, id bigint", ("b", 1), ("b", 2)), rows("bucket string, id bigint", ("b", 2)))) == {("b", 1)}


def test_write_limits_and_hashes(rows):
    code, taken = D.write_status(F.col("off"), F.col("n"), F.lit(100))
    assert [tuple(r) for r in rows("off int, n int", (0, 0), (100, 1), (90, 20), (999, 0)).select(code, taken).collect()] == [(0, 0), (27, 0), (0, 10), (0, 0)]
    got = rows("b binary", (b"",), (b"a",), (b"foobar",), (None,)).select(A.fnv1a64(F.col("b")).alias("h")).collect()
    assert [r.h and bytes(r.h).hex() for r in got] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", None]
    ids = rows("i bigint, g bigint", (1, 2**62), (2**40, -1)).select(F.hex(A.handle(F.col("i"), F.col("g"))).alias("h")).collect()
    assert [r.h for r in ids] == ["0000000000000001" + "4000000000000000", "0000010000000000" + "F" * 16]
