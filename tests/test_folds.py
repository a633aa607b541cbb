"""State machines over long logs and on streams, replies of large directories, settled and resized files."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import filedata as D
from cairn.operators import machines as M
from cairn.operators import mutations as U
from cairn.operators import namespace as N
from cairn.operators import retention as R
from cairn.streaming import replies
from tests.conftest import as_set

MACHINE = M.Machine("m", (("a", "go", "b"), ("b", "go", "c"), ("c", "back", "a"), ("b", "back", "a")))


def plain(events, start):
    moves, now, refused = {(a, on): b for a, on, b in MACHINE.edges}, start, 0
    for on in events:
        if (now, on) in moves:
            now = moves[now, on]
        else:
            refused += 1
    return now, refused


def test_a_hot_log_is_folded_in_pieces(rows):
    rng = random.Random(1)
    logs = {k: [rng.choice(["go", "back", "odd", None]) for _ in range(n)] for k, n in ((1, 700), (2, 3), (None, 20))}
    data = [(k, i, on, "x") for k, es in logs.items() for i, on in enumerate(es)]
    rng.shuffle(data)
    df = rows("k bigint, seq bigint, on string, state string", *data)
    got = MACHINE.run(df.repartition(7), ["k"], ["seq"], "on", "a")
    assert as_set(got) == {(k, *plain(es, "a")) for k, es in logs.items()}
    assert MACHINE.run(df.limit(0), ["k"], ["seq"], "on", "a").count() == 0
    assert as_set(M.Machine("none", ()).run(df, ["k"], ["seq"], "on", "z").select("k", "state")) == {(k, "z") for k in logs}


def test_a_stream_keeps_state_between_batches(spark, tmp_path):
    events = [("x", "go"), ("x", "odd"), ("x", "go"), ("x", "back"), ("y", "back")]
    for n, part in enumerate((events[:2], events[2:])):
        spark.createDataFrame(part, "k string, on string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("k string, on string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "fired"
    query = MACHINE.stream(stream, ["k"], "on", "a").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = [tuple(r) for r in spark.table(name).filter("k = 'x'").collect()]
    assert [r[3] for r in rows].count(False) == 1 and len(rows) == 4 and rows[-1][1:] in {("back", "a", True), ("go", "c", True)}


def test_pages_of_a_directory_show_every_name_once(rows):
    names = sorted(f"n{k:03d}" + "x" * (k % 7) for k in range(50))
    inodes = rows("bucket string, id bigint, type int, parent bigint", ("b", 1, 2, 1), *[("b", 10 + k, 1, 1) for k in range(50) if k != 7])
    dirents = rows("bucket string, dir_id bigint, name string, child_id bigint", *[("b", 1, n, 10 + k) for k, n in enumerate(names)])
    listed = N.listing(dirents, inodes)
    seen, after, pages = [], 0, 0
    while True:
        page = N.read_directory(listed, F.lit(after), 512).orderBy("cookie").collect()
        seen += [r.name for r in page]
        pages += 1
        assert page and sum(len(r.name) + 32 for r in page) <= 512
        after = page[-1].cookie
        if page[-1].eof:
            break
    assert seen == [".", "..", *[n for k, n in enumerate(names) if k != 7]] and pages > 3


@pytest.mark.parametrize("keep", [-1, 0, 2, 9])
def test_prunable(rows, keep):
    keys = [f"snapshots/{k}" for k in range(6)]
    got = as_set(R.prunable(rows("bucket string, key string", *[("a", k) for k in keys], ("a", keys[0])), rows("bucket string, current string", ("a", keys[4])), keep))
    below = [k for k in keys if k < keys[4]]
    assert got == {("a", k) for k in below[: len(below) - max(keep, 0)] if len(below) > max(keep, 0)}


def test_settle_applies_trims_and_buffers(rows):
    import hashlib

    h = lambda b: hashlib.sha256(b).hexdigest()
    body = {b: h(b) for b in (b"aaaa", b"bbbb", b"cccc")}
    refs = rows("f bigint, idx int, hash string, size bigint", (1, 0, body[b"aaaa"], 4), (1, 1, body[b"bbbb"], 4), (2, 0, body[b"cccc"], 4), (3, 0, None, 4))
    chunks = rows("hash string, data binary", *[(v, k) for k, v in body.items()])
    trims = rows("f bigint, idx int, to_len bigint", (1, 1, 3), (1, 1, 2), (2, 0, 1))
    dirty = rows("f bigint, idx int, data binary", (2, 0, b"new"), (4, 2, b"far"))
    got, upload = D.settle(refs, chunks, ["f"], dirty, trims)
    assert as_set(got) == {(1, 0, body[b"aaaa"], 4), (1, 1, h(b"bb"), 2), (2, 0, h(b"new"), 3), (3, 0, None, 4), (4, 0, None, 0), (4, 1, None, 0), (4, 2, h(b"far"), 3)}
    assert {r.hash for r in upload.collect()} == {h(b"bb"), h(b"new"), h(b"far")}


def test_extents_across_blocks(rows, monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 3)
    kinds = "ddhhhhhdddddddhd"
    refs = rows("f bigint, idx int, hash string, size bigint", *[(1, k, None if c == "h" else "x", 10 + k) for k, c in enumerate(kinds)], (None, 0, "y", 5))
    off = [sum(10 + j for j in range(k)) for k in range(len(kinds) + 1)]
    want = {(1, off[a], off[b] - off[a], kinds[a] == "h") for a, b in ((0, 2), (2, 7), (7, 14), (14, 15), (15, 16))}
    assert as_set(D.extents(refs, ["f"])) == want | {(None, 0, 5, False)}
    assert {(r.idx, r.start) for r in D.spans(refs.filter("f = 1"), ["f"]).collect()} == set(enumerate(off[:-1]))


def test_punched_edges(rows):
    data = bytes(range(1, 13))
    refs = rows("f bigint, idx int, hash string", (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, None))
    chunks = rows("hash string, data binary", ("a", data[:4]), ("b", data[4:8]), ("c", data[8:11]))
    holes = rows("f bigint, off bigint, len bigint", (1, 2, 8), (2, 1, 2), (1, 0, 0))
    assert {(r.f, r.idx): bytes(r.data) for r in D.punch_edges(refs, chunks, holes, ["f"], 4).collect()} == {(1, 0): b"\1\2\0\0", (1, 2): b"\0\0\x0b"}


def test_a_size_in_setattr_resizes_the_file(rows):
    node = lambda i, type_, size: ("b", i, 1, type_, 0o644 if type_ == 1 else 0o755, 5, 5, 1, size, 0, 0, 0, 1, None)
    inodes = rows("bucket string, id bigint, gen bigint, type int, mode int, uid bigint, gid bigint, nlink bigint, size bigint, atime_ns bigint, mtime_ns bigint, ctime_ns bigint, parent bigint, target string", node(1, 2, 0), node(2, 1, 10), node(3, 1, 4), node(4, 1, 8))
    dirents = rows("bucket string, dir_id bigint, name string, child_id bigint", ("b", 1, "x", 2), ("b", 1, "y", 3), ("b", 1, "z", 4))
    refs = rows("bucket string, id bigint, idx int, hash string, size bigint", *[("b", 2, k, f"h{k}", 4 if k < 2 else 2) for k in range(3)], ("b", 3, 0, "y", 4), *[("b", 4, k, "z", 4) for k in range(2)])
    ns = U.Namespace(inodes, dirents, rows("bucket string, next_ino bigint", ("b", 5)), refs)
    ask = lambda seq, **v: rows(U.REQUESTS, tuple({"bucket": "b", "seq": seq, "op": "setattr", "uid": 5, "gid": 5, "gids": []}.get(c, None) if c not in v else v[c] for c in (x.split(" ")[0] for x in U.REQUESTS.split(", "))))
    asked = [ask(1, id=2, new_size=5), ask(2, id=2, new_size=9, new_mtime_ns=7), ask(3, id=3, new_size=2, uid=6), ask(4, id=1, new_size=0), ask(5, id=3, new_size=2**60), ask(6, op="remove", dir_id=1, name="z")]
    union = asked[0]
    for a in asked[1:]:
        union = union.unionByName(a)
    after, got = U.apply_requests(ns, union, 1000, 4)
    assert as_set(got.select("seq", "status")) == {(1, 0), (2, 0), (3, 13), (4, 21), (5, 27), (6, 0)}
    assert as_set(after.refs.select("id", "idx", "hash")) == {(2, 0, "h0"), (2, 1, "h1"), (2, 2, None), (3, 0, "y")}
    assert as_set(after.trims.select("id", "idx", "to_len")) == {(2, 1, 1)}
    assert as_set(after.inodes.filter("id = 2").select("size", "mtime_ns", F.col("ctime_ns") > 1000)) == {(9, 7, True)}
    assert after.inodes.filter("id = 4").count() == 0


def test_settings_of_different_inodes_go_in_one_wave(rows):
    ask = lambda bucket, seq, op, **v: tuple({"bucket": bucket, "seq": seq, "op": op, "uid": 5, "gid": 5, "gids": []}.get(c, v.get(c)) for c in (x.split(" ")[0] for x in U.REQUESTS.split(", ")))
    halves = [ask("b", 100 * k + i, "setattr", id=i, new_size=i) for k in range(2) for i in range(20)]
    others = [ask("b", 200, "create", dir_id=1, name="new"), ask("b", 201, "setattr", id=3, new_size=1), ask("b", 202, "setattr", id=4, new_mode=0), ask("b", 203, "setattr", id=3, new_mode=0)]
    asked = rows(U.REQUESTS, *halves, *others, *[ask("c", i, "setattr", id=i, new_mode=0) for i in range(9)])
    got = as_set(U.waves(asked, rows("bucket string, next_ino bigint", ("b", 20), ("c", 9))).select("bucket", "seq", "wave"))
    assert got == {("b", 100 * k + i, k + 1) for k in range(2) for i in range(20)} | {("b", 200, 3), ("b", 201, 4), ("b", 202, 4), ("b", 203, 5)} | {("c", i, 1) for i in range(9)}


@pytest.mark.parametrize("adaptive", ["-1", "10m"])
def test_a_bucket_is_numbered_by_one_task(spark, adaptive):
    given = {"bucket": F.concat(F.lit("b"), F.col("id") % 50), "seq": F.floor(F.col("id") / 50), "op": F.lit("setattr"), "id": F.floor(F.col("id") / 50) % 20}
    asked = spark.range(0, 2000, 1, 8).select(*[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in (x.split(" ", 1) for x in U.REQUESTS.split(", "))])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": adaptive}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = U.waves(asked, asked.groupBy("bucket").agg((F.max("id") + 1).alias("next_ino")))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan[plan.index("MapInPandas"):]
        assert {(r.wave, r.half): r["count"] for r in got.groupBy("wave", F.floor(F.col("seq") / 20).alias("half")).count().collect()} == {(1, 0): 1000, (2, 1): 1000}
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_verdicts_from_finish(rows):
    log = [(1, "a", 0, 1, "begin"), (1, "a", 5, 2, "begin"), (1, "a", 9, 1, "finish"), (1, "a", 100, 3, "begin"), (1, "a", 128, 4, "begin"), (1, "a", 129, 5, "begin"), (1, "a", 130, 6, "begin"), (2, "a", 1, 7, "begin")]
    df = rows("conn bigint, k string, t bigint, seq bigint, event string", *log).select("conn", "k", "seq", "event", F.timestamp_seconds("t").alias("ts"))
    got = replies.verdicts(df, ["conn"], ["k"])
    assert as_set(got.select("seq", "verdict")) == {(1, "miss"), (2, "in flight"), (3, "hit"), (4, "hit"), (5, "miss"), (6, "in flight"), (7, "miss")}
    many = rows("conn bigint, k string, t bigint, seq bigint, event string", *[(1, c, n, n, e) for n, (c, e) in enumerate([("a", "begin"), ("a", "finish"), ("b", "begin"), ("b", "finish"), ("c", "begin"), ("c", "finish"), ("a", "begin"), ("c", "begin")])])
    got = replies.verdicts(many.select("conn", "k", "seq", "event", F.timestamp_seconds("t").alias("ts")), ["conn"], ["k"], entries=2)
    assert as_set(got.select("seq", "verdict")) == {(0, "miss"), (2, "miss"), (4, "miss"), (6, "miss"), (7, "hit")}
