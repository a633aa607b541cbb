"""State machines, repeated requests, the write budget and the committing sink."""

import datetime

import pytest

from cairn.operators.commit import Committer
from cairn.operators.machines import MOUNT_MODE, Machine, machines
from cairn.sources.store import FolderStore
from cairn.streaming import budget, committer, replies
from tests.conftest import as_set


def test_machines(rows, spark):
    with pytest.raises(ValueError):
        Machine("m", (("a", "x", "b"), ("a", "x", "c")))
    m = Machine("mode", MOUNT_MODE)
    log = rows("k int, seq int, ev string", (1, 2, "Diverge"), (1, 1, "Other"), (2, 1, "Diverge"), (2, 2, "Diverge"), (3, 1, None))
    assert as_set(m.run(log, ["k"], ["seq"], "ev", "Writable")) == {(1, "Diverged", 1), (2, "Diverged", 1), (3, "Writable", 1)}
    assert sum(x.table(spark).count() for x in machines()) == 5


def test_reply_cache_rules():
    held, ask = {}, lambda xid, event, now: replies.replay(held, (xid,), event, now, 120, 2)
    assert ask(1, "begin", 0) == "miss" and ask(1, "begin", 500) == "in flight"
    ask(1, "finish", 500)
    assert ask(1, "begin", 619) == "hit" and ask(1, "begin", 621) == "miss"  # a hit renews nothing
    ask(1, "finish", 622)
    assert ask(2, "begin", 623) == "miss" and ask(3, "begin", 624) == "miss"
    ask(2, "finish", 625)
    assert ask(1, "begin", 626) == "miss" and ask(3, "begin", 626) == "in flight"  # the first finished went, not what is in flight


EVENTS = "conn string, xid bigint, prog bigint, vers bigint, proc string, seq bigint, ts timestamp, event string"


def ev(seq, xid, event, t, proc="CREATE", conn="c"):
    return (conn, xid, 1, 3, proc, seq, datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=t), event)


def test_reply_cache_on_a_stream(spark, rows, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [[ev(1, 1, "begin", 0), ev(2, 1, "begin", 1), ev(3, 9, "begin", 1, "READ")], [ev(4, 1, "finish", 2), ev(5, 1, "begin", 3), ev(6, 1, "begin", 130), ev(7, 1, "begin", 3, conn="d")]]
    out = []
    for k, b in enumerate(batches):
        rows(EVENTS, *b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = replies.classify(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
        q = stream.writeStream.foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(out, key=lambda r: r[1]) == [("c", 1, "miss"), ("c", 2, "in flight"), ("c", 5, "hit"), ("c", 6, "miss"), ("d", 7, "miss")]


def test_near_suppression_on_a_stream(spark, rows, tmp_path):
    rows(EVENTS, ev(1, 1, "begin", 0), ev(2, 1, "begin", 5), ev(3, 2, "begin", 5)).write.parquet(str(tmp_path / "in"))
    stream = replies.suppress_repeats(budget.paced(spark.readStream.schema(EVENTS), files=10).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.xid for r in spark.table("kept").collect()) == [1, 2]


def test_budget(rows):
    b = budget.Budget(10)
    assert not b.admit(lambda: None)
    b.add(12)
    assert b.admit(lambda: b.release(12)) and (b.used, b.waiters, b.drains) == (0, 0, 1)
    w = rows("k int, seq int, capacity bigint", *[(k, s, 4) for k in (1, 2) for s in range(5)])
    got = sorted((r.k, r.seq, r.used, r.drained) for r in budget.replay(w, ["k"], 10).collect())
    assert got == [(k, s, u, d) for k in (1, 2) for s, u, d in ((0, 4, False), (1, 8, False), (2, 12, False), (3, 4, True), (4, 8, False))]
    assert budget.replay(w.limit(0), ["k"], 10).count() == 0


def test_committing_sink(spark, rows, tmp_path):
    store = FolderStore(str(tmp_path / "bucket"))
    c = Committer(store)
    rows("name string", ("a",), ("b",)).write.parquet(str(tmp_path / "in"))

    def apply(doc, batch):
        names = [r.name for r in batch.collect()]
        doc["inodes"]["1"].setdefault("e", {}).update({n: 1 for n in names})
        return bool(names)

    for _ in range(2):
        stream = spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
        committer.commit_stream(stream, c, apply, str(tmp_path / "cp"), None).awaitTermination()
    assert set(Committer(store).namespace["inodes"]["1"]["e"]) == {"a", "b"} and c.epoch == 2


def test_lru_replay(rows):
    import random
    from collections import OrderedDict

    from cairn.operators import cache

    rng = random.Random(3)
    log = [(c, s, rng.choice(["a", "b", "c", "d", None]), rng.choice([4, 30])) for c in (1, 2) for s in range(40)]
    want = set()
    for c in (1, 2):
        held = OrderedDict()
        for _, s, key, size in [x for x in log if x[0] == c]:
            want.add((c, s, key in held))
            if key in held:
                held.move_to_end(key)
            elif key is not None and size <= 10:
                held[key] = size
                while sum(held.values()) > 10:
                    held.popitem(last=False)
    df = rows("c int, s int, key string, size bigint, hit string", *[(*x, "q") for x in log])
    assert as_set(cache.replay(df, ["c"], ["s"], 10)) == want and cache.replay(df.limit(0), ["c"], ["s"]).count() == 0
