"""Repeated requests on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS, ENTRIES = 120, 4096
# Procedures of the file protocol whose repetition changes nothing.
IDEMPOTENT = ("NULL", "GETATTR", "LOOKUP", "ACCESS", "READLINK", "READ", "WRITE", "READDIR", "READDIRPLUS", "FSSTAT", "FSINFO", "PATHCONF", "COMMIT")
KEY = ("conn", "xid", "prog", "vers", "proc")


def is_idempotent(proc: Column) -> Column:
    return proc.isin(*IDEMPOTENT)


def suppress_repeats(requests: DataFrame, ts: str = "ts", key: tuple[str, ...] = KEY, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The requests that are executed: a key seen within the watermark is dropped.

    By event time and without a bound on entries, so near to the cache, not it.
    """
    return requests.withWatermark(ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(list(key))


class ReplyCache(StatefulProcessor):
    """One connection's cache: miss, in flight or hit for each event, in order.

    Events are begin and finish of a request. A finished reply is held for the
    time to live from its finish, which a hit does not renew; of more than the
    bound the first finished goes; one in flight is never evicted.
    """

    def __init__(self, ttl_seconds: float = TTL_SECONDS, entries: int = ENTRIES):
        self.ttl, self.entries = ttl_seconds, entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("replies", "xid long, prog long, vers long, proc string", "finished double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = {k: v[0] for k, v in self.state.iterator()}
        out = [(key[0], int(r.seq), replay(held, (int(r.xid), int(r.prog), int(r.vers), r.proc), r.event, r.ts.timestamp(), self.ttl, self.entries)) for r in batch.itertuples()]
        for k, _ in list(self.state.iterator()):
            if k not in held:
                self.state.removeKey(k)
        for k, v in held.items():
            self.state.updateValue(k, (v,))
        yield pd.DataFrame([o for o in out if o[2]], columns=["conn", "seq", "verdict"])

    def close(self) -> None:
        pass


def replay(held: dict, key: tuple, event: str, now: float, ttl: float, entries: int) -> str | None:
    """One event of a cache; held maps key to the time of its finish, -1 in flight. The verdict of a begin, None of a finish.

    A finish ends what is in flight; one of a request that was answered from the
    cache renews nothing.
    """
    if event == "finish":
        if held.get(key, 0) < 0:
            held.pop(key)
            held[key] = now
            done = [k for k, v in held.items() if v >= 0]
            for k in done[: max(0, len(held) - entries)]:
                del held[k]
        return None
    for k in [k for k, v in held.items() if 0 <= v <= now - ttl]:
        del held[k]
    if key not in held:
        held[key] = -1.0
        return "miss"
    return "in flight" if held[key] < 0 else "hit"


def classify(events: DataFrame, ttl_seconds: float = TTL_SECONDS, entries: int = ENTRIES) -> DataFrame:
    """(conn, seq, verdict) of a stream of events (conn, xid, prog, vers, proc, seq, ts, event); idempotent requests pass by."""
    stateful = events.filter(~is_idempotent(F.col("proc")))
    return stateful.groupBy("conn").transformWithStateInPandas(ReplyCache(ttl_seconds, entries), "conn string, seq long, verdict string", "append", "None")


def repeats(requests: DataFrame, keys: list[str], ts: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Batch form: requests with ``repeat``, whether one of the same keys came within the time to live before."""
    from pyspark.sql import Window

    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, *[c for c in requests.columns if c not in (*keys, ts)]))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return requests.withColumn("repeat", F.coalesce(gap < ttl_seconds * 1_000_000, F.lit(False)))


def verdicts(events: DataFrame, conn: list[str], key: list[str], ttl_seconds: float = TTL_SECONDS, entries: int = ENTRIES) -> DataFrame:
    """Batch form of classify: (conn…, key…, seq, verdict) of each begin of a log (conn…, key…, ts, seq, event).

    A connection's events pass in order of time, of equal times a finish before a
    begin; a task holds one connection's cache, which has at most ``entries``
    finished replies, never a log.
    """
    columns = [*conn, *key]
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        at, held = None, {}
        for pdf in batches:
            said = []
            for row in zip(*[pdf[c] for c in columns], pdf["event"], pdf["_at"]):
                if row[: len(conn)] != at:
                    at, held = row[: len(conn)], {}
                said.append(replay(held, row[len(conn) : -2], row[-2], row[-1], ttl_seconds * 1_000_000, entries))
            out = pd.DataFrame({**{c: pdf[c] for c in columns}, "seq": pdf["seq"], "verdict": said})
            yield out[out["verdict"].notna()]

    order = F.when(F.col("event") == "finish", 0).otherwise(1).alias("_o")
    ordered = events.select(*columns, "seq", "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), order).repartition(*conn).sortWithinPartitions(*conn, "_at", "_o", "seq")
    return ordered.drop("_o").mapInPandas(run, f"{kinds}, seq bigint, verdict string")
