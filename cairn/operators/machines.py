"""State machines as edge tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The edges of the mount mode and of what is known of the root pointer.
MOUNT_MODE = (("Writable", "Diverge", "Diverged"),)
ROOT_KNOWLEDGE = (("Known", "SwapOK", "Known"), ("Known", "SwapUnknown", "InDoubt"), ("InDoubt", "ProbeOurs", "Known"), ("InDoubt", "ProbeUnchanged", "Known"))


@dataclass(frozen=True)
class Machine:
    """(from, on) → to; two edges for one pair are refused."""

    name: str
    edges: tuple[tuple[str, str, str], ...]

    def __post_init__(self):
        if len({(a, b) for a, b, _ in self.edges}) != len(self.edges):
            raise ValueError(f"{self.name}: two edges leave one state on one event")

    def next(self, state: Column, event: Column) -> Column:
        """The state an event leads to; null if it is not allowed."""
        if not self.edges:
            return F.lit(None).cast("string")
        out = None
        for a, on, b in self.edges:
            out = (F if out is None else out).when((state == a) & (event == on), b)
        return out

    def states(self, *more: str) -> list[str]:
        return sorted({x for a, _, b in self.edges for x in (a, b)} | set(more))

    def run(self, log: DataFrame, keys: list[str], order: list[str], event: str, start: str) -> DataFrame:
        """(keys…, state, refused) after each key's events in order; one not allowed leaves the state and is counted.

        The log is cut into ranges of (keys, order), so the log of one key may lie
        in many tasks. Each folds its stretch from every state it could begin in,
        in constant memory; a key's stretches, few as they are, are then joined in
        their order. Null keys are a key, null events are never allowed.
        """
        states, moves = self.states(start), {(a, on): b for a, on, b in self.edges}
        kinds = ", ".join(f"{k} {log.schema[k].dataType.simpleString()}" for k in keys)
        columns = [*keys, "_part", "_from", "_to", "_refused"]

        def fold(batches):
            part, at, now = TaskContext.get().partitionId(), None, []
            for pdf in batches:
                out = []
                for *own, on in zip(*[pdf[k] for k in keys], pdf[event]):
                    own = [None if pd.isna(x) else x for x in own]
                    if own != at:
                        out += [(*at, part, s, *n) for s, n in zip(states, now)] if at is not None else []
                        at, now = own, [[s, 0] for s in states]
                    for n in now:
                        to = moves.get((n[0], on))
                        if to is None:
                            n[1] += 1
                        else:
                            n[0] = to
                yield pd.DataFrame(out, columns=columns)
            if at is not None:
                yield pd.DataFrame([(*at, part, s, *n) for s, n in zip(states, now)], columns=columns)

        ranged = log.select(*keys, *order, event).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        moved = ranged.select(*keys, event).mapInPandas(fold, f"{kinds}, _part int, _from string, _to string, _refused int")
        stretch = moved.groupBy(*keys, "_part").agg(F.map_from_entries(F.collect_list(F.struct("_from", F.struct(F.col("_to").alias("state"), F.col("_refused").alias("refused"))))).alias("_m"))
        joined = lambda acc, x: F.struct(x["_m"][acc["state"]]["state"].alias("state"), (acc["refused"] + x["_m"][acc["state"]]["refused"]).alias("refused"))
        whole = F.aggregate(F.array_sort(F.collect_list(F.struct("_part", "_m")), lambda a, b: a["_part"] - b["_part"]), F.struct(F.lit(start).alias("state"), F.lit(0).alias("refused")), joined)
        return stretch.groupBy(*keys).agg(whole.alias("_s")).select(*keys, "_s.*")

    def stream(self, log: DataFrame, keys: list[str], event: str, start: str) -> DataFrame:
        """(keys…, event, state, allowed) of each event of a stream: a key's state has one writer, so no two events race."""
        kinds = ", ".join(f"{k} {log.schema[k].dataType.simpleString()}" for k in keys)
        return log.groupBy(*keys).transformWithStateInPandas(_Fire(self, keys, event, start), f"{kinds}, {event} string, state string, allowed boolean", "append", "None")

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.edges) or [], "from_state string, event string, to_state string").withColumn("machine", F.lit(self.name))


class _Fire(StatefulProcessor):
    def __init__(self, machine: Machine, keys: list[str], event: str, start: str):
        self.moves, self.keys, self.event, self.start = {(a, on): b for a, on, b in machine.edges}, keys, event, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues):
        now = self.state.get()[0] if self.state.exists() else self.start
        for pdf in rows:
            states, allowed = [], []
            for on in pdf[self.event]:
                to = self.moves.get((now, on))
                now = now if to is None else to
                states.append(now)
                allowed.append(to is not None)
            yield pd.DataFrame({**{k: [v] * len(pdf) for k, v in zip(self.keys, key)}, self.event: pdf[self.event], "state": states, "allowed": allowed})
        self.state.update((now,))

    def close(self) -> None:
        pass


def machines() -> Iterable[Machine]:
    return Machine("mode", MOUNT_MODE), Machine("rootKnowledge", ROOT_KNOWLEDGE)


def _verdicts(found, fresh, failed, understood, ours, same, tagged) -> list:
    """What a read of the root pointer shows, the first that holds; for columns and for plain truth values alike."""
    return [(~found & fresh, "Unchanged"), (~found, "Theirs"), (failed, "Failed"), (~understood, "Failed"), ((ours | same) & ~tagged, "Failed"), (ours, "Ours"), (same, "Unchanged")]


def classify_root(found: Column, failed: Column, version: Column, snapshot: Column, etag: Column, known: Column, doubt: Column) -> Column:
    """What a read of the root pointer shows of an attempt in doubt: Ours, Unchanged, Theirs or Failed.

    No pointer is Unchanged where none was known, else Theirs. A pointer that
    cannot be read or has another version is Failed, as is one of ours or the
    known one without an ETag.
    """
    no = lambda c: F.coalesce(c, F.lit("")) == ""
    understood = F.coalesce(version, F.lit(0)).cast("int").eqNullSafe(F.lit(1)) & ~no(snapshot)
    out = F
    for holds, verdict in _verdicts(found, no(known), failed, understood, F.coalesce(snapshot == doubt, F.lit(False)), F.coalesce(snapshot == known, F.lit(False)), ~no(etag)):
        out = out.when(holds, verdict)
    return out.otherwise("Theirs")


def classify_reading(found: bool, failed: bool, root: object, etag: str, known: str, doubt: str) -> str:
    """classify_root of one reading: ``root`` is its decoded body."""
    body = root if isinstance(root, dict) else {}
    snapshot = body.get("snapshot") or ""
    cases = (found, not known, failed, body.get("version") == 1 and bool(snapshot), snapshot == doubt, snapshot == known, bool(etag))
    return next((verdict for holds, verdict in _verdicts(*map(np.bool_, cases)) if holds), "Theirs")


def store_error(status: Column, code: Column) -> Column:
    """The class of a store's reply: NotFound, Precondition, Unsupported, or Other."""
    return (
        F.when((status == 404) | code.isin("NoSuchKey", "NoSuchBucket"), "NotFound")
        .when(status.isin(412, 409) | code.isin("PreconditionFailed", "ConditionalRequestConflict"), "Precondition")
        .when(status == 501, "Unsupported").otherwise("Other")
    )
