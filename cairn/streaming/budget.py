"""The write budget: writes are admitted while what is buffered is below the limit, and charged afterwards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

LIMIT = 256 << 20


@dataclass
class Budget:
    """Readings and moves of one mount's budget."""

    limit: int = LIMIT
    used: int = 0
    waiters: int = 0
    drains: int = 0

    def admit(self, drain: Callable[[], None]) -> bool:
        """Wait for room: the first to find none drains; whether it had to."""
        if self.used < self.limit:
            return False
        self.waiters += 1
        try:
            drain()
            self.drains += 1
        finally:
            self.waiters -= 1
        return True

    def add(self, n: int) -> None:
        self.used += n

    def release(self, n: int) -> None:
        self.used = max(0, self.used - n)


def replay(writes: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """(keys…, seq, used, drained) of each mount's writes (keys…, seq, capacity) in order: a sum that a drain resets.

    Rows come sorted within their partition and are folded as they pass, so a
    mount of any length takes constant memory.
    """
    kinds = ", ".join(f"{k} {writes.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        at, used = None, 0
        for pdf in batches:
            out_used, out_drained = [], []
            for row in zip(*[pdf[k] for k in keys], pdf["capacity"]):
                if row[:-1] != at:
                    at, used = row[:-1], 0
                drained = used >= limit
                used = (0 if drained else used) + int(row[-1])
                out_used.append(used)
                out_drained.append(drained)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "seq": pdf["seq"], "used": out_used, "drained": out_drained})

    ordered = writes.select(*keys, "seq", "capacity").repartition(*keys).sortWithinPartitions(*keys, "seq")
    return ordered.mapInPandas(run, f"{kinds}, seq bigint, used bigint, drained boolean")


def paced(reader, files: int | None = None, bytes_: int | None = None):
    """A stream reader held to so much a trigger, as the budget holds writers."""
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.option("maxBytesPerTrigger", bytes_) if bytes_ else reader
