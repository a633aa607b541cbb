"""Exact replay of a byte-bounded cache over an access log."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame

BYTES = 256 << 20


def replay(log: DataFrame, keys: list[str], order: list[str], limit: int = BYTES) -> DataFrame:
    """readings without the bytes: (keys…, order…, hit)."""
    return readings(log, keys, order, limit).drop("used")


def readings(log: DataFrame, keys: list[str], order: list[str], limit: int = BYTES) -> DataFrame:
    """(keys…, order…, hit, used) of each access (keys…, order…, key, size) to a least-recently-used cache per keys.

    A hit refreshes; what is larger than the limit is not kept. Rows pass sorted,
    so a task holds one cache's names, never a log. Null keys never hit. ``used``
    are the bytes held after the access.
    """
    kinds = ", ".join(f"{c} {log.schema[c].dataType.simpleString()}" for c in [*keys, *order])

    def run(batches):
        at, held, used = None, OrderedDict(), 0
        for pdf in batches:
            hits, bytes_ = [], []
            for row in zip(*[pdf[k] for k in keys], pdf["key"], pdf["size"]):
                *own, key, size = row
                if own != at:
                    at, held, used = own, OrderedDict(), 0
                hit = key in held
                hits.append(hit)
                if hit:
                    held.move_to_end(key)
                elif key is not None and size <= limit:
                    held[key] = size
                    used += size
                    while used > limit:
                        used -= held.popitem(last=False)[1]
                bytes_.append(used)
            yield pd.DataFrame({**{c: pdf[c] for c in [*keys, *order]}, "hit": hits, "used": bytes_})

    ordered = log.select(*keys, *order, "key", "size").repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, f"{kinds}, hit boolean, used bigint")
