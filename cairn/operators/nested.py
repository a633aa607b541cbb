"""Nested snapshot documents as related flat tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.scratch import Scratch

#: One row per object met on the way down: its table, its owner and itself.
EMITTED = "bucket string, epoch bigint, rel string, owner_id bigint, item string, payload string"
ARROW = pa.schema([("bucket", pa.string()), ("epoch", pa.int64()), ("rel", pa.string()), ("owner_id", pa.int64()), ("item", pa.string()), ("payload", pa.string())])

#: The flat tables, by tag: what their payload holds and what their keys are called.
FLAT = {
    "inode": (("owner_id AS id",), "gen bigint, t int, m bigint, u bigint, g bigint, n bigint, sz bigint, at bigint, mt bigint, ct bigint, p bigint, lt string"),
    "entry": (("owner_id AS dir_id", "item AS name"), "child_id bigint"),
    "chunk": (("owner_id AS inode_id", "CAST(item AS INT) AS idx"), "h string, s bigint"),
}
#: An inode's scalar fields as the snapshot format names them.
SCALARS = ("gen", "t", "m", "u", "g", "n", "sz", "at", "mt", "ct", "p", "lt")
VERSION = 1
ROWS = 20_000


def _refuse(name: str):
    raise ValueError(name)


def _whole(x) -> int | None:
    """An integer written as one or as text; None for anything else."""
    if isinstance(x, str) and x.strip().lstrip("-").isdigit():
        x = int(x)
    return x if isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63 else None


def visit(body: str | None) -> Iterator[tuple[str, int, str, dict]]:
    """Depth first through one document: (tag, owner, item, payload) of each object.

    Nothing comes of a body that is no complete JSON or not of version 1.
    """
    if not body:
        return
    try:
        doc = json.loads(body.lstrip("﻿"), parse_constant=_refuse)
    except (ValueError, RecursionError):
        return
    if isinstance(doc, dict) and isinstance(doc.get("snapshot"), dict) and "inodes" not in doc:
        doc = doc["snapshot"]
    if not isinstance(doc, dict) or _whole(doc.get("version")) != VERSION:
        return
    table = doc.get("inodes")
    pairs = table.items() if isinstance(table, dict) else ((None, x) for x in table) if isinstance(table, list) else ()
    for key, node in pairs:
        if not isinstance(node, dict):
            continue
        own = _whole(node.get("id"))
        if own is None:
            own = _whole(key)
        if own is None:
            continue
        yield "inode", own, "", {k: v for k in SCALARS if (v := node.get(k) if k == "lt" else _whole(node.get(k))) is not None}
        entries = node.get("e")
        for name, child in entries.items() if isinstance(entries, dict) else ():
            yield "entry", own, name, {"child_id": _whole(child)}
        chunks = node.get("c")
        for at, ref in enumerate(chunks if isinstance(chunks, list) else ()):
            yield "chunk", own, str(at), {k: v for k in ("h", "s") if (v := ref.get(k) if k == "h" else _whole(ref.get(k))) is not None} if isinstance(ref, dict) else {}


def _text(s: str) -> str:
    """Lone surrogates, which JSON may spell but no string column holds, become '?'."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def flatten(docs: DataFrame, payload: bool = True) -> DataFrame:
    """Tagged rows (EMITTED) of all documents, in one pass and without a shuffle.

    ``docs`` has bucket, epoch and body; further columns are not read. With
    ``payload`` false the payload column is null. Inodes may be a map or a list,
    numbers may be text, a root pointer may stand beside the snapshot. Null,
    empty, damaged bodies and other versions give nothing; null inodes are passed
    over; a null chunk is a hole. Redelivered documents give their rows again.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in ARROW.names]
            for bucket, epoch, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for rel, owner, item, rest in visit(body):
                    for column, value in zip(out, (bucket, epoch, rel, owner, _text(item), _text(json.dumps(rest)) if payload else None)):
                        column.append(value)
                    if len(out[0]) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, ARROW.types)], schema=ARROW)
                        out = [[] for _ in ARROW.names]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, ARROW.types)], schema=ARROW)

    return docs.select("bucket", "epoch", "body").mapInArrow(run, EMITTED)


def write_flat(docs: DataFrame, folder: str) -> None:
    """Write all tables in one pass, partitioned by tag."""
    flatten(docs).write.partitionBy("rel").parquet(folder)


def read_flat(spark: SparkSession, folder: str, rel: str) -> DataFrame:
    """One table of what write_flat wrote, its schema applied; repeated rows count once."""
    return typed(_written(spark, folder), rel)


def _written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EMITTED).parquet(folder)


def flat_tables(docs: DataFrame, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """The flat tables by tag, and under 'keys' the distinct (bucket, epoch, rel, owner_id, item) of all.

    Each body is read and parsed once, however many of the tables are used: what
    the visitor emits is written partitioned by tag, and a table reads its own
    partition, its schema applied.
    """
    spark = docs.sparkSession
    folder = (scratch or Scratch(spark, "flat")).path + "/tagged"
    write_flat(docs, folder)
    keys = _written(spark, folder).select("bucket", "epoch", "rel", "owner_id", "item").distinct()
    return {rel: read_flat(spark, folder, rel) for rel in FLAT} | {"keys": keys}


def typed(tagged: DataFrame, rel: str) -> DataFrame:
    keys, fields = FLAT[rel]
    return tagged.filter(F.col("rel") == rel).withColumn("_p", F.from_json("payload", fields)).selectExpr("bucket", "epoch", *keys, "_p.*").distinct()
