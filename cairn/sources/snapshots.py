"""Snapshot objects: gzipped JSON of a whole namespace, to relations and back."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import nested
from cairn.sources.store import FolderStore, NotFound

VERSION = 1
ROOT = "root"


class Unreadable(Exception):
    """A root pointer or snapshot of another version or shape."""


def snapshot_key(epoch: int, nonce: str) -> str:
    return f"snapshots/{epoch:020d}-{nonce}.json.gz"


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, epoch, body, key) of the snapshot objects under a bucket's folder."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.gz").text(folder)
    key = F.regexp_extract(F.col("_metadata.file_path"), r"(snapshots/.*)$", 1)
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.lit(name).alias("bucket"), F.regexp_extract(key, r"snapshots/(\d{20})-", 1).cast("bigint").alias("epoch"), F.col("value").alias("body"), key.alias("key"))


def relations(docs: DataFrame) -> dict[str, DataFrame]:
    """inodes, dirents and chunk_refs of snapshot documents (bucket, epoch, body), each parsed once; a missing hash is a hole."""
    flat = nested.flat_tables(docs)
    i, e, c = (flat[r] for r in ("inode", "entry", "chunk"))
    inodes = i.selectExpr("bucket", "epoch", "id", "gen", "t AS type", "CAST(m AS INT) AS mode", "u AS uid", "g AS gid", "n AS nlink", "sz AS size", "at AS atime_ns", "mt AS mtime_ns", "ct AS ctime_ns", "p AS parent", "lt AS target")
    return {"inodes": inodes, "dirents": e, "chunk_refs": c.selectExpr("bucket", "epoch", "inode_id", "idx", "nullif(h, '') AS hash", "s AS size")}


def documents(snapshots: DataFrame, inodes: DataFrame, dirents: DataFrame, chunk_refs: DataFrame) -> DataFrame:
    """(bucket, epoch, body): the JSON of each snapshot (bucket, epoch, next_ino, chunk_size, created_ns) from its relations."""
    key = ["bucket", "epoch"]
    e = dirents.groupBy(*key, F.col("dir_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "child_id")))).alias("e"))
    c = chunk_refs.groupBy(*key, F.col("inode_id").alias("id")).agg(F.transform(F.array_sort(F.collect_set(F.struct("idx", F.col("hash").alias("h"), F.col("size").alias("s")))), lambda x: F.struct(x["h"].alias("h"), x["s"].alias("s"))).alias("c"))
    node = F.struct(*[F.col(a).alias(b) for a, b in (("id", "id"), ("gen", "gen"), ("type", "t"), ("mode", "m"), ("uid", "u"), ("gid", "g"), ("nlink", "n"), ("size", "sz"), ("atime_ns", "at"), ("mtime_ns", "mt"), ("ctime_ns", "ct"), ("parent", "p"), ("target", "lt"))], "e", "c")
    nodes = inodes.join(e, [*key, "id"], "left").join(c, [*key, "id"], "left").groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("key"), F.to_json(node).alias("value"))))).alias("_i"))
    parts = F.transform(F.map_entries("_i"), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"]))
    body = F.concat(F.lit(f'{{"version":{VERSION},"epoch":'), F.col("epoch").cast("string"), F.lit(',"next_ino":'), F.col("next_ino").cast("string"), F.lit(',"chunk_size":'), F.col("chunk_size").cast("string"), F.lit(',"inodes":{'), F.array_join(parts, ","), F.lit('},"created":'), F.col("created_ns").cast("string"), F.lit("}"))
    return snapshots.join(nodes, key).select(*key, body.alias("body"))


def read_root(store: FolderStore) -> tuple[dict | None, str]:
    """The root pointer and its tag, of one reading; None where there is none."""
    try:
        raw, etag = store.get_with_etag(ROOT)
    except NotFound:
        return None, ""
    try:
        root = json.loads(raw)
    except ValueError as e:
        raise Unreadable(f"root pointer: {e}") from None
    if not isinstance(root, dict) or root.get("version") != VERSION or not root.get("snapshot"):
        raise Unreadable("root pointer of another version or without a snapshot")
    return root, etag


def decode(raw: bytes) -> dict:
    """One snapshot object, its invariants held: some inodes, none of them null."""
    try:
        doc = json.loads(gzip.decompress(raw))
    except (ValueError, OSError, EOFError) as e:
        raise Unreadable(str(e)) from None
    if doc.get("version") != VERSION:
        raise Unreadable(f"snapshot version {doc.get('version')}")
    if not doc.get("inodes"):
        raise Unreadable("snapshot without inodes")
    for id_, node in doc["inodes"].items():
        if node is None:
            raise Unreadable(f"null inode {id_}")
        if node.get("t") == 2:
            node.setdefault("e", {})
    return doc


def encode(doc: dict) -> bytes:
    return gzip.compress(json.dumps(doc, separators=(",", ":")).encode(), compresslevel=1, mtime=0)


def load_namespace(spark: SparkSession, store: FolderStore) -> tuple[dict, str, dict[str, DataFrame]]:
    """Root pointer, its tag, and the relations of the snapshot it names, pinned."""
    root, etag = read_root(store)
    if root is None:
        raise NotFound(ROOT)
    doc = decode(store.get(root["snapshot"]))
    if doc.get("epoch") != root["epoch"]:
        raise Unreadable("the snapshot is of another epoch than its root pointer")
    files = read_snapshots(spark, store.folder).filter(F.col("key") == root["snapshot"])
    return root, etag, relations(files)
