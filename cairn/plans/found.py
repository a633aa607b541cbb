"""The pN_ queries of the general problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import changes, hierarchy, nested, orphans, versions
from cairn.tables import table


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def p1_found(spark, d):
    return changes.snapshot_changes(*_tables(spark, d, "snapshots", "inodes", "chunk_refs"))


def _flat(spark, d, which):
    return nested.flat_tables(table(spark, d, "snapshot_docs"))[which]


def p2_found(spark, d):
    return _flat(spark, d, "keys")


def p2_inodes(spark, d):
    return _flat(spark, d, "inode")


def p2_entries(spark, d):
    return _flat(spark, d, "entry")


def p2_chunks(spark, d):
    return _flat(spark, d, "chunk")


def _orphans(spark, d):
    return orphans.orphan_references(*_tables(spark, d, "snapshots", "roots", "inodes", "dirents", "chunk_refs", "chunks", "base_chunks"))


def p4_found(spark, d):
    return _orphans(spark, d)


def p4_report(spark, d):
    return orphans.orphan_report(_orphans(spark, d))


def p5_found(spark, d):
    return versions.inode_versions(*_tables(spark, d, "snapshots", "inodes")).select("bucket", "id", "gen", "valid_from", "valid_to")


def p5_history(spark, d):
    return versions.inode_versions(*_tables(spark, d, "snapshots", "inodes")).drop("attr_hash")


def p6_found(spark, d):
    return hierarchy.hierarchy(hierarchy.newest_tree(*_tables(spark, d, "snapshots", "inodes", "dirents")))


def p6_descendants(spark, d):
    tree = hierarchy.newest_tree(*_tables(spark, d, "snapshots", "inodes", "dirents"))
    return hierarchy.descendants(hierarchy.hierarchy(tree, trail=True))


def p6_subtrees(spark, d):
    return p6_descendants(spark, d).groupBy("bucket", "id").agg(F.count("*").alias("n_below"), F.max("distance").alias("height"))


QUERIES = {f.__name__: f for f in (
    p1_found, p2_found, p2_inodes, p2_entries, p2_chunks, p4_found, p4_report, p5_found, p5_history, p6_found, p6_descendants, p6_subtrees)}
