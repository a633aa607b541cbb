"""Queries of the namespace, file, permission, commit and stream operators over the given tables.

A bucket's namespace is its newest snapshot; files with contents are the
documents' texts; requests and logs are the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import status as S
from cairn.functions.spelling import chunk_hash, low_mode, snapshot_key
from cairn.operators import attributes as A
from cairn.operators import cache, hierarchy
from cairn.operators import filedata as D
from cairn.operators import machines as M
from cairn.operators import mutations as U
from cairn.operators import namespace as N
from cairn.operators import policy as P
from cairn.operators import retention as R
from cairn.operators.snapshots import standing_inodes
from cairn.planning import broadcast_if_small
from cairn.sources import snapshots as snap
from cairn.sources.store import list_keys
from cairn.streaming import budget, replies
from cairn.tables import table

CUT = 1024
#: Callers that stand for every class of the mode bits, for objects of owner 501 and group 20.
CALLERS = ((0, 0, (10, 20)), (501, 500, (501, 502)), (501, 20, (501,)), (2000, 20, (201, 202)), (3000, 300, (302, 20, 301)), (4000, 400, (401, 402)))
OPS = ("read", "write", "truncate", "chmod", "chown", "chgrp", "settimes", "lookup", "readdir", "addentry", "removeentry", "rename", "none")
ATTRS = ("type", "mode", "uid", "gid", "nlink", "size", "atime_ns", "mtime_ns", "ctime_ns", "parent", "target")


def _newest(spark: SparkSession, d: str) -> DataFrame:
    snapshots = table(spark, d, "snapshots")
    return broadcast_if_small(snapshots.groupBy("bucket").agg(F.max("epoch").alias("epoch")), snapshots, ("bucket",))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """(bucket, epoch) of every snapshot not pruned, each bucket's newest in any case: the roots of a mark."""
    snapshots = table(spark, d, "snapshots")
    kept = snapshots.filter("pruned_ns IS NULL").select("bucket", "epoch").union(snapshots.groupBy("bucket").agg(F.max("epoch").alias("epoch"))).distinct()
    return broadcast_if_small(kept, snapshots, ("bucket",))


def _inodes(spark, d):
    rows = table(spark, d, "inodes").join(_newest(spark, d), ["bucket", "epoch"], "left_semi")
    return standing_inodes(rows, {c: F.col(c) for c in ATTRS}, *ATTRS).select("bucket", "id", "gen", *[low_mode(F.col(c)).alias(c) if c == "mode" else c for c in ATTRS])


def _dirents(spark, d):
    return table(spark, d, "dirents").join(_newest(spark, d), ["bucket", "epoch"], "left_semi").select("bucket", "dir_id", "name", "child_id").distinct()


def _refs(spark, d):
    rows = table(spark, d, "chunk_refs").join(_newest(spark, d), ["bucket", "epoch"], "left_semi")
    return rows.select("bucket", F.col("inode_id").alias("id"), "idx", chunk_hash(F.col("hash")).alias("hash"), "size").distinct()


def _files(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "utf-8").alias("data"))


def _chunks(spark, d):
    return D.chunk_files(_files(spark, d), ["doc_id"], "data", CUT)


def src_03_ranges(spark, d):
    return _files(spark, d).select("doc_id", F.hex(F.substring("data", 5, 8)).alias("bytes"))


def src_04_head(spark, d):
    return _files(spark, d).select("doc_id", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("etag"))


def src_05_list(spark, d):
    listing = table(spark, d, "chunks").select(F.concat(F.lit("chunks/"), F.lower("hash")).alias("key"), F.col("len").alias("size")).distinct()
    return list_keys(listing, "chunks/", "chunks/8", 100)


def src_08_load(spark, d):
    refs = _refs(spark, d)
    held = table(spark, d, "chunks").filter("deleted_ns IS NULL").select(chunk_hash(F.col("hash")).alias("hash"), F.col("len")).distinct()
    base = table(spark, d, "base_chunks").select("hash", "len")
    code = F.when(F.col("hash").isNull() | F.col("len").isNotNull(), S.OK).otherwise(S.IO)
    return refs.join(held.unionByName(base).groupBy("hash").agg(F.max("len").alias("len")), "hash", "left").select("bucket", "id", F.col("idx").cast("bigint").alias("idx"), F.coalesce("len", F.lit(0)).alias("len"), code.alias("status"))


def snk_04_upload(spark, d):
    items = table(spark, d, "eval_items").select("item_id", F.encode("text", "utf-8").alias("data"))
    known = D.chunk_files(items, ["item_id"], "data", CUT)
    return D.stored_chunks(_chunks(spark, d), known).select("hash", "len")


def snk_06_errors(spark, d):
    code = F.get(F.array(*[F.lit(c) for c in ("", "NoSuchKey", "PreconditionFailed")]), (F.col("doc_id") % 3).cast("int"))
    return table(spark, d, "documents").select("doc_id", M.store_error(F.col("http_status"), code).alias("error"))


def prj_01_getattr(spark, d):
    return A.attributes(_inodes(spark, d))


def prj_02_resolve(spark, d):
    inodes = _inodes(spark, d)
    asked = inodes.select("bucket", "id", A.handle(F.col("id"), F.col("gen") + (F.col("id") % 3 == 0).cast("int")).alias("h")).select(
        "bucket", F.col("id").alias("asked"), F.when(F.col("id") % 7 == 0, F.substring(F.col("h"), 1, 15)).otherwise(F.col("h")).alias("handle"))
    return A.resolve_handles(asked, inodes).select("bucket", "asked", "status")


def prj_03_handles(spark, d):
    h = A.handle(F.col("id"), F.col("gen"))
    id_, gen = A.handle_parts(h)
    return _inodes(spark, d).select("bucket", F.hex(h).alias("handle"), id_.alias("id"), gen.alias("gen"))


def prj_04_names(spark, d):
    names = table(spark, d, "dirents").select("name").union(table(spark, d, "documents").select("url")).union(table(spark, d, "snapshots").select(F.repeat("bucket", 13)))
    return names.distinct().select("name", A.name_status(F.col("name")).alias("status"))


def prj_05_readlink(spark, d):
    code, target = A.link_target(F.col("type"), F.col("target"))
    return _inodes(spark, d).select("bucket", "id", code.alias("status"), target.alias("target"))


def prj_07_places(spark, d):
    idx, off = A.chunk_place(F.col("size"), F.lit(65536))
    return _inodes(spark, d).select("bucket", "id", idx.alias("idx"), off.cast("bigint").alias("off"))


def prj_08_ends(spark, d):
    return _inodes(spark, d).select("bucket", "id", A.read_end(F.lit(1000), F.lit(70000), F.col("size")).cast("bigint").alias("end_at"))


def prj_09_spans(spark, d):
    asked = _inodes(spark, d).filter("type = 1").select("bucket", "id", "size", F.lit(1000).cast("bigint").alias("off"), F.lit(200000).cast("bigint").alias("count"))
    return D.covered(asked, 65536).select("bucket", "id", F.col("idx").cast("bigint").alias("idx"), F.col("within").cast("bigint").alias("within"), F.col("take").cast("bigint").alias("take"))


def prj_10_fsid(spark, d):
    return table(spark, d, "roots").select("bucket").distinct().select("bucket", A.filesystem_id(F.concat(F.lit("s3://"), F.col("bucket"))).alias("fsid"))


def prj_11_verifiers(spark, d):
    return A.directory_verifiers(_dirents(spark, d)).select("bucket", "dir_id", F.hex("verifier").alias("verifier"))


def prj_12_status(spark, d):
    return table(spark, d, "documents").select("doc_id", A.protocol_status(F.col("http_status")).alias("status"))


def prj_13_etags(spark, d):
    tag = F.concat(F.when(F.col("doc_id") % 2 == 0, 'W/"').otherwise('"'), F.col("host"), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", A.clean_etag(tag).alias("etag"))


def _requests(spark, d):
    callers = F.array(*[F.struct(F.lit(u).cast("bigint").alias("c_uid"), F.lit(g).cast("bigint").alias("c_gid"), F.array(*[F.lit(x).cast("bigint") for x in gs]).alias("c_gids")) for u, g, gs in CALLERS])
    return _inodes(spark, d).select("bucket", "id", "type", "mode", "uid", "gid", F.explode(callers).alias("c")).select("*", "c.*").drop("c")


def _parties():
    return P.Who(F.col("c_uid"), F.col("c_gid"), F.col("c_gids")), P.What(F.col("type"), F.col("mode"), F.col("uid"), F.col("gid"))


def pol_01_checks(spark, d):
    asked = _requests(spark, d).withColumn("op", F.explode(F.array(*[F.lit(o) for o in OPS])))
    return asked.select("bucket", "id", "c_uid", "c_gid", "op", P.check(F.col("op"), *_parties(), uid=F.lit(501).cast("bigint"), gid=F.lit(20).cast("bigint")).alias("status"))


def pol_14_access(spark, d):
    asked = _requests(spark, d)
    return asked.select("bucket", "id", "c_uid", "c_gid", P.access_bits(*_parties()).alias("bits"), P.access_bits(*_parties(), F.lit(0x3F), F.lit(True)).alias("read_only_bits"))


def pol_16_all(spark, d):
    own = P.custom(lambda who: F.when(who.uid == 4000, S.PERM).otherwise(S.OK))
    return _requests(spark, d).select("bucket", "id", "c_uid", "c_gid", P.all_of(P.file_access(*_parties(), P.READ), own(_parties()[0]), P.chmod(*_parties())).alias("status"))


def pol_18_setattr(spark, d):
    n = F.lit(None).cast("bigint")
    size, mode, atime = (F.when(F.col("id") % m == 0, F.lit(1).cast("bigint")) for m in (2, 3, 5))
    return _requests(spark, d).select("bucket", "id", "c_uid", "c_gid", P.set_attributes(*_parties(), size, mode, n, n, atime, n).alias("status"))


def ns_01_lookup(spark, d):
    inodes, dirents = _inodes(spark, d), _dirents(spark, d)
    asked = dirents.select("bucket", "dir_id", "name").unionByName(inodes.select("bucket", F.col("id").alias("dir_id"), F.explode(F.array(F.lit("."), F.lit(".."), F.lit("no such name"))).alias("name")))
    return N.lookup(asked, inodes, dirents).select("bucket", "dir_id", "name", "child_id", "status")


def ns_02_walk(spark, d):
    inodes, dirents = _inodes(spark, d), _dirents(spark, d)
    asked = N.entry_paths(dirents).select("bucket", "path")
    return N.walk_paths(asked, inodes, dirents).select("bucket", "path", "id", "status")


def ns_04_listing(spark, d):
    return N.listing(_dirents(spark, d), _inodes(spark, d)).select("bucket", "dir_id", "cookie", "name", "there")


def ns_04_replies(spark, d):
    return N.read_directory(N.listing(_dirents(spark, d), _inodes(spark, d)), F.lit(2), 512).select("bucket", "dir_id", "cookie", "name", "eof")


def ns_05_plus(spark, d):
    inodes = _inodes(spark, d)
    page = N.read_directory(N.listing(_dirents(spark, d), inodes), F.lit(0), 1024, N.ENTRY_PLUS_COST)
    return N.with_attributes(page, inodes).select("bucket", "dir_id", "cookie", "name", F.hex("handle").alias("handle"), "type", "mode", "size")


def ns_06_fsstat(spark, d):
    return N.filesystem_stat(_inodes(spark, d), _refs(spark, d))


def ns_08_oversize(spark, d):
    return N.oversize(_inodes(spark, d), F.lit(1_000_000))


def mut_08_links(spark, d):
    return N.link_counts(_inodes(spark, d), _dirents(spark, d))


def dat_01_chunks(spark, d):
    return _chunks(spark, d).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "hash", "size")


def dat_03_dedup(spark, d):
    return D.dedup_report(_chunks(spark, d))


def dat_04_reads(spark, d):
    files = _files(spark, d)
    refs = _chunks(spark, d).select(F.lit("d").alias("bucket"), F.col("doc_id").alias("id"), "idx", "hash")
    bodies = _chunks(spark, d).groupBy("hash").agg(F.first("data").alias("data"))
    asked = files.select(F.col("doc_id").alias("req"), F.lit("d").alias("bucket"), F.col("doc_id").alias("id"), F.octet_length("data").cast("bigint").alias("size"), F.lit(500).cast("bigint").alias("off"), F.lit(3000).cast("bigint").alias("count"))
    return D.read_ranges(asked, refs, bodies, CUT).select("req", F.sha2("data", 256).alias("digest"), "eof", "status")


def dat_08_truncate(spark, d):
    refs = _refs(spark, d)
    cuts = _inodes(spark, d).filter("type = 1").select("bucket", "id", F.col("size").alias("old_size"), F.floor(F.col("size") / 2).cast("bigint").alias("new_size"))
    return D.truncate(refs, cuts, ["bucket", "id"], 65536)[0].select("bucket", "id", F.col("idx").cast("bigint").alias("idx"), "hash")


def dat_12_used(spark, d):
    return D.used_bytes(_refs(spark, d), ["bucket", "id"])


def dat_15_extents(spark, d):
    return D.extents(_refs(spark, d), ["bucket", "id"])


def dat_17_clone(spark, d):
    refs = _refs(spark, d)
    clones = refs.filter("idx = 2").select("bucket", F.col("id").alias("src_id"), F.lit(0).alias("src_idx"), F.lit(3).alias("n"), (F.col("id") + 100000).alias("dst_id"), F.lit(1).alias("dst_idx"))
    return D.clone_range(refs, clones).select("bucket", "id", F.col("idx").cast("bigint").alias("idx"), "hash", "size")


def dat_18_locate(spark, d):
    asked = _inodes(spark, d).filter("type = 1").select("bucket", "id", F.floor(F.col("size") / 2).cast("bigint").alias("at"))
    return D.locate(asked, D.spans(_refs(spark, d), ["bucket", "id"]), ["bucket", "id"]).select("bucket", "id", "at", F.col("idx").cast("bigint").alias("idx"), "within")


def dat_20_pre(spark, d):
    rows = standing_inodes(table(spark, d, "inodes"), {c: F.col(c) for c in ("size", "mtime_ns", "ctime_ns")}, "size", "mtime_ns", "ctime_ns")
    return D.pre_operation(rows, ["bucket", "id", "gen"], "epoch").select("bucket", "id", "gen", "epoch", "pre_size", "pre_mtime_ns")


def int_01_verify(spark, d):
    spoilt = _chunks(spark, d).withColumn("data", F.when(F.col("doc_id") % 9 == 0, F.concat("data", F.unhex(F.lit("00")))).otherwise(F.col("data")))
    return D.verify(spoilt).groupBy("status").agg(F.count("*").alias("n"))


def int_02_missing(spark, d):
    held = table(spark, d, "chunks").filter("deleted_ns IS NULL").select(chunk_hash(F.col("hash")).alias("hash")).union(table(spark, d, "base_chunks").select("hash"))
    return D.missing_chunks(_refs(spark, d), held).select("bucket", "id", F.col("idx").cast("bigint").alias("idx"))


def int_06_dangling(spark, d):
    return _dirents(spark, d).join(_inodes(spark, d).select("bucket", F.col("id").alias("child_id")), ["bucket", "child_id"], "left_anti").select("bucket", "dir_id", "name")


def cmt_05_classify(spark, d):
    current = table(spark, d, "snapshots").groupBy("bucket").agg(F.max("key").alias("known"), F.min("key").alias("doubt"))
    verdict = M.classify_root(F.col("writer").isNotNull(), F.col("epoch") % 11 == 0, F.col("version"), snapshot_key(F.col("snapshot")), F.col("writer"), F.col("known"), F.col("doubt"))
    return table(spark, d, "roots").join(current, "bucket").select("bucket", "epoch", "written_ns", verdict.alias("verdict")).distinct()


def cmt_10_prunable(spark, d):
    snapshots = table(spark, d, "snapshots")
    return R.prunable(snapshots, snapshots.groupBy("bucket").agg(F.max("key").alias("current")), 3)


def cmt_14_modes(spark, d):
    modes = M.Machine("mode", M.MOUNT_MODE)
    start = F.get(F.array(*[F.lit(m) for m in ("Writable", "ReadOnly", "Diverged")]), (F.col("user_id") % 3).cast("int"))
    event = F.when(F.col("event_type") == "error", "Diverge").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", modes.next(start, event).alias("next"), A.mount_gate(F.coalesce(modes.next(start, event), start)).alias("gate"))


def cmt_16_as_of(spark, d):
    first = table(spark, d, "snapshots").groupBy("bucket").agg(F.min("epoch").alias("epoch"))
    return R.at_epoch(table(spark, d, "dirents"), first).select("bucket", "epoch", "dir_id", "name", "child_id").distinct()


def cmt_17_mark(spark, d):
    return R.reachable(table(spark, d, "chunk_refs"), _kept(spark, d))


def cmt_18_sweep(spark, d):
    return R.sweepable(table(spark, d, "chunks"), cmt_17_mark(spark, d), 1745000000000000000)


def fsm_02_fold(spark, d):
    machine = M.Machine("rootKnowledge", M.ROOT_KNOWLEDGE)
    kinds = {"signup": "SwapOK", "purchase": "SwapUnknown", "click": "ProbeOurs", "view": "ProbeUnchanged"}
    event = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("Other"))
    log = table(spark, d, "events").select("user_id", "ts", "event_id", event.alias("event"))
    return machine.run(log, ["user_id"], ["ts", "event_id"], "event", "Known")


def str_01_repeats(spark, d):
    log = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return replies.repeats(log, ["user_id", "event_type"], "ts").select("event_id", "repeat")


def str_02_idempotent(spark, d):
    proc = F.get(F.array(*[F.lit(p) for p in ("READ", "CREATE", "WRITE", "REMOVE", "COMMIT")]), (F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").select("event_id", replies.is_idempotent(proc).alias("idempotent"))


def str_03_budget(spark, d):
    writes = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.lit(CUT).alias("capacity"))
    return budget.replay(writes, ["user_id"], 10 * CUT)


def src_06_namespace(spark, d):
    flat = snap.relations(table(spark, d, "snapshot_docs"))
    return flat["inodes"].groupBy("bucket", "epoch").agg(F.count("*").alias("n_inodes"), F.count(F.when(F.col("type") == S.DIR, 1)).alias("n_dirs"), F.max("id").alias("top_id"))


def snk_05_encode(spark, d):
    head = table(spark, d, "snapshots").join(_newest(spark, d), ["bucket", "epoch"], "left_semi").select("bucket", "epoch", "next_ino", "chunk_size", "created_ns").distinct()
    at = lambda df: df.join(head.select("bucket", "epoch"), "bucket")
    docs = snap.documents(head, at(_inodes(spark, d)), at(_dirents(spark, d)), at(_refs(spark, d)).withColumnRenamed("id", "inode_id"))
    flat = snap.relations(docs)
    names = flat["dirents"].groupBy("bucket").agg(F.count("*").alias("n_entries"))
    return flat["inodes"].groupBy("bucket").agg(F.count("*").alias("n_inodes"), F.max("mtime_ns").alias("newest_ns")).join(names, "bucket", "left")


def ns_03_ancestors(spark, d):
    tree = hierarchy.newest_tree(*[table(spark, d, n) for n in ("snapshots", "inodes", "dirents")])
    trails = hierarchy.hierarchy(tree, trail=True)
    named = _dirents(spark, d)
    pairs = named.select("bucket", F.col("dir_id").alias("id"), F.col("child_id").alias("below_id")).unionByName(named.select("bucket", F.col("child_id").alias("id"), F.col("dir_id").alias("below_id"))).distinct()
    return N.lies_under(pairs, trails).select("bucket", "id", "below_id", "inside")


def ns_07_stats(spark, d):
    return table(spark, d, "inodes").groupBy("bucket").agg(F.max("epoch").alias("epoch"), F.count_distinct("epoch", "id").alias("n_inodes"))


def dat_05_refs(spark, d):
    asked = _inodes(spark, d).filter("type = 1").select("bucket", "id", "size", F.lit(100000).cast("bigint").alias("off"), F.lit(300000).cast("bigint").alias("count"))
    stored = _refs(spark, d).filter("hash IS NOT NULL")
    return D.covered(asked, 65536).join(stored.select("bucket", "id", "idx", "hash"), ["bucket", "id", "idx"]).select("bucket", "id", F.col("idx").cast("bigint").alias("idx"), "hash", F.col("take").cast("bigint").alias("take"))


def dat_06_overlay(spark, d):
    refs = _chunks(spark, d)
    dirty = refs.filter("idx = 1").select("doc_id", "idx", F.encode(F.lit("buffered"), "utf-8").alias("data"))
    return D.overlay(refs, dirty, ["doc_id"]).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "hash", F.col("size").cast("bigint").alias("size"))


def _written(spark, d):
    refs = _chunks(spark, d)
    writes = _files(spark, d).select("doc_id", F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), F.lit(1000).cast("bigint").alias("off"), F.encode(F.repeat(F.lit("a"), 100), "utf-8").alias("data")),
        F.struct(F.lit(2).alias("seq"), F.lit(1050).cast("bigint").alias("off"), F.encode(F.lit("PATCHED"), "utf-8").alias("data")))).alias("w")).select("doc_id", "w.*")
    return D.apply_writes(writes, refs, refs.groupBy("hash").agg(F.first("data").alias("data")), ["doc_id"], CUT)


def dat_07_writes(spark, d):
    return _written(spark, d).select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.sha2("data", 256).alias("hash"))


def dat_09_trims(spark, d):
    cuts = _inodes(spark, d).filter("type = 1").select("bucket", "id", F.col("size").alias("old_size"), F.floor(F.col("size") / 2).cast("bigint").alias("new_size"))
    shorter = cuts.withColumn("new_size", F.floor(F.col("new_size") - 7).cast("bigint")).filter("new_size > 0")
    trims = [D.truncate(_refs(spark, d), c, ["bucket", "id"], 65536)[1] for c in (cuts, shorter)]
    return D.least_trims(*trims, keys=["bucket", "id"]).select("bucket", "id", F.col("idx").cast("bigint").alias("idx"), F.col("to_len").cast("bigint").alias("to_len"))


def dat_10_flush(spark, d):
    refs = _chunks(spark, d).select("doc_id", "idx", "hash", "size")
    return D.flush(_written(spark, d), refs, ["doc_id"])[0].select("doc_id", F.col("idx").cast("bigint").alias("idx"), "hash", F.col("size").cast("bigint").alias("size"))


def dat_13_limits(spark, d):
    return table(spark, d, "snapshots").select("bucket", "chunk_size").distinct().select("bucket", A.max_file_size(F.col("chunk_size")).alias("max_size"))


def dat_16_punch(spark, d):
    holes = _inodes(spark, d).filter("type = 1").select("bucket", "id", F.lit(65536).cast("bigint").alias("off"), F.lit(131072).cast("bigint").alias("len"))
    return D.punch(_refs(spark, d), holes, ["bucket", "id"], 65536).select("bucket", "id", F.col("idx").cast("bigint").alias("idx"), "hash", "size")


def dat_19_unpinned(spark, d):
    inodes = _inodes(spark, d).select("bucket", "id")
    named = _dirents(spark, d).select("bucket", F.col("child_id").alias("id"))
    return D.unpinned(inodes.join(named, ["bucket", "id"], "left_anti"), _inodes(spark, d).filter("type = 5"))


def _cached(spark, d):
    log = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("key"), (F.length("event_type") * 100).cast("bigint").alias("size"))
    return cache.readings(log, ["user_id"], ["ts", "event_id"], 1300)


def int_04_lru(spark, d):
    return _cached(spark, d).drop("used")


def int_05_counts(spark, d):
    return _cached(spark, d).groupBy("user_id").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))


def _mutable(spark, d):
    inodes = _inodes(spark, d)
    return U.Namespace(inodes, _dirents(spark, d), inodes.groupBy("bucket").agg((F.max("id") + 1).alias("next_ino")))


def _ask(df, **given):
    kinds = dict(c.split(" ", 1) for c in U.REQUESTS.split(", "))
    fill = {"uid": F.lit(0), "gid": F.lit(0), "gids": F.array()} | given
    return df.select("bucket", *[fill.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items() if c != "bucket"])


def _batch(spark, d):
    """In every bucket's root: a file, a directory and a link are made, and the first name is removed."""
    root = _dirents(spark, d).filter("dir_id = 1").groupBy("bucket").agg(F.min("name").alias("first"))
    at = {"dir_id": F.lit(1)}
    return _ask(root, seq=F.lit(1), op=F.lit("create"), name=F.lit("~new"), **at).unionByName(_ask(root, seq=F.lit(2), op=F.lit("mkdir"), name=F.lit("~dir"), **at)).unionByName(
        _ask(root, seq=F.lit(3), op=F.lit("symlink"), name=F.lit("~link"), target=F.lit("ü"), **at)).unionByName(_ask(root, seq=F.lit(4), op=F.lit("remove"), name=F.col("first"), **at))


def mut_01_make(spark, d):
    ns, _ = U.apply_requests(_mutable(spark, d), _batch(spark, d), 1_750_000_000_000_000_000)
    made = ns.dirents.filter(F.col("name").startswith("~"))
    return made.join(ns.inodes.select("bucket", F.col("id").alias("child_id"), "type", "mode", "nlink", "size"), ["bucket", "child_id"]).select("bucket", "name", "child_id", "type", "mode", "nlink", "size")


def mut_06_remove(spark, d):
    ns, got = U.apply_requests(_mutable(spark, d), _batch(spark, d), 1_750_000_000_000_000_000)
    names = ns.dirents.filter("dir_id = 1").groupBy("bucket").agg(F.count("*").alias("n_names"))
    return got.filter("seq = 4").select("bucket", "status").join(names, "bucket")


def mut_01_everywhere(spark, d):
    """Callers of every class ask for a directory of their own in every inode, be it a directory or not."""
    inodes = _inodes(spark, d)
    asks = inodes.select("bucket", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(u).alias("u"), F.lit(g).alias("g"), F.array(*[F.lit(x) for x in gs]).alias("gs")) for k, (u, g, gs) in enumerate(CALLERS)])).alias("c"))
    asked = _ask(asks, seq=F.col("id") * len(CALLERS) + F.col("c.k"), op=F.lit("mkdir"), dir_id=F.col("id"), name=F.concat(F.lit("~"), F.col("c.k").cast("string")), uid=F.col("c.u"), gid=F.col("c.g"), gids=F.col("c.gs"))
    ns, got = U.apply_requests(_mutable(spark, d), asked, 1_750_000_000_000_000_000)
    links = ns.inodes.select("bucket", F.col("id").alias("dir_id"), "nlink")
    return asked.select("bucket", "seq", "dir_id").join(got, ["bucket", "seq"]).groupBy("bucket", "dir_id").agg(F.count(F.when(F.col("status") == S.OK, 1)).alias("n_made"), F.max("status").alias("worst")).join(links, ["bucket", "dir_id"])


def mut_06_everything(spark, d):
    """Every entry of every directory is removed at once."""
    names = _dirents(spark, d).select("bucket", "dir_id", "name").distinct().filter("name IS NOT NULL")
    asked = _ask(names, seq=F.xxhash64("dir_id", "name"), op=F.lit("remove"), dir_id=F.col("dir_id"), name=F.col("name"))
    _, got = U.apply_requests(_mutable(spark, d), asked, 1_750_000_000_000_000_000)
    return asked.select("bucket", "seq", "dir_id", "name").join(got.select("bucket", "seq", "status"), ["bucket", "seq"]).drop("seq")


def mut_07_rename(spark, d):
    root = _dirents(spark, d).filter("dir_id = 1").groupBy("bucket").agg(F.min("name").alias("first"))
    asked = _ask(root, seq=F.lit(1), op=F.lit("rename"), dir_id=F.lit(1), name=F.col("first"), to_dir=F.lit(1), to_name=F.lit("~moved"))
    ns, got = U.apply_requests(_mutable(spark, d), asked, 1_750_000_000_000_000_000)
    return got.select("bucket", "status").join(ns.dirents.filter("name = '~moved'").select("bucket", "child_id"), "bucket", "left")


def mut_07_everything(spark, d):
    """Every file and link is moved to its bucket's root, under a name of its own."""
    inodes, names = _inodes(spark, d), _dirents(spark, d)
    files = inodes.filter("type <> 2").select("bucket", F.col("id").alias("child_id"))
    asked = names.join(files, ["bucket", "child_id"], "left_semi").select("bucket", "dir_id", "name").distinct()
    asked = _ask(asked, seq=F.xxhash64("dir_id", "name"), op=F.lit("rename"), dir_id=F.col("dir_id"), name=F.col("name"), to_dir=F.lit(1), to_name=F.concat(F.lit("~"), F.hex(F.xxhash64("dir_id", "name"))))
    ns, got = U.apply_requests(_mutable(spark, d), asked, 1_750_000_000_000_000_000)
    done = got.groupBy("bucket").agg(F.count(F.when(F.col("status") == S.OK, 1)).alias("n_done"), F.max("status").alias("worst"))
    return done.join(ns.dirents.filter("dir_id = 1").groupBy("bucket").agg(F.count("*").alias("n_names")), "bucket", "left")


def mut_09_setattr(spark, d):
    asked = _ask(_inodes(spark, d).select("bucket").distinct(), seq=F.lit(1), op=F.lit("setattr"), id=F.lit(1), uid=F.lit(501), gid=F.lit(20), new_mode=F.lit(0o600))
    ns, got = U.apply_requests(_mutable(spark, d), asked, 1_750_000_000_000_000_000)
    return got.select("bucket", "status").join(ns.inodes.filter("id = 1").select("bucket", "mode"), "bucket", "left")


def mut_09_resize(spark, d):
    """Every file is set to half its size and then to the whole again by its owner: what is cut stays cut."""
    files = _inodes(spark, d).filter("type = 1 AND uid IS NOT NULL")
    ask = lambda seq, size: _ask(files, seq=F.lit(seq) * 1_000_000_000 + F.col("id"), op=F.lit("setattr"), id=F.col("id"), uid=F.col("uid"), gid=F.lit(20), new_size=size)
    ns = _mutable(spark, d)
    ns.refs = _refs(spark, d)
    asked = ask(1, A.whole_division(F.col("size"), F.lit(2))).unionByName(ask(2, F.col("size")))
    after, got = U.apply_requests(ns, asked, 1_750_000_000_000_000_000, 65536)
    done = got.groupBy("bucket", "id").agg(F.max("status").alias("status"))
    lists = after.refs.groupBy("bucket", "id").agg(F.count("*").alias("n_chunks"), F.count("hash").alias("n_stored"))
    cut = after.trims.groupBy("bucket", "id").agg(F.max("idx").cast("bigint").alias("trim_idx"), F.max("to_len").alias("to_len"))
    sized = after.inodes.filter("type = 1").select("bucket", "id", "size")
    return done.filter("id IS NOT NULL").join(sized, ["bucket", "id"]).join(lists, ["bucket", "id"], "left").join(cut, ["bucket", "id"], "left")


def dat_11_settle(spark, d):
    """Every text cut to half: its last chunk is stored anew, under the name of what is left."""
    refs = _chunks(spark, d)
    cuts = _files(spark, d).select("doc_id", F.octet_length("data").cast("bigint").alias("old_size"), A.whole_division(F.octet_length("data"), F.lit(2)).alias("new_size"))
    kept, trims = D.truncate(refs.select("doc_id", "idx", "hash", "size"), cuts, ["doc_id"], CUT)
    settled, _ = D.settle(kept, refs.groupBy("hash").agg(F.first("data").alias("data")), ["doc_id"], trims=trims)
    return settled.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "hash", F.col("size").cast("bigint").alias("size"))


def dat_14_dropped(spark, d):
    """The buffers of every third file are dropped with it; a source is a mount."""
    dirty = _chunks(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", "doc_id", F.col("size").alias("capacity"))
    gone = table(spark, d, "documents").filter("doc_id % 3 = 0").select("doc_id")
    left, released = D.drop_buffers(dirty, gone, ["doc_id"], ["source"])
    both = left.select("source", F.col("capacity").alias("held")).unionByName(released, allowMissingColumns=True)
    return both.groupBy("source").agg(F.sum("held").alias("held"), F.sum("released").alias("released"))


def dat_16_edges(spark, d):
    refs = _chunks(spark, d)
    holes = _files(spark, d).select("doc_id", F.lit(500).cast("bigint").alias("off"), F.lit(1700).cast("bigint").alias("len"))
    cut = D.punch_edges(refs, refs.groupBy("hash").agg(F.first("data").alias("data")), holes, ["doc_id"], CUT)
    return cut.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.sha2("data", 256).alias("hash"))


def dat_07_limits(spark, d):
    """A write of 100,000 bytes at the end of every file, under a limit."""
    code, taken = D.write_status(F.col("size"), F.lit(100_000), F.lit(1_000_000))
    return _inodes(spark, d).filter("type = 1").select("bucket", "id", code.alias("status"), taken.cast("bigint").alias("taken"))


def ns_04_cookies(spark, d):
    """Every directory is read on from four places, under the verifier it has, an older one or none."""
    listed = N.listing(_dirents(spark, d), _inodes(spark, d)).groupBy("bucket", "dir_id").agg(F.max("cookie").alias("length"))
    verifier = lambda n: F.unhex(F.lpad(F.hex(F.col("dir_id") + n), 16, "0"))
    given = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in (("current", verifier(7)), ("old", verifier(6)), ("none", F.unhex(F.lit("00" * 8))))])).alias("g")
    cookie = F.explode(F.array(*[c.cast("bigint") for c in (F.lit(0), F.lit(2), F.col("length"), F.col("length") + 1)])).alias("cookie")
    asked = listed.select("*", cookie).select("*", given)
    return asked.select("bucket", "dir_id", "cookie", F.col("g.name").alias("verifier"), N.cookie_status(F.col("cookie"), F.col("length"), F.col("g.v"), verifier(7)).alias("status")).distinct()


def ns_07_cache(spark, d):
    """What each mount's cache reports: hits, misses and bytes held at the end of its log."""
    return _cached(spark, d).groupBy("user_id").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"), F.max_by("used", F.struct("ts", "event_id")).alias("bytes"))


def mut_05_owner(spark, d):
    """Files made by callers who ask for another owner: the uid is refused in silence, the gid taken as it is."""
    roots = _inodes(spark, d).filter("id = 1").select("bucket", "uid")
    ask = lambda seq, **given: _ask(roots, seq=F.lit(seq), op=F.lit("create"), dir_id=F.lit(1), name=F.lit(f"~by{seq}"), new_gid=F.lit(77), **given)
    asked = ask(1, new_uid=F.lit(88)).unionByName(ask(2, uid=F.col("uid"), gid=F.lit(20), new_uid=F.lit(88))).unionByName(ask(3, uid=F.col("uid"), gid=F.lit(20), new_uid=F.col("uid")))
    ns, got = U.apply_requests(_mutable(spark, d), asked, 1_750_000_000_000_000_000)
    return got.join(ns.inodes.select("bucket", "id", "uid", "gid"), ["bucket", "id"], "left").select("bucket", "seq", "status", "uid", "gid")


def str_01_cache(spark, d):
    """The verdict on every request of a log in which each is finished ten seconds after it begins."""
    log = table(spark, d, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("seq"))
    begun = log.select("*", F.lit("begin").alias("event"))
    done = log.select("user_id", "event_type", (F.col("ts") + F.expr("INTERVAL 10 SECONDS")).alias("ts"), "seq", F.lit("finish").alias("event"))
    return replies.verdicts(begun.unionByName(done), ["user_id"], ["event_type"])


def mut_11_guard(spark, d):
    guard = F.when(F.col("id") % 2 == 0, F.col("ctime_ns")).when(F.col("id") % 3 == 0, F.lit(1).cast("bigint"))
    return _inodes(spark, d).select("bucket", "id", A.guard_status(F.col("ctime_ns"), guard).alias("status"))


def fsm_01_edges(spark, d):
    mode, root = M.machines()
    return mode.table(spark).unionByName(root.table(spark))


_AREAS = ("src_", "snk_", "prj_", "pol_", "ns_", "mut_", "dat_", "int_", "cmt_", "fsm_", "str_")
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(_AREAS)}
