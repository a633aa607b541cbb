"""Ordered changes of a namespace, applied in waves of requests that do not touch each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import status as S
from cairn.operators import filedata as D
from cairn.operators import policy as P
from cairn.operators.attributes import MAX_CHUNKS, guard_status, mount_gate, name_status
from cairn.operators.hierarchy import hierarchy
from cairn.planning import broadcast_if_small
from cairn.scratch import Scratch

#: A batch of requests; op is create, mkdir, symlink, remove, rmdir, rename or setattr.
REQUESTS = (
    "bucket string, seq bigint, op string, uid bigint, gid bigint, gids array<bigint>, dir_id bigint, name string, to_dir bigint, to_name string, id bigint, "
    "exclusive boolean, target string, new_size bigint, new_mode int, new_uid bigint, new_gid bigint, new_atime_ns bigint, new_mtime_ns bigint, guard_ns bigint"
)
BARRIERS = ("rmdir",)
FIELDS = ("bucket", "id", "gen", "type", "mode", "uid", "gid", "nlink", "size", "atime_ns", "mtime_ns", "ctime_ns", "parent", "target")


@dataclass
class Namespace:
    """inodes (FIELDS), dirents (bucket, dir_id, name, child_id) and next_ino (bucket, next_ino) of one snapshot per bucket.

    With ``refs`` (bucket, id, idx, hash, size) the chunk lists follow changes of
    size, and ``trims`` (bucket, id, idx, to_len) are the cuts into stored chunks
    that a flush has yet to make.
    """

    inodes: DataFrame
    dirents: DataFrame
    next_ino: DataFrame
    refs: DataFrame | None = None
    trims: DataFrame | None = None


def waves(requests: DataFrame, next_ino: DataFrame) -> DataFrame:
    """Requests with their wave: the longest stretch of a bucket's order in which no two touch each other.

    Entries of different names are added and removed side by side; so are the
    attributes of different inodes changed, and entries renamed that share no
    name, but not one beside the other. Renames that turn out to move or replace
    a directory are put off to a pass of their own when they are applied. The
    removal of a directory looks at more than its own entry and stands alone; a
    request that names an inode made in this batch waits for the wave before.
    Numbers of inodes thus follow the order of requests. Stretches are found in
    one pass over the sorted requests, which holds the hashes of one wave's
    entries.
    """
    made = F.col("op").isin("create", "mkdir", "symlink")
    newest = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("dir_id", "to_dir", "id")])
    entry = F.when(F.col("op") == "setattr", F.xxhash64("id")).otherwise(F.xxhash64("dir_id", "name"))
    marks = requests.join(next_ino, "bucket", "left").select(
        "bucket", "seq", entry.alias("entry"), F.when(F.col("op") == "rename", F.xxhash64("to_dir", "to_name")).otherwise(entry).alias("other"), F.when(F.col("op").isin("setattr", "rename"), F.col("op")).otherwise("names").alias("kind"), F.col("op").isin(*BARRIERS).alias("alone"), made.alias("makes"), F.coalesce(newest >= F.col("next_ino"), F.lit(False)).alias("waits"))

    def run(batches):
        at, wave, entries, makes, closed, kind = None, 0, set(), False, True, None
        for pdf in batches:
            out = []
            for bucket, entry, other, own, alone, new, waits in zip(pdf.bucket, pdf.entry, pdf.other, pdf.kind, pdf.alone, pdf.makes, pdf.waits):
                if bucket != at:
                    at, wave, closed = bucket, 0, True
                if closed or alone or own != kind or entry in entries or other in entries or (waits and makes):
                    wave, entries, makes, kind = wave + 1, set(), False, own
                entries |= {entry, other}
                makes, closed = makes or new, alone
                out.append(wave)
            yield pdf[["bucket", "seq"]].assign(wave=out)

    # by a hash: above a join by bucket Spark leaves out a repartition by bucket, and adaptive execution may then read that join's rows mapper by mapper
    numbered = marks.repartition(F.xxhash64("bucket")).sortWithinPartitions("bucket", "seq").mapInPandas(run, "bucket string, seq bigint, wave bigint")
    return requests.join(numbered, ["bucket", "seq"])


def apply_requests(ns: Namespace, requests: DataFrame, now_ns: int, chunk_size: int = 1 << 20, mode: str = "Writable") -> tuple[Namespace, DataFrame]:
    """(namespace after, (bucket, seq, status, id)) of ordered requests (REQUESTS).

    As many passes as a bucket has waves and renames of directories; in a pass all
    buckets and entries move together, and the namespace is written between passes.
    """
    spark = requests.sparkSession
    scratch = Scratch(spark, "mutations")
    staged = scratch.write(waves(requests, ns.next_ino))
    refs = trims = None
    if ns.refs is not None:
        refs = scratch.write(ns.refs.select("bucket", "id", "idx", "hash", "size"))
        trims = ns.trims if ns.trims is not None else refs.limit(0).select("bucket", "id", "idx", F.col("size").alias("to_len"))
    ns = Namespace(scratch.write(ns.inodes.select(*FIELDS)), scratch.write(ns.dirents.select("bucket", "dir_id", "name", "child_id")), scratch.write(ns.next_ino), refs, trims)
    last = staged.agg(F.max("wave")).first()[0] or 0
    results = spark.createDataFrame([], "bucket string, seq bigint, status int, id bigint")
    now = now_ns
    for wave in range(1, last + 1):
        rest = staged.filter(F.col("wave") == wave)
        while rest is not None:
            now += 1
            ns, done, rest = _apply_wave(ns, rest, now, chunk_size, mode, scratch)
            results = results.unionByName(done)
    return ns, results


def _in_one_pass(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests of a wave that may be applied together, those put off).

    Renames of files that share no name do not touch each other; one that moves
    or replaces a directory looks at the tree around it. Up to the first of those
    all go at once, or that one alone.
    """
    serial = (F.col("op") == "rename") & ((F.col("c_type") == S.DIR) | (F.col("v_type") == S.DIR))
    marked = asked.withColumn("_serial", F.coalesce(serial, F.lit(False)))
    first = marked.groupBy("bucket").agg(F.min(F.when(F.col("_serial"), F.col("seq"))).alias("_stop"), F.min("seq").alias("_low"))
    first = broadcast_if_small(first, first, ("bucket",))
    goes = F.col("_stop").isNull() | (F.col("seq") < F.col("_stop")) | ((F.col("seq") == F.col("_stop")) & (F.col("seq") == F.col("_low")))
    parted = marked.join(first, "bucket").withColumn("_go", goes)
    return parted.filter("_go").select(asked.columns), parted.filter("NOT _go").select("bucket", "seq")


def _who() -> P.Who:
    return P.Who(F.col("uid"), F.col("gid"), F.col("gids"))


def _what(prefix: str) -> P.What:
    return P.What(*[F.col(f"{prefix}_{c}") for c in ("type", "mode", "uid", "gid")])


def _as(inodes: DataFrame, prefix: str, key: str) -> DataFrame:
    return inodes.select("bucket", F.col("id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in FIELDS if c not in ("bucket", "id")])


def _apply_wave(ns: Namespace, wave: DataFrame, now: int, chunk_size: int, mode: str, scratch: Scratch) -> tuple[Namespace, DataFrame, DataFrame | None]:
    """(namespace, results, requests put off if any) of one pass."""
    inodes, dirents = ns.inodes, ns.dirents
    entry = dirents.select("bucket", "dir_id", "name", F.col("child_id").alias("c_id"))
    to_entry = dirents.select("bucket", F.col("dir_id").alias("to_dir"), F.col("name").alias("to_name"), F.col("child_id").alias("v_id"))
    sizes = dirents.groupBy("bucket", F.col("dir_id").alias("_i")).agg(F.count("*").alias("_n"))
    asked = (
        wave.join(_as(inodes, "d", "dir_id"), ["bucket", "dir_id"], "left").join(entry, ["bucket", "dir_id", "name"], "left").join(_as(inodes, "c", "c_id"), ["bucket", "c_id"], "left")
        .join(_as(inodes, "t", "to_dir"), ["bucket", "to_dir"], "left").join(to_entry, ["bucket", "to_dir", "to_name"], "left").join(_as(inodes, "v", "v_id"), ["bucket", "v_id"], "left")
        .join(_as(inodes, "o", "id"), ["bucket", "id"], "left")
        .join(sizes.select("bucket", F.col("_i").alias("c_id"), F.col("_n").alias("c_n")), ["bucket", "c_id"], "left").join(sizes.select("bucket", F.col("_i").alias("v_id"), F.col("_n").alias("v_n")), ["bucket", "v_id"], "left")
    )
    rest, moves_dirs = None, False
    if not wave.filter("op = 'rename'").isEmpty():
        asked, later = _in_one_pass(scratch.write(asked))
        later = scratch.write(later)
        rest = None if later.isEmpty() else wave.join(later, ["bucket", "seq"], "left_semi")
        moves_dirs = not asked.filter((F.col("op") == "rename") & (F.col("c_type") == S.DIR)).isEmpty()
    if moves_dirs:
        above = hierarchy(inodes.select("bucket", "id", "parent", F.lit("").alias("name")), trail=True, scratch=scratch).select("bucket", F.col("id").alias("to_dir"), F.concat("above", F.array("id")).alias("t_above"))
        asked = asked.join(above, ["bucket", "to_dir"], "left")
    else:
        asked = asked.withColumn("t_above", F.lit(None).cast("array<bigint>"))
    asked = scratch.write(_with_status(asked, chunk_size, mode))
    ok = asked.filter("status = 0")
    made = ok.filter(F.col("op").isin("create", "mkdir", "symlink") & F.col("c_id").isNull())

    number = F.row_number().over(Window.partitionBy("bucket").orderBy("seq")) - 1
    type_ = F.when(F.col("op") == "mkdir", S.DIR).when(F.col("op") == "symlink", S.LNK).otherwise(S.REG)
    default = F.when(F.col("op") == "mkdir", 0o755).when(F.col("op") == "symlink", 0o777).otherwise(0o644)
    stamp = F.lit(now).cast("bigint")
    made = made.join(ns.next_ino, "bucket").select(
        "bucket", "seq", "dir_id", "name", (F.col("next_ino") + number).cast("bigint").alias("id"), stamp.alias("gen"), type_.alias("type"),
        F.coalesce("new_mode", default).bitwiseAND(F.lit(4095)).alias("mode"),
        F.when((F.col("uid") == 0) | (F.col("new_uid") == F.col("uid")), F.coalesce("new_uid", "uid")).otherwise(F.col("uid")).alias("uid"), F.coalesce("new_gid", "gid").alias("gid"),
        F.when(F.col("op") == "mkdir", 2).otherwise(1).cast("bigint").alias("nlink"), F.when(F.col("op") == "symlink", F.octet_length("target")).otherwise(0).cast("bigint").alias("size"),
        stamp.alias("atime_ns"), stamp.alias("mtime_ns"), stamp.alias("ctime_ns"), F.col("dir_id").alias("parent"), F.when(F.col("op") == "symlink", F.col("target")).alias("target"))
    made = scratch.write(made)

    moved = ok.filter((F.col("op") == "rename") & ~F.coalesce(F.col("v_id") == F.col("c_id"), F.lit(False)))
    cut = ok.filter(F.col("op").isin("remove", "rmdir"))
    gone_names = cut.select("bucket", "dir_id", "name").unionByName(moved.select("bucket", "dir_id", "name")).unionByName(moved.select("bucket", F.col("to_dir").alias("dir_id"), F.col("to_name").alias("name")))
    new_names = made.select("bucket", "dir_id", "name", F.col("id").alias("child_id")).unionByName(moved.select("bucket", F.col("to_dir").alias("dir_id"), F.col("to_name").alias("name"), F.col("c_id").alias("child_id")))
    after_names = scratch.write(dirents.select("bucket", "dir_id", "name", "child_id").join(gone_names.distinct(), ["bucket", "dir_id", "name"], "left_anti").unionByName(new_names))

    lost = cut.select("bucket", F.col("c_id").alias("id"), F.col("c_type").alias("type")).unionByName(moved.filter("v_type IS NOT NULL").select("bucket", F.col("v_id").alias("id"), F.col("v_type").alias("type")))
    sub = lambda rows, where, sign: rows.select("bucket", F.col(where).alias("id"), F.lit(sign).alias("_links"))
    is_dir = F.col("type") == S.DIR
    links = (
        sub(made.filter(is_dir), "dir_id", 1).unionByName(sub(cut.filter(F.col("c_type") == S.DIR), "dir_id", -1))
        .unionByName(sub(moved.filter((F.col("c_type") == S.DIR) & (F.col("dir_id") != F.col("to_dir"))), "dir_id", -1)).unionByName(sub(moved.filter((F.col("c_type") == S.DIR) & (F.col("dir_id") != F.col("to_dir"))), "to_dir", 1))
        .unionByName(sub(moved.filter(F.col("v_type") == S.DIR), "to_dir", -1)).unionByName(sub(lost.filter(~is_dir), "id", -1))
    )
    touched = sub(made, "dir_id", 0).unionByName(sub(cut, "dir_id", 0)).unionByName(sub(moved, "dir_id", 0)).unionByName(sub(moved, "to_dir", 0))
    change = links.withColumn("_m", F.lit(0)).unionByName(touched.withColumn("_m", F.lit(1))).groupBy("bucket", "id").agg(F.sum("_links").alias("_links"), F.max("_m").alias("_m"))
    home = moved.groupBy("bucket", F.col("c_id").alias("id")).agg(F.max_by("to_dir", "seq").alias("_home"))  # of several names of a file the last renamed counts
    sets = ok.filter(F.col("op") == "setattr").select("bucket", "id", F.lit(True).alias("_set"), "new_mode", F.col("new_uid"), "new_gid", "new_atime_ns", "new_mtime_ns", "new_size")
    dead = lost.filter(is_dir).select("bucket", "id", F.lit(True).alias("_dead")).distinct()
    kept = inodes.select(*FIELDS).join(change, ["bucket", "id"], "left").join(home, ["bucket", "id"], "left").join(sets, ["bucket", "id"], "left").join(dead, ["bucket", "id"], "left")
    applied = F.col("_set") & F.coalesce("new_mode", "new_uid", "new_gid", "new_atime_ns", "new_mtime_ns", "new_size").isNotNull()
    dirty, shifted = F.col("_m") == 1, F.col("_home").isNotNull() | F.coalesce(applied, F.lit(False))
    left = (F.coalesce("nlink", F.lit(0)) + F.coalesce("_links", F.lit(0))).cast("bigint")
    kept = kept.filter(F.col("_dead").isNull() & ((F.col("type") == S.DIR) | F.col("_links").isNull() | (F.col("_links") >= 0) | (left > 0))).select(
        "bucket", "id", "gen", "type", F.coalesce(F.col("new_mode").bitwiseAND(F.lit(4095)), "mode").alias("mode"), F.coalesce("new_uid", "uid").alias("uid"), F.coalesce("new_gid", "gid").alias("gid"),
        left.alias("nlink"), F.coalesce("new_size", "size").alias("size"), F.coalesce("new_atime_ns", "atime_ns").alias("atime_ns"),
        F.when(dirty, stamp).otherwise(F.coalesce("new_mtime_ns", F.when(F.col("new_size").isNotNull(), stamp), "mtime_ns")).alias("mtime_ns"),
        F.when(dirty | shifted, stamp).otherwise(F.col("ctime_ns")).alias("ctime_ns"), F.coalesce("_home", "parent").alias("parent"), "target")
    after_inodes = scratch.write(kept.unionByName(made.select(*FIELDS)))
    next_ino = scratch.write(ns.next_ino.join(made.groupBy("bucket").agg((F.max("id") + 1).alias("_n")), "bucket", "left").select("bucket", F.coalesce("_n", "next_ino").alias("next_ino")))
    result = asked.join(made.select("bucket", "seq", F.col("id").alias("_new")), ["bucket", "seq"], "left").select(
        "bucket", "seq", "status", F.when(F.col("status") == S.OK, F.coalesce("_new", "c_id", "id")).alias("id"))
    refs, trims = ns.refs, ns.trims
    if refs is not None:
        refs, trims = _resize(refs, trims, ok, after_inodes, chunk_size, scratch)
    return Namespace(after_inodes, after_names, next_ino, refs, trims), result, rest


def _resize(refs: DataFrame, trims: DataFrame, ok: DataFrame, inodes: DataFrame, chunk_size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Chunk lists and pending trims after the sizes a wave has set; those of inodes that are gone go too."""
    key = ["bucket", "id"]
    cuts = ok.filter((F.col("op") == "setattr") & F.col("new_size").isNotNull()).select(*key, F.col("o_size").alias("old_size"), "new_size")
    there = inodes.select(*key)
    after, new = D.truncate(refs, cuts, key, chunk_size)
    beyond = F.col("new_size").isNotNull() & (F.col("idx").cast("bigint") * chunk_size >= F.col("new_size"))
    held = trims.join(cuts, key, "left").filter(~beyond).select(*key, "idx", "to_len")
    return scratch.write(after.join(there, key, "left_semi")), scratch.write(D.least_trims(held, new, keys=key).join(there, key, "left_semi"))


def _with_status(asked: DataFrame, chunk_size: int, mode: str) -> DataFrame:
    """The first refusal of each request, in the order its operation asks.

    Verdicts are columns of their own first: nested in each other, their
    expressions would double with every step.
    """
    who, op = _who(), F.col("op")
    making = op.isin("create", "mkdir", "symlink")
    is_dir = lambda c: F.col(f"{c}_type") == S.DIR
    none, verdict = lambda c: F.col(f"{c}_type").isNull(), lambda test, code: F.when(test, code)
    asked = asked.withColumns({
        "_name": F.greatest(name_status(F.col("name")), F.when(op == "rename", name_status(F.col("to_name"))).otherwise(S.OK)),
        "_first": name_status(F.col("name")), "_enter": P.dir_access(who, _what("d"), P.WRITE | P.EXEC), "_both": P.rename(who, _what("d"), _what("t")), "_guard": guard_status(F.col("o_ctime_ns"), F.col("guard_ns")),
        "_write": P.file_access(who, _what("o"), P.WRITE), "_chmod": P.chmod(who, _what("o")), "_chown": P.chown(who, _what("o"), F.col("new_uid")), "_chgrp": P.chgrp(who, _what("o"), F.col("new_gid")), "_times": P.set_times(who, _what("o")),
    })
    bad = lambda c, given=None: F.when((F.col(c) != S.OK) & (F.lit(True) if given is None else given.isNotNull()), F.col(c))
    name = F.coalesce(bad("_first"), bad("_name"))
    gone = verdict(none("d"), S.STALE)
    asked = asked.withColumns({
        "_make": F.coalesce(
            verdict((op == "symlink") & (F.coalesce("target", F.lit("")) == ""), S.INVAL), name, verdict((op == "create") & (F.col("new_size") > MAX_CHUNKS * chunk_size), S.FBIG), gone, bad("_enter"),
            verdict(F.col("c_id").isNotNull(), F.when((op != "create") | F.coalesce("exclusive", F.lit(False)), S.EXIST).when(none("c"), S.NOENT).when(is_dir("c"), S.EXIST))),
        "_cut": F.coalesce(name, gone, bad("_enter"), verdict(none("c"), S.NOENT), verdict((op == "rmdir") & ~is_dir("c"), S.NOTDIR), verdict((op == "remove") & is_dir("c"), S.ISDIR), verdict((op == "rmdir") & (F.col("c_n") > 0), S.NOTEMPTY)),
        "_move": F.coalesce(
            name, gone, verdict(none("t"), S.STALE), bad("_both"), verdict(none("c"), S.NOENT), verdict(is_dir("c") & F.coalesce(F.array_contains("t_above", F.col("c_id")), F.lit(False)), S.INVAL),
            verdict(~none("v") & (F.col("v_id") != F.col("c_id")), F.when(is_dir("v") & ~is_dir("c"), S.ISDIR).when(~is_dir("v") & is_dir("c"), S.NOTDIR).when(is_dir("v") & (F.col("v_n") > 0), S.NOTEMPTY))),
        "_set": F.coalesce(
            verdict(F.col("new_size") > MAX_CHUNKS * chunk_size, S.FBIG), verdict(none("o"), S.STALE), bad("_guard"), bad("_write", F.col("new_size")), bad("_chmod", F.col("new_mode")), bad("_chown", F.col("new_uid")), bad("_chgrp", F.col("new_gid")),
            bad("_times", F.coalesce("new_atime_ns", "new_mtime_ns"))),
    })
    rule = F.when(making, F.col("_make")).when(op.isin("remove", "rmdir"), F.col("_cut")).when(op == "rename", F.col("_move")).when(op == "setattr", F.col("_set")).otherwise(S.SERVERFAULT)
    gate = mount_gate(F.lit(mode))
    status = F.when(gate != S.OK, gate).otherwise(F.coalesce(rule, F.lit(S.OK))).cast("int")
    return asked.withColumn("status", status).drop("_name", "_first", "_enter", "_both", "_guard", "_write", "_chmod", "_chown", "_chgrp", "_times", "_make", "_cut", "_move", "_set")


def empty_requests(spark) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(REQUESTS))
