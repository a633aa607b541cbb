"""Lookup, traversal and listing over (inodes, dirents) of one snapshot per bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import status as S
from cairn.operators.attributes import handle
from cairn.operators.hierarchy import ROOT_ID
from cairn.scratch import Scratch

HEADROOM_BYTES, HEADROOM_FILES = 1 << 50, 1 << 30
ENTRY_COST, ENTRY_PLUS_COST = 32, 160


def lookup(requests: DataFrame, inodes: DataFrame, dirents: DataFrame) -> DataFrame:
    """``requests`` (bucket, dir_id, name, …) with child_id and status.

    '.' is the directory itself, '..' its parent, the root's parent the root. A
    directory that is gone is STALE, one that is none NOTDIR, a name that is not
    there or names no inode NOENT.
    """
    dirs = inodes.select("bucket", F.col("id").alias("dir_id"), F.col("type").alias("_t"), F.col("parent").alias("_p"))
    entries = dirents.select("bucket", "dir_id", "name", F.col("child_id").alias("_c"))
    there = inodes.select(F.col("bucket"), F.col("id").alias("child_id"), F.lit(True).alias("_there"))
    up = F.when(F.col("dir_id") == ROOT_ID, F.col("dir_id")).otherwise(F.col("_p"))
    child = F.when(F.col("name") == ".", F.col("dir_id")).when(F.col("name") == "..", up).otherwise(F.col("_c"))
    found = requests.join(dirs, ["bucket", "dir_id"], "left").join(entries, ["bucket", "dir_id", "name"], "left").withColumn("child_id", child)
    found = found.join(there, ["bucket", "child_id"], "left")
    code = F.when(F.col("_t").isNull(), S.STALE).when(F.col("_t") != S.DIR, S.NOTDIR).when(F.col("_there").isNull(), S.NOENT).otherwise(S.OK)
    return found.withColumn("status", code).withColumn("child_id", F.when(F.col("status") == S.OK, F.col("child_id"))).drop("_t", "_p", "_c", "_there")


def walk_paths(requests: DataFrame, inodes: DataFrame, dirents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``requests`` (bucket, path, …) with the inode at the end of the path and a status: repeated lookup from the root.

    A path may have any number of names. It goes ahead in jumps of 2^k names, the
    longest first, one try each; the name that no jump passes is looked up, which
    tells why a walk ends, or takes it over a '.' or '..', from where it jumps
    again. Rounds go on until no request is unfinished, so there are as many as
    dots in a path, not as names.
    """
    scratch = scratch or Scratch(requests.sparkSession, "walk")
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda x: x != "")
    open_ = scratch.write(requests.withColumns({"_parts": parts, "dir_id": F.lit(ROOT_ID).cast("bigint"), "status": F.lit(S.OK)}))
    done = None
    while True:
        jumped = scratch.write(_jump(open_, inodes, dirents, scratch))
        rest = jumped.filter(F.size("_parts") > 0).drop("status").withColumn("name", F.get("_parts", F.lit(0)))
        step = lookup(rest, inodes, dirents).withColumns({"dir_id": F.col("child_id"), "_parts": F.slice("_parts", F.lit(2), F.size("_parts"))})
        state = scratch.write(jumped.filter(F.size("_parts") == 0).unionByName(step.select(jumped.columns)))
        unfinished = (F.col("status") == S.OK) & (F.size("_parts") > 0)
        ended = state.filter(~unfinished)
        done = ended if done is None else done.unionByName(ended)
        open_ = state.filter(unfinished)
        if open_.isEmpty():
            return done.withColumn("id", F.when(F.col("status") == S.OK, F.col("dir_id"))).drop("_parts", "dir_id")


def _jump(state: DataFrame, inodes: DataFrame, dirents: DataFrame, scratch: Scratch) -> DataFrame:
    """``state`` (bucket, _parts, dir_id, …) carried on over the entries that lookup would pass.

    A stretch of 2^k names is made of two of half its length, and only where a
    request asks for it. Stretches are taken at multiples of their length. A try
    that fails leaves its reason within the next 2^k names, so shorter ones need
    one try each as well.
    """
    longest = state.agg(F.max(F.size("_parts"))).first()[0] or 0
    dirs = inodes.filter(F.col("type") == S.DIR).select("bucket", F.col("id").alias("dir_id"))
    there = inodes.select("bucket", F.col("id").alias("child_id"))
    made = _spelt(dirents).join(dirs, ["bucket", "dir_id"], "left_semi").join(there, ["bucket", "child_id"], "left_semi").select(
        "bucket", F.col("dir_id").alias("_top"), F.col("name").alias("_names"), F.col("child_id").alias("_end"))
    stretches = []
    for k in range(longest.bit_length()):
        n = 1 << k
        whole = F.sequence(F.lit(0), F.floor(F.size("_parts") / n).cast("int") - 1)
        cut = F.transform(whole, lambda i: F.array_join(F.slice("_parts", i * n + 1, F.lit(n)), "/"))  # noqa: B023
        asked = state.filter(F.size("_parts") >= n).select("bucket", F.explode(cut).alias("_names")).distinct()
        if k:
            after = stretches[-1].select("bucket", F.col("_top").alias("_end"), F.col("_names").alias("_then"), F.col("_end").alias("_last"))
            made = stretches[-1].join(after, ["bucket", "_end"]).select("bucket", "_top", F.concat_ws("/", "_names", "_then").alias("_names"), F.col("_last").alias("_end"))
        stretches.append(scratch.write(made.join(asked, ["bucket", "_names"], "left_semi")))
    for k in reversed(range(len(stretches))):
        n, kept = 1 << k, state.columns
        next_ = F.when(F.size("_parts") >= n, F.array_join(F.slice("_parts", F.lit(1), F.lit(n)), "/"))
        tried = state.withColumn("_names", next_).join(stretches[k].withColumnRenamed("_top", "dir_id"), ["bucket", "dir_id", "_names"], "left")
        went = F.col("_end").isNotNull()
        state = tried.withColumns({
            "dir_id": F.coalesce("_end", "dir_id"), "_parts": F.when(went, F.slice("_parts", F.lit(n + 1), F.size("_parts"))).otherwise(F.col("_parts"))}).select(kept)
    return state


def _spelt(dirents: DataFrame) -> DataFrame:
    """Entries whose name can stand in a path."""
    return dirents.filter(F.col("name").isNotNull() & ~F.col("name").isin("", ".", "..") & ~F.contains("name", F.lit("/")))


def entry_paths(dirents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(bucket, path, dir_id, name, child_id): every entry by each path of names that leads to it from the root.

    A path goes through no directory twice; one that closes a circle ends there.
    A directory of several names has its entries under each. Entries that no
    names lead to have no path. Links between directories double in length each
    round until none goes on, so rounds are the logarithm of the depth.
    """
    scratch = scratch or Scratch(dirents.sparkSession, "paths")
    named = _spelt(dirents)
    inner = named.select("bucket", F.col("dir_id").alias("child_id")).distinct()
    links = scratch.write(named.join(inner, ["bucket", "child_id"], "left_semi").filter(F.col("child_id") != F.col("dir_id")).select(
        "bucket", F.col("dir_id").alias("at"), F.col("child_id").alias("end"), F.concat(F.lit("/"), "name").alias("more"), F.array("child_id").alias("through")))
    root = F.lit(ROOT_ID).cast("bigint")
    reached = named.select("bucket").distinct().select("bucket", root.alias("end"), F.lit("").alias("path"), F.array(root).alias("above"))
    while not links.isEmpty():
        on = reached.select("bucket", F.col("end").alias("at"), "path", "above").join(links, ["bucket", "at"]).filter(~F.arrays_overlap("above", "through"))
        reached = scratch.write(reached.unionByName(on.select("bucket", "end", F.concat("path", "more").alias("path"), F.concat("above", "through").alias("above"))))
        ahead = links.select("bucket", F.col("at").alias("end"), F.col("end").alias("_end"), F.col("more").alias("_more"), F.col("through").alias("_through"))
        further = links.join(ahead, ["bucket", "end"]).filter(~F.arrays_overlap(F.concat(F.array("at"), "through"), "_through"))
        links = scratch.write(further.select("bucket", "at", F.col("_end").alias("end"), F.concat("more", "_more").alias("more"), F.concat("through", "_through").alias("through")))
    above = reached.select("bucket", F.col("end").alias("dir_id"), "path")
    return named.join(above, ["bucket", "dir_id"]).select("bucket", F.concat("path", F.lit("/"), "name").alias("path"), "dir_id", "name", "child_id")


def listing(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    """(bucket, dir_id, cookie, name, child_id, there): '.' is cookie 1, '..' 2, names follow in byte order from 3.

    Entries that name no inode keep their cookie but are not shown.
    """
    dirs = inodes.filter(F.col("type") == S.DIR)
    up = F.when(F.col("id") == ROOT_ID, F.col("id")).otherwise(F.coalesce("parent", "id"))
    dots = dirs.select("bucket", F.col("id").alias("dir_id"), F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("cookie"), F.lit(".").alias("name"), F.col("id").alias("child_id")),
        F.struct(F.lit(2).cast("bigint").alias("cookie"), F.lit("..").alias("name"), up.alias("child_id")))).alias("e")).select("bucket", "dir_id", "e.*", F.lit(True).alias("there"))
    rank = F.row_number().over(Window.partitionBy("bucket", "dir_id").orderBy("name"))
    real = dirents.join(inodes.select("bucket", F.col("id").alias("child_id"), F.lit(True).alias("_t")), ["bucket", "child_id"], "left")
    real = real.select("bucket", "dir_id", (rank + 2).cast("bigint").alias("cookie"), "name", "child_id", F.col("_t").isNotNull().alias("there"))
    return dots.unionByName(real)


def read_directory(listed: DataFrame, after: Column, budget: int, cost: int = ENTRY_COST) -> DataFrame:
    """One reply per directory: the entries after cookie ``after`` that the byte budget holds, one at least, and eof.

    An entry costs ``cost`` and its name's bytes; the budget is at least twice ``cost``.
    """
    room = max(budget, 2 * cost)
    by = Window.partitionBy("bucket", "dir_id").orderBy("cookie")
    shown = listed.filter("there").drop("there")
    last = shown.groupBy("bucket", "dir_id").agg(F.max("cookie").alias("_last"))
    # so many entries hold more than any reply; the rest of a directory stays where it is
    near = shown.filter(F.col("cookie") > after).withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= room // cost + 1)
    used = F.sum(F.octet_length("name") + cost).over(by.rowsBetween(Window.unboundedPreceding, 0))
    fits = near.withColumn("_u", used).filter((F.col("_u") <= room) | (F.col("_rn") == 1))
    end = F.max("cookie").over(Window.partitionBy("bucket", "dir_id"))
    return fits.withColumn("_end", end).join(last, ["bucket", "dir_id"]).withColumn("eof", F.col("_end") == F.col("_last")).drop("_u", "_rn", "_last", "_end")


def cookie_status(cookie: Column, length: Column, verifier: Column, current: Column) -> Column:
    """BADCOOKIE beyond the listing or under a verifier that is neither zero nor current."""
    stale = (cookie > 0) & (verifier != current) & (verifier != F.lit(bytes(8)))
    return F.when(stale | (cookie > length), S.BADCOOKIE).otherwise(S.OK)


def with_attributes(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    """READDIRPLUS: entries with handle and attributes."""
    own = inodes.select("bucket", F.col("id").alias("child_id"), handle(F.col("id"), F.col("gen")).alias("handle"), "type", "mode", "size", "mtime_ns")
    return entries.join(own, ["bucket", "child_id"])


def filesystem_stat(inodes: DataFrame, chunk_refs: DataFrame) -> DataFrame:
    """(bucket, used, total, files, total_files): used is the stored bytes of all files, holes not counted."""
    used = chunk_refs.groupBy("bucket").agg(F.coalesce(F.sum(F.when(F.col("hash").isNotNull(), F.col("size"))), F.lit(0)).alias("used"))
    files = inodes.groupBy("bucket").agg(F.count("*").alias("files"))
    return files.join(used, "bucket", "left").select(
        "bucket", F.coalesce("used", F.lit(0)).alias("used"), (F.coalesce("used", F.lit(0)) + HEADROOM_BYTES).alias("total"), "files", (F.col("files") + HEADROOM_FILES).alias("total_files"))


def oversize(inodes: DataFrame, limit: Column) -> DataFrame:
    """(bucket, n, largest) of files beyond the limit."""
    return inodes.filter((F.col("type") == S.REG) & (F.col("size") > limit)).groupBy("bucket").agg(F.count("*").alias("n"), F.max("size").alias("largest"))


def is_ancestor(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """``pairs`` (bucket, id, below_id) with ``inside``: whether below_id is id or lies under it; closure is hierarchy.descendants."""
    held = closure.select("bucket", "id", "below_id", F.lit(True).alias("_in"))
    return pairs.join(held, ["bucket", "id", "below_id"], "left").withColumn("inside", F.col("_in").isNotNull() | (F.col("id") == F.col("below_id"))).drop("_in")


def lies_under(pairs: DataFrame, trails: DataFrame) -> DataFrame:
    """is_ancestor from the trails of hierarchy(trail=True): one row a pair is joined, not every pair of an ancestor and a node."""
    held = trails.select("bucket", F.col("id").alias("below_id"), "above")
    return pairs.join(held, ["bucket", "below_id"], "left").withColumn("inside", F.coalesce(F.array_contains("above", F.col("id")), F.lit(False)) | (F.col("id") == F.col("below_id"))).drop("above")


def link_counts(inodes: DataFrame, dirents: DataFrame) -> DataFrame:
    """(bucket, id, links): a directory's links are 2 and its subdirectories."""
    kids = inodes.filter(F.col("type") == S.DIR).select("bucket", F.col("id").alias("child_id"))
    below = dirents.join(kids, ["bucket", "child_id"], "left_semi").groupBy("bucket", F.col("dir_id").alias("id")).agg(F.count_distinct("child_id").alias("_n"))
    return inodes.filter(F.col("type") == S.DIR).select("bucket", "id").join(below, ["bucket", "id"], "left").select("bucket", "id", (F.coalesce("_n", F.lit(0)) + 2).alias("links"))
