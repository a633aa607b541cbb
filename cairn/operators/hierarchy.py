"""Parent–child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairn.operators.snapshots import standing_inodes
from cairn.planning import broadcast_if_small
from cairn.scratch import Scratch

#: One node in so many is a splitter, at which a walk rests.
SPLIT = 64
ROOT_ID = 1
KEY = ["bucket", "id"]


def newest_tree(snapshots: DataFrame, inodes: DataFrame, dirents: DataFrame) -> DataFrame:
    """(bucket, id, parent, name) of each bucket's newest snapshot.

    Of an inode's rows the latest stands. The name is that of the entry for the
    inode in its parent directory, the bytewise smallest if several, else null.
    """
    newest = snapshots.filter("bucket IS NOT NULL AND epoch IS NOT NULL").groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    newest = broadcast_if_small(newest, snapshots, ("bucket",))
    nodes = standing_inodes(inodes.join(newest, ["bucket", "epoch"], "left_semi"), {"parent": F.col("parent")}, "parent").select(*KEY, "parent")
    names = (
        dirents.join(newest, ["bucket", "epoch"], "left_semi").filter("name IS NOT NULL")
        .groupBy("bucket", F.col("dir_id").alias("parent"), F.col("child_id").alias("id")).agg(F.min("name").alias("name"))
    )
    return nodes.join(names, ["bucket", "parent", "id"], "left").select(*KEY, "parent", "name")


def hierarchy(tree: DataFrame, split: int = SPLIT, trail: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(bucket, id, root_id, depth, path) of every node of ``tree``, (bucket, id, parent, name).

    With ``trail`` there is also ``above``, the ids from the topmost node down to
    the parent, from which ``descendants`` makes the closure.

    Inode 1 is a root, as is a node whose parent is null or not in the tree. A
    root's path is '/' or '#<id>'; another's is its parent's, '/' and its name, a
    missing name being '#<id>'. A node on a circle, its own parent included, or
    below one has root_id and depth -1 and an empty path. Repeated rows of a node
    count once; one that comes with several parents keeps the smallest, nulls
    last; rows without bucket or id are dropped; an empty tree gives no rows.

    A hash makes one node in ``split`` a splitter. Every node walks to the next
    splitter or root above it, in jumps that double. What remains walking is on
    or below a circle without a splitter and is settled among itself. The graph
    of splitters, smaller by ``split``, is solved the same way, and each node's
    stretch of path is put behind its splitter's. Only the nodes still walking are
    shuffled in a round; each round is written to the shared folder.
    """
    scratch = scratch or Scratch(tree.sparkSession, "hierarchy")
    tree = tree.filter("bucket IS NOT NULL AND id IS NOT NULL").groupBy(*KEY).agg(F.min(F.struct(F.col("parent").isNull().alias("_n"), "parent", "name")).alias("_p")).select(*KEY, "_p.parent", "_p.name")
    here = tree.select("bucket", F.col("id").alias("parent"), F.lit(True).alias("_there"))
    is_root = (F.col("id") == ROOT_ID) | F.col("parent").isNull() | F.col("_there").isNull()
    own = F.array("parent") if trail else F.array().cast("array<bigint>")
    walk = tree.join(here, ["bucket", "parent"], "left").select(*KEY, "parent", "name", is_root.alias("is_root")).select(
        *KEY, "is_root",
        F.when(F.col("is_root"), F.col("id")).otherwise(F.col("parent")).alias("at"),
        F.when(F.col("is_root"), 0).otherwise(1).cast("bigint").alias("hops"),
        F.when(F.col("is_root"), "").otherwise(F.concat(F.lit("/"), F.coalesce("name", F.concat(F.lit("#"), F.col("id").cast("string"))))).alias("path"),
        F.when(F.col("is_root"), F.array().cast("array<bigint>")).otherwise(own).alias("above"),
        (F.col("is_root") | _splits(F.col("bucket"), F.col("parent"), split) | (F.col("parent") == ROOT_ID)).alias("done"),
    )
    # a jump to inode 1 rests there: if it is in the tree it is a root, and that it is the join has shown
    walk, stuck = _resolve(walk, scratch)

    stops = walk.filter("is_root").select(*KEY, F.col("id").alias("at"), "hops", "path", "above", F.lit(True).alias("done"))
    goes = walk.filter(~F.col("is_root") & _splits(F.col("bucket"), F.col("id"), split)).select(*KEY, "at", "hops", "path", "above", F.lit(False).alias("done"))
    lost = stuck.filter(_splits(F.col("bucket"), F.col("id"), split)).select(*KEY, F.lit(-1).cast("bigint").alias("at"), "hops", F.lit("").alias("path"), F.array().cast("array<bigint>").alias("above"), F.lit(True).alias("done"))
    solved, _ = _resolve(stops.unionByName(goes).unionByName(lost), scratch)

    top = solved.select("bucket", F.col("id").alias("at"), F.col("at").alias("_root"), F.col("hops").alias("_hops"), F.col("path").alias("_path"), F.col("above").alias("_above"))
    known = walk.filter(F.col("at") != ROOT_ID).join(top, ["bucket", "at"], "left")
    known = known.unionByName(walk.filter(F.col("at") == ROOT_ID).withColumns({
        "_root": F.col("at"), "_hops": F.lit(0).cast("bigint"), "_path": F.lit(""), "_above": F.array().cast("array<bigint>")}))
    cyclic = F.coalesce(F.col("_root"), F.lit(-1)) == -1
    start = F.when(F.col("_root") == ROOT_ID, "").otherwise(F.concat(F.lit("#"), F.col("_root").cast("string")))
    path = F.concat(start, "_path", "path")
    found = known.select(
        *KEY, F.when(cyclic, -1).otherwise(F.col("_root")).alias("root_id"), F.when(cyclic, -1).otherwise(F.col("_hops") + F.col("hops")).alias("depth"),
        F.when(cyclic, "").when(path == "", "/").otherwise(path).alias("path"),
        F.when(cyclic, F.array().cast("array<bigint>")).otherwise(F.concat("_above", "above")).alias("above"),
    )
    minus = F.lit(-1).cast("bigint")
    found = found.unionByName(stuck.select(*KEY, minus.alias("root_id"), minus.alias("depth"), F.lit("").alias("path"), F.array().cast("array<bigint>").alias("above")))
    return found if trail else found.drop("above")


def _splits(bucket: Column, node: Column, split: int) -> Column:
    return F.pmod(F.xxhash64(bucket, node), F.lit(split)) == 0


def _resolve(state: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Follow ``at`` until a done row is met: (done rows, rows that never meet one).

    A round puts the row at ``at`` behind each row not done, so jumps double. When
    a round after the first few settles little of what was open, those in circles are
    found by their pointers alone and set aside, before their paths, which would
    double with every round, are carried on.
    """
    done, circling, before, rounds = None, None, 0, 0
    while True:
        seen = Observation()
        written = scratch.write(state.observe(seen, F.count(F.when(~F.col("done"), 1)).alias("left")))
        left = seen.get["left"]
        settled, open_ = written.filter("done"), written.filter(~F.col("done"))
        done = settled if done is None else done.unionByName(settled)
        rounds += 1
        if left and circling is None and (rounds > 4 and left * 4 > before * 3 or rounds > 8):
            circles = _circles(open_.select(*KEY, "at"), left, scratch)
            circling = open_.join(circles, KEY, "left_semi")
            open_ = scratch.write(open_.join(circles, KEY, "left_anti").hint("rebalance"))
            left = open_.count()
        if not left:
            return done, open_ if circling is None else circling
        before = left
        ahead = done.unionByName(open_).select(
            "bucket", F.col("id").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("path").alias("_path"), F.col("above").alias("_above"), F.col("done").alias("_done")
        )
        rest = [c for c in written.columns if c not in ("at", "hops", "path", "above", "done")]
        state = open_.join(ahead, ["bucket", "at"]).select(
            *rest, F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.concat("_path", "path").alias("path"),
            F.concat("_above", "above").alias("above"), F.col("_done").alias("done"),
        ).hint("rebalance")


def _circles(open_: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """(bucket, id) of the rows of (bucket, id, at) that never leave them.

    A row stays if the row its jump leads to stays; jumps double. Once a round
    loses none, every jump ends among those left, which therefore stay for good.
    """
    while True:
        ahead = open_.select("bucket", F.col("id").alias("at"), F.col("at").alias("_at"))
        open_ = scratch.write(open_.join(ahead, ["bucket", "at"]).select(*KEY, F.col("_at").alias("at")).hint("rebalance"))
        left = open_.count()
        if left == count:
            return open_.select(*KEY)
        count = left


def descendants(found: DataFrame) -> DataFrame:
    """(bucket, id, below_id, distance): everything below each node, from hierarchy(trail=True).

    As many rows as the depths add up to; nodes of circles are below nothing.
    """
    return found.select("bucket", "depth", F.col("id").alias("below_id"), F.posexplode("above").alias("_i", "id")).select("bucket", "id", "below_id", (F.col("depth") - F.col("_i")).alias("distance"))
