"""File contents as chunks: cutting, hashing, reading, writing, truncating, extents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import status as S
from cairn.operators.attributes import MAX_CHUNKS, read_end, span, whole_division

CHUNK_SIZE, LEAST_CHUNK_SIZE = 1 << 20, 4096
#: Chunks of one file that one task puts in order.
STRETCH = 65_536


def _div(c: Column | str, by: int) -> Column:
    """Whole division of numbers from 0 on; a double would lose bytes beyond 2^53."""
    return whole_division(F.col(c) if isinstance(c, str) else c, F.lit(by))


def chunk_files(files: DataFrame, keys: list[str], data: str, chunk_size: int) -> DataFrame:
    """(keys…, idx, hash, size, data): chunk i holds the bytes from i·chunk_size on; null and empty files have none."""
    n = _div(F.octet_length(data).cast("bigint") + (chunk_size - 1), chunk_size).cast("int")
    idx = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("idx")
    cut = files.select(*keys, data, idx).select(*keys, "idx", F.substring(F.col(data), F.col("idx") * chunk_size + 1, F.lit(chunk_size)).alias("data"))
    return cut.select(*keys, "idx", F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("bigint").alias("size"), "data")


def stored_chunks(cut: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(hash, len, data) to upload: each distinct chunk once, none that ``known`` (hash) has."""
    new = cut.groupBy("hash").agg(F.first("size").alias("len"), F.first("data").alias("data"))
    return new if known is None else new.join(known.select("hash").distinct(), "hash", "left_anti")


def dedup_report(cut: DataFrame) -> DataFrame:
    """(hash, n_refs, len) of chunks referred to more than once."""
    return cut.groupBy("hash").agg(F.count("*").alias("n_refs"), F.max("size").alias("len")).filter("n_refs > 1")


def used_bytes(refs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, used, holes): bytes of stored chunks and the number of holes."""
    return refs.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("hash").isNotNull(), F.col("size"))), F.lit(0)).alias("used"), F.count(F.when(F.col("hash").isNull(), 1)).alias("holes"))


def zeros(n: Column) -> Column:
    return F.rpad(F.unhex(F.lit("")), n.cast("int"), F.unhex(F.lit("00")))


def overlay(refs: DataFrame, dirty: DataFrame, keys: list[str]) -> DataFrame:
    """References with buffered chunks (keys…, idx, data) in their place: a buffer wins over what is stored."""
    d = dirty.select(*keys, "idx", F.col("data").alias("_d"))
    return refs.join(d, [*keys, "idx"], "full").select(*keys, "idx", F.when(F.col("_d").isNull(), F.col("hash")).alias("hash"), F.coalesce(F.octet_length("_d").cast("bigint"), F.col("size")).alias("size"), F.col("_d").alias("buffered"))


def covered(requests: DataFrame, chunk_size: int) -> DataFrame:
    """Requests (bucket, id, size, off, count, …) exploded to the chunks they touch: idx, within, take, and end.

    The range join of requests with chunks becomes an equi-join on idx.
    """
    ranged = requests.withColumn("end", read_end(F.col("off"), F.col("count"), F.col("size"))).filter(F.col("end") > F.col("off"))
    idx = F.explode(F.sequence(_div("off", chunk_size).cast("int"), _div(F.col("end") - 1, chunk_size).cast("int"))).alias("idx")
    cut = ranged.select("*", idx)
    within, take = span(F.col("off"), F.col("end"), F.col("idx").cast("bigint"), F.lit(chunk_size))
    return cut.withColumns({"within": within, "take": take})


def read_ranges(requests: DataFrame, refs: DataFrame, chunks: DataFrame, chunk_size: int, trims: DataFrame | None = None) -> DataFrame:
    """(request columns, data, eof, status) of reads of stored files.

    ``requests`` has req, bucket, id, size, off and count; ``refs`` (bucket, id,
    idx, hash); ``chunks`` (hash, data); ``trims`` (bucket, id, idx, to_len) of
    cuts not yet applied. Holes, missing tails, bytes past a chunk's end or a trim
    read zero. At or beyond the end nothing is read, with eof. A chunk that is
    referred to but not stored makes the read fail with IO and null data.
    Metadata is joined first, bytes last.
    """
    parts = covered(requests, chunk_size).join(refs.select("bucket", "id", "idx", "hash"), ["bucket", "id", "idx"], "left")
    if trims is not None:
        parts = parts.join(trims.groupBy("bucket", "id", "idx").agg(F.min("to_len").alias("to_len")), ["bucket", "id", "idx"], "left")
    else:
        parts = parts.withColumn("to_len", F.lit(None).cast("bigint"))
    parts = parts.join(chunks.select("hash", F.col("data").alias("_d")), "hash", "left")
    kept = F.when(F.col("to_len").isNull(), F.col("_d")).otherwise(F.substring(F.col("_d"), F.lit(1), F.col("to_len").cast("int")))
    piece = F.coalesce(F.substring(kept, F.col("within").cast("int") + 1, F.col("take").cast("int")), F.unhex(F.lit("")))
    piece = F.rpad(piece, F.col("take").cast("int"), F.unhex(F.lit("00")))
    lost = F.col("hash").isNotNull() & F.col("_d").isNull()
    read = parts.groupBy("req").agg(F.array_sort(F.collect_list(F.struct("idx", piece.alias("piece")))).alias("_l"), F.max(lost).alias("_lost"))
    whole = F.aggregate("_l", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["piece"]))
    return requests.join(read.select("req", whole.alias("_w"), "_lost"), "req", "left").select(
        "*", F.when(~F.coalesce("_lost", F.lit(False)), F.coalesce("_w", F.unhex(F.lit("")))).alias("data"),
        ((F.col("off") >= F.col("size")) | (F.col("off") + F.col("count") >= F.col("size"))).alias("eof"),
        F.when(F.coalesce("_lost", F.lit(False)), S.IO).otherwise(S.OK).alias("status")).drop("_w", "_lost")


def write_status(off: Column, length: Column, limit: Column) -> tuple[Column, Column]:
    """(status, bytes taken): an empty write succeeds, one from the limit on is FBIG, one across it is cut short."""
    code = F.when(length == 0, S.OK).when(off >= limit, S.FBIG).otherwise(S.OK)
    return code, F.when((length == 0) | (off >= limit), F.lit(0)).otherwise(F.least(length, limit - off))


def apply_writes(writes: DataFrame, refs: DataFrame, chunks: DataFrame, keys: list[str], chunk_size: int) -> DataFrame:
    """(keys…, idx, data): the buffered chunks after ordered writes (keys…, seq, off, data).

    Each write is cut to the chunks it touches; a chunk's patches are folded in
    the order of seq onto its stored bytes. A patch beyond what is there pads
    with zeros. A chunk wholly rewritten is read in vain only if stored.
    """
    length = F.octet_length("data")
    cut = writes.filter(length > 0).select("*", F.explode(F.sequence(_div("off", chunk_size).cast("int"), _div(F.col("off") + length - 1, chunk_size).cast("int"))).alias("idx"))
    at = F.greatest(F.col("off") - F.col("idx") * chunk_size, F.lit(0))
    skip = F.greatest(F.col("idx") * chunk_size - F.col("off"), F.lit(0))
    patch = F.struct("seq", at.cast("int").alias("at"), F.substring(F.col("data"), skip.cast("int") + 1, (F.lit(chunk_size) - at).cast("int")).alias("bytes"))
    patches = cut.select(*keys, "idx", patch.alias("p")).groupBy(*keys, "idx").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    stored = patches.join(refs.select(*keys, "idx", "hash"), [*keys, "idx"], "left").join(chunks.select("hash", F.col("data").alias("_d")), "hash", "left")

    def fold(acc: Column, p: Column) -> Column:
        end = p["at"] + F.octet_length(p["bytes"])
        head = F.rpad(F.substring(acc, F.lit(1), p["at"]), p["at"], F.unhex(F.lit("00")))
        return F.concat(head, p["bytes"], F.substring(acc, end + 1, F.greatest(F.octet_length(acc) - end, F.lit(0))))

    return stored.select(*keys, "idx", F.aggregate("ps", F.coalesce("_d", F.unhex(F.lit(""))), fold).alias("data"))


def flush(dirty: DataFrame, refs: DataFrame, keys: list[str], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(references repointed, chunks to upload) for buffered chunks; every gap below the last index becomes a hole."""
    hashed = dirty.select(*keys, "idx", F.sha2("data", 256).alias("_h"), F.octet_length("data").cast("bigint").alias("_s"), "data")
    upload = stored_chunks(hashed.select(F.col("_h").alias("hash"), F.col("_s").alias("size"), "data"), known)
    new = refs.select(*keys, "idx", "hash", "size").join(hashed.drop("data"), [*keys, "idx"], "full").select(
        *keys, "idx", F.coalesce("_h", "hash").alias("hash"), F.coalesce("_s", "size").alias("size"))
    full = new.groupBy(*keys).agg(F.max("idx").alias("_m")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_m"))).alias("idx"))
    return full.join(new, [*keys, "idx"], "left").select(*keys, "idx", "hash", F.coalesce("size", F.lit(0)).alias("size")), upload


def truncate(refs: DataFrame, cuts: DataFrame, keys: list[str], chunk_size: int) -> tuple[DataFrame, DataFrame]:
    """(references, pending trims) after setting files (keys…, old_size, new_size) to new sizes.

    Chunks past the end go; a cut into a stored chunk becomes a pending trim
    (keys…, idx, to_len); growth appends holes. ``cuts`` has one row per file;
    files not in it stay.
    """
    joined = refs.join(cuts, keys, "left")
    last = _div(F.col("new_size") + (chunk_size - 1), chunk_size)
    kept = joined.filter(F.col("new_size").isNull() | (F.col("idx") < last))
    trims = kept.filter((F.col("idx") == last - 1) & (F.col("new_size") < F.col("old_size")) & (F.col("new_size") % chunk_size != 0) & F.col("hash").isNotNull()).select(*keys, "idx", (F.col("new_size") % chunk_size).alias("to_len"))
    here = refs.groupBy(*keys).agg((F.max("idx") + 1).alias("_n"))
    grown = cuts.join(here, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(F.col("_n") < last)
    holes = grown.select(*keys, F.explode(F.sequence(F.col("_n").cast("int"), (last - 1).cast("int"))).alias("idx")).select(*keys, "idx", F.lit(None).cast("string").alias("hash"), F.lit(0).cast("bigint").alias("size"))
    return kept.select(*keys, "idx", "hash", "size").unionByName(holes), trims


def least_trims(*trims: DataFrame, keys: list[str]) -> DataFrame:
    """Pending trims together: the least wins, so bytes once cut never come back."""
    every = reduce(DataFrame.unionByName, trims)
    return every.groupBy(*keys, "idx").agg(F.min("to_len").alias("to_len"))


def spans(refs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, idx, start, size): where each chunk of any length begins, by prefix sum.

    A file is cut into blocks of STRETCH chunks, so one of a third of all chunks
    is summed by many tasks; only the blocks' sums meet in one.
    """
    return _blocks(refs.select(*keys, "idx", "size"), keys).select(*keys, "idx", "start", "size")


def _blocks(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with _b, the block, and start."""
    cut = refs.withColumn("_b", _div("idx", STRETCH))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_b").agg(F.sum("size").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = reduce(lambda x, y: x & y, [F.col(f"own.{k}").eqNullSafe(F.col(f"sums.{k}")) for k in [*keys, "_b"]])
    return own.alias("own").join(sums.alias("sums"), same).select("own.*", (F.col("_in") + F.col("_before")).alias("start")).drop("_in")


def extents(refs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, off, len, hole): ordered, gap-free stretches of data and holes, neighbours of a kind merged.

    Stretches are found within blocks of a file (spans) and put together across
    them by their bounds, of which there are few.
    """
    rows = _blocks(refs.select(*keys, "idx", "size", F.col("hash").isNull().alias("hole")), keys)
    runs = _runs(rows, [*keys, "_b"], "idx").groupBy(*keys, "_b", "_run").agg(F.min("start").alias("off"), F.sum("size").alias("len"), F.first("hole").alias("hole"))
    whole = _runs(runs.withColumn("_at", F.struct("_b", "_run")).drop("_run"), keys, "_at")
    return whole.groupBy(*keys, "_run").agg(F.min("off").alias("off"), F.sum("len").alias("len"), F.first("hole").alias("hole")).drop("_run")


def _runs(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with _run, which counts the changes of ``hole``."""
    by = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.lag("hole").over(by) != F.col("hole")), F.lit(True)).cast("int")
    return rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by)).drop("_new")


def punch(refs: DataFrame, holes: DataFrame, keys: list[str], chunk_size: int) -> DataFrame:
    """References with those wholly inside (keys…, off, len) made holes; sizes stay. punch_edges has the chunks that are cut."""
    inside = refs.join(holes, keys, "left")
    gone = (F.col("idx").cast("bigint") * chunk_size >= F.col("off")) & ((F.col("idx").cast("bigint") + 1) * chunk_size <= F.col("off") + F.col("len"))
    marked = inside.groupBy(*keys, "idx").agg(F.first("hash").alias("hash"), F.first("size").alias("size"), F.max(F.coalesce(gone, F.lit(False))).alias("_g"))
    return marked.select(*keys, "idx", F.when(~F.col("_g"), F.col("hash")).alias("hash"), "size")


def punch_edges(refs: DataFrame, chunks: DataFrame, holes: DataFrame, keys: list[str], chunk_size: int) -> DataFrame:
    """(keys…, idx, data): the buffered chunks of which a hole (keys…, off, len) takes a part, zeros in its place; their length stays.

    Of one hole these are two at most. A chunk cut by several holes loses all of
    their parts. Chunks that are holes already are not written.
    """
    first, last = _div("off", chunk_size), _div(F.col("off") + F.col("len") - 1, chunk_size)
    edges = holes.filter("len > 0").select(*keys, "off", "len", F.explode(F.array_distinct(F.array(first, last))).alias("idx"))
    at = F.col("idx") * chunk_size
    lo, hi = F.greatest(F.col("off") - at, F.lit(0)), F.least(F.col("off") + F.col("len") - at, F.lit(chunk_size))
    cuts = edges.select(*keys, F.col("idx").cast("int").alias("idx"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")).filter(~((F.col("lo") == 0) & (F.col("hi") == chunk_size)))
    parts = cuts.groupBy(*keys, "idx").agg(F.collect_set(F.struct("lo", "hi")).alias("_cuts"))
    stored = parts.join(refs.filter("hash IS NOT NULL").select(*keys, "idx", "hash"), [*keys, "idx"]).join(chunks.select("hash", F.col("data").alias("_d")), "hash")
    zeroed = lambda acc, c: F.concat(
        F.substring(acc, F.lit(1), c["lo"]), zeros(F.greatest(F.least(c["hi"], F.octet_length(acc)) - c["lo"], F.lit(0))), F.substring(acc, c["hi"] + 1, F.lit(chunk_size)))
    return stored.select(*keys, "idx", F.aggregate("_cuts", F.col("_d"), zeroed).alias("data"))


def settle(refs: DataFrame, chunks: DataFrame, keys: list[str], dirty: DataFrame | None = None, trims: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(references, chunks to upload) with every buffer and pending trim of all files applied: what a seal needs.

    A trimmed chunk is cut to its new length and stored under its new name; where
    a chunk is buffered as well, the buffer, which has the cut already, stands.
    No file is left unsettled.
    """
    cut = refs.select(*keys, "idx").limit(0).withColumn("data", F.unhex(F.lit("")))
    if trims is not None:
        least = trims.groupBy(*keys, "idx").agg(F.min("to_len").alias("to_len"))
        stored = least.join(refs.filter("hash IS NOT NULL").select(*keys, "idx", "hash"), [*keys, "idx"]).join(chunks.select("hash", "data"), "hash")
        cut = stored.select(*keys, "idx", F.substring(F.col("data"), F.lit(1), F.col("to_len").cast("int")).alias("data"))
    if dirty is not None:
        cut = cut.join(dirty.select(*keys, "idx"), [*keys, "idx"], "left_anti").unionByName(dirty.select(*keys, "idx", "data"))
    return flush(cut, refs, keys, known)


def drop_buffers(dirty: DataFrame, gone: DataFrame, keys: list[str], mount: list[str]) -> tuple[DataFrame, DataFrame]:
    """(buffers left, (mount…, released)) after inodes (keys…) are gone: nothing will flush theirs, so their charge is given back once."""
    lost = gone.select(*keys).distinct()
    released = dirty.join(lost, keys, "left_semi").groupBy(*mount).agg(F.sum("capacity").alias("released"))
    return dirty.join(lost, keys, "left_anti"), released


def clone_range(refs: DataFrame, clones: DataFrame) -> DataFrame:
    """(bucket, id, idx, hash, size) written by clones (bucket, src_id, src_idx, n, dst_id, dst_idx): references, no data.

    A clone that overlaps itself or passes the source's end gives nothing, whole or not at all.
    """
    size = refs.groupBy("bucket", F.col("id").alias("src_id")).agg((F.max("idx") + 1).alias("_len"))
    valid = clones.join(size, ["bucket", "src_id"]).filter((F.col("src_idx") + F.col("n") <= F.col("_len")) & ~((F.col("src_id") == F.col("dst_id")) & (F.abs(F.col("src_idx") - F.col("dst_idx")) < F.col("n"))))
    own = refs.select("bucket", F.col("id").alias("src_id"), "idx", "hash", "size")
    return valid.join(own, ["bucket", "src_id"]).filter((F.col("idx") >= F.col("src_idx")) & (F.col("idx") < F.col("src_idx") + F.col("n"))).select(
        "bucket", F.col("dst_id").alias("id"), (F.col("idx") - F.col("src_idx") + F.col("dst_idx")).alias("idx"), "hash", "size")


def locate(requests: DataFrame, spanned: DataFrame, keys: list[str]) -> DataFrame:
    """Requests (keys…, at) with the idx whose span holds the byte and the offset within."""
    return requests.join(spanned, keys).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("size"))).select(*requests.columns, "idx", (F.col("at") - F.col("start")).alias("within"))


def pre_operation(versions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Size and times before each change: the version before."""
    by = Window.partitionBy(*keys).orderBy(order)
    return versions.select("*", *[F.lag(c).over(by).alias(f"pre_{c}") for c in ("size", "mtime_ns", "ctime_ns")])


def unpinned(gone: DataFrame, pins: DataFrame) -> DataFrame:
    """Inodes to drop: those without a name that nobody holds."""
    return gone.join(pins.select("bucket", "id").distinct(), ["bucket", "id"], "left_anti")


def verify(chunks: DataFrame) -> DataFrame:
    """(hash, status): IO where the bytes are not those the hash names."""
    return chunks.select("hash", F.when(F.sha2("data", 256) == F.col("hash"), S.OK).otherwise(S.IO).alias("status"))


def missing_chunks(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """References to chunks that are not stored; holes are none."""
    return refs.filter("hash IS NOT NULL").join(chunks.select("hash").distinct(), "hash", "left_anti")


def limit_bytes(chunk_size: Column) -> Column:
    return chunk_size * MAX_CHUNKS
