"""Handles, names, attributes and byte positions as expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import status as S
from cairn.functions.spelling import low_mode

MAX_CHUNKS = 1 << 20
HANDLE_BYTES, NAME_BYTES = 16, 255


def handle(id_: Column, gen: Column) -> Column:
    """16 bytes: id and generation, big-endian."""
    return F.unhex(F.concat(F.lpad(F.hex(id_), 16, "0"), F.lpad(F.hex(gen), 16, "0")))


def handle_parts(h: Column) -> tuple[Column, Column]:
    """(id, gen) of a handle of the right length, else nulls."""
    part = lambda at: F.when(F.octet_length(h) == HANDLE_BYTES, F.conv(F.substring(F.hex(h), at, 16), 16, -10).cast("bigint"))
    return part(1), part(17)


def resolve_handles(handles: DataFrame, inodes: DataFrame) -> DataFrame:
    """``handles`` (bucket, handle, …) with status and the inode's columns.

    A handle of another length is BADHANDLE, one whose inode is gone or has
    another generation STALE.
    """
    id_, gen = handle_parts(F.col("handle"))
    asked = handles.withColumns({"_id": id_, "_gen": gen})
    own = inodes.select(F.col("bucket").alias("_b"), *[c for c in inodes.columns if c != "bucket"])
    found = asked.join(own, (F.col("bucket") == F.col("_b")) & (F.col("_id") == F.col("id")) & (F.col("_gen") == F.col("gen")), "left")
    code = F.when(F.coalesce(F.octet_length("handle"), F.lit(0)) != HANDLE_BYTES, S.BADHANDLE).when(F.col("id").isNull(), S.STALE).otherwise(S.OK)
    return found.withColumn("status", code).drop("_b", "_id", "_gen")


def attributes(inodes: DataFrame) -> DataFrame:
    """What GETATTR shows of an inode: mode without type bits, directories counting a link at least."""
    return inodes.select("bucket", "id", "gen", "type", low_mode(F.col("mode")).alias("mode"), "nlink", "uid", "gid", "size", "atime_ns", "mtime_ns", "ctime_ns")


def name_status(name: Column) -> Column:
    """INVAL for none, '.' and '..'; NAMETOOLONG beyond 255 bytes; INVAL with a slash or NUL."""
    return (
        F.when(name.isNull() | name.isin("", ".", ".."), S.INVAL).when(F.octet_length(name) > NAME_BYTES, S.NAMETOOLONG)
        .when((F.instr(name, "/") > 0) | (F.instr(name, "\0") > 0), S.INVAL).otherwise(S.OK)
    )


def link_target(type_: Column, target: Column) -> tuple[Column, Column]:
    """(status, target) of READLINK."""
    return F.when(type_ == S.LNK, S.OK).otherwise(S.INVAL), F.when(type_ == S.LNK, target)


def mount_gate(mode: Column) -> Column:
    """What a mutation meets in each mount mode."""
    return F.when(mode == "Writable", S.OK).when(mode == "ReadOnly", S.ROFS).when(mode == "Diverged", S.STALE).otherwise(S.SERVERFAULT)


def whole_division(a: Column, b: Column) -> Column:
    """a div b, without the double that a quotient of longs would become."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def chunk_place(offset: Column, chunk_size: Column) -> tuple[Column, Column]:
    """(index, offset within) of a byte."""
    return whole_division(offset, chunk_size), offset % chunk_size


def read_end(offset: Column, count: Column, size: Column) -> Column:
    """Where a read ends; null at or beyond the end of the file."""
    return F.when(offset < size, offset + F.least(count, size - offset))


def span(offset: Column, end: Column, idx: Column, chunk_size: Column) -> tuple[Column, Column]:
    """(first byte within the chunk, bytes) of a range's part in chunk ``idx``."""
    start = F.greatest(offset, idx * chunk_size)
    return start - idx * chunk_size, F.greatest(F.least(end, (idx + 1) * chunk_size) - start, F.lit(0))


def max_file_size(chunk_size: Column) -> Column:
    return chunk_size * MAX_CHUNKS


def protocol_status(code: Column) -> Column:
    """Codes of the protocol pass, any other failure is IO."""
    known = [S.OK, S.PERM, S.NOENT, S.IO, S.ACCES, S.EXIST, S.NOTDIR, S.ISDIR, S.INVAL, S.FBIG, S.ROFS, S.NAMETOOLONG, S.NOTEMPTY, S.STALE, S.BADHANDLE, S.NOT_SYNC, S.BADCOOKIE, S.NOTSUPP, S.SERVERFAULT]
    return F.when(code.isin(*known), code).otherwise(S.IO)


def clean_etag(etag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(etag, "^W/", ""), '"', "")


def guard_status(ctime_ns: Column, guard_ns: Column) -> Column:
    """NOT_SYNC if a guard is given and the inode has changed since."""
    return F.when(guard_ns.isNotNull() & (ctime_ns != guard_ns), S.NOT_SYNC).otherwise(S.OK)


def _fnv(values: pd.Series) -> pd.Series:
    # Offset basis and prime of 64-bit FNV-1a.
    out = np.full(len(values), 0xCBF29CE484222325, np.uint64)
    raw = [v if v is not None else b"" for v in values]
    length = np.array([len(v) for v in raw])
    with np.errstate(over="ignore"):
        for at in range(int(length.max()) if len(raw) else 0):
            on = np.flatnonzero(length > at)
            out[on] = (out[on] ^ np.fromiter((raw[i][at] for i in on), np.uint64, len(on))) * np.uint64(0x100000001B3)
    return pd.Series([None if v is None else int(h).to_bytes(8, "big") for v, h in zip(values, out)])


def fnv1a64(c: Column) -> Column:
    """FNV-1a of a binary column as eight big-endian bytes; null of null."""
    return F.pandas_udf(_fnv, T.BinaryType())(c)


def filesystem_id(name: Column) -> Column:
    """The store name's FNV-1a as an unsigned number, which a BIGINT could not hold."""
    return F.conv(F.hex(fnv1a64(F.encode(name, "utf-8"))), 16, 10).cast("decimal(20,0)")


def directory_verifiers(dirents: DataFrame) -> DataFrame:
    """(bucket, dir_id, verifier): FNV-1a over a directory's sorted names, each ended by NUL."""
    names = F.array_join(F.transform(F.array_sort(F.collect_set("name")), lambda n: F.concat(n, F.lit("\0"))), "")
    return dirents.groupBy("bucket", "dir_id").agg(names.alias("_n")).select("bucket", "dir_id", fnv1a64(F.encode("_n", "utf-8")).alias("verifier"))
