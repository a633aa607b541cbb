"""Permission rules as expressions over a batch of requests.

Each takes columns and gives a status column: 0 allows. ``Who`` names the
caller's columns, ``What`` those of the object asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import status as S

READ, WRITE, EXEC = 4, 2, 1
# Bits of an ACCESS reply.
A_READ, A_LOOKUP, A_MODIFY, A_EXTEND, A_DELETE, A_EXECUTE = 1, 2, 4, 8, 16, 32


@dataclass(frozen=True)
class Who:
    uid: Column
    gid: Column
    gids: Column


@dataclass(frozen=True)
class What:
    type: Column
    mode: Column
    uid: Column
    gid: Column

    @property
    def is_dir(self) -> Column:
        return self.type == S.DIR


def in_group(who: Who, gid: Column) -> Column:
    return F.coalesce((who.gid == gid) | F.array_contains(who.gids, gid), F.lit(False))


def permits(who: Who, what: What, want: int) -> Column:
    """Whether the mode bits grant all of ``want``: of one class only, owner before group before others."""
    if want & ~7:
        return F.lit(False)
    shift = F.when(who.uid == what.uid, 6).when(in_group(who, what.gid), 3).otherwise(0)
    granted = F.lit(False)
    for s in (0, 3, 6):
        granted = granted | ((shift == s) & (what.mode.bitwiseAND(F.lit(want << s)) == want << s))
    root = what.is_dir | (what.mode.bitwiseAND(F.lit(0o111)) != 0) if want & EXEC else F.lit(True)
    return F.when(who.uid == 0, root).otherwise(granted)


def root_or_owner(who: Who, what: What) -> Column:
    return F.coalesce((who.uid == 0) | (who.uid == what.uid), F.lit(False))


def _refuse(refused: Column, code: int) -> Column:
    return F.when(refused, code).otherwise(S.OK)


def file_access(who: Who, what: What, want: int) -> Column:
    """Reading and writing files: the owner of a regular file always may, and who may run one may read it."""
    grants = (who.uid == what.uid) | (permits(who, what, EXEC) if want == READ else F.lit(False))
    return F.when(what.is_dir, S.ISDIR).when(permits(who, what, want), S.OK).when((what.type == S.REG) & grants, S.OK).otherwise(S.ACCES)


def dir_access(who: Who, what: What, want: int) -> Column:
    return F.when(~what.is_dir, S.NOTDIR).when(permits(who, what, want), S.OK).otherwise(S.ACCES)


def chmod(who: Who, what: What) -> Column:
    return _refuse(~root_or_owner(who, what), S.PERM)


def chown(who: Who, what: What, uid: Column) -> Column:
    return _refuse(~root_or_owner(who, what) | ((who.uid != 0) & (uid != what.uid)), S.PERM)


def chgrp(who: Who, what: What, gid: Column) -> Column:
    return _refuse(~root_or_owner(who, what) | ((who.uid != 0) & ~in_group(who, gid)), S.PERM)


def set_times(who: Who, what: What) -> Column:
    return _refuse(~root_or_owner(who, what) & ~permits(who, what, WRITE), S.PERM)


def rename(who: Who, source: What, target: What) -> Column:
    both = permits(who, source, WRITE | EXEC) & permits(who, target, WRITE | EXEC)
    return F.when(~source.is_dir | ~target.is_dir, S.NOTDIR).when(both, S.OK).otherwise(S.ACCES)


def check(op: Column, who: Who, what: What, target: What | None = None, uid: Column | None = None, gid: Column | None = None) -> Column:
    """The rule of the operation named in ``op``; an unknown one is refused to everyone."""
    none = F.lit(None).cast("bigint")
    rules = {
        "read": file_access(who, what, READ), "write": file_access(who, what, WRITE), "truncate": file_access(who, what, WRITE),
        "chmod": chmod(who, what), "chown": chown(who, what, none if uid is None else uid), "chgrp": chgrp(who, what, none if gid is None else gid),
        "settimes": set_times(who, what), "lookup": dir_access(who, what, EXEC), "readdir": dir_access(who, what, READ),
        "addentry": dir_access(who, what, WRITE | EXEC), "removeentry": dir_access(who, what, WRITE | EXEC), "rename": rename(who, what, target or what),
    }
    out = reduce(lambda c, kv: c.when(op == kv[0], kv[1]), rules.items(), F.when(F.lit(False), S.OK))
    return out.otherwise(S.SERVERFAULT)


def all_of(*statuses: Column) -> Column:
    """The first refusal in order; none given allows."""
    if not statuses:
        return F.lit(S.OK)
    return F.coalesce(*[F.when(s != S.OK, s) for s in statuses], F.lit(S.OK))


def custom(rule: Callable[..., Column]) -> Callable[..., Column]:
    """A rule of one's own: any function of columns to a status column."""
    return rule


def access_bits(who: Who, what: What, want: Column | None = None, read_only: Column | None = None) -> Column:
    """The six-bit mask by mode alone: neither ownership nor execution adds to it."""
    r, w, x = (permits(who, what, b) for b in (READ, WRITE, EXEC))
    part = lambda test, bits: F.when(test, bits).otherwise(0)
    bits = (
        part(r, A_READ) + part(what.is_dir & (r | x), A_LOOKUP) + part(w, A_MODIFY + A_EXTEND) + part(w & what.is_dir, A_DELETE)
        + part(~what.is_dir & (what.mode.bitwiseAND(F.lit(0o111)) != 0) & x, A_EXECUTE)
    )
    if read_only is not None:
        bits = F.when(read_only, bits.bitwiseAND(F.lit(A_READ | A_LOOKUP | A_EXECUTE))).otherwise(bits)
    return bits if want is None else bits.bitwiseAND(want)


def set_attributes(who: Who, what: What, size: Column, mode: Column, uid: Column, gid: Column, atime: Column, mtime: Column) -> Column:
    """Whether a change of attributes is allowed: those given (not null) are asked for in this order."""
    asked = lambda given, rule: F.when(given.isNotNull(), rule).otherwise(S.OK)
    times = set_times(who, what)
    return all_of(
        asked(size, file_access(who, what, WRITE)), asked(mode, chmod(who, what)), asked(uid, chown(who, what, uid)),
        asked(gid, chgrp(who, what, gid)), asked(atime, times), asked(mtime, times),
    )
