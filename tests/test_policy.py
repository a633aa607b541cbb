"""Permission rules against a plain oracle over callers, types, modes and operations."""

import itertools

from pyspark.sql import functions as F

from cairn.functions import status as S
from cairn.operators import policy as P

CALLERS = {"root": (0, 0, [10]), "owner": (1000, 500, [501]), "owner in group": (1000, 100, [1]), "member": (2000, 100, [2]), "supplementary": (3000, 300, [302, 100]), "other": (4000, 400, [401]), "no groups": (4000, 400, None)}
OPS = ("read", "write", "truncate", "chmod", "chown", "chgrp", "settimes", "lookup", "readdir", "addentry", "removeentry", "rename", "odd")


def may(uid, gid, gids, kind, mode, want):
    if uid == 0:
        return not want & 1 or kind == 2 or bool(mode & 0o111)
    shift = 6 if uid == 1000 else 3 if 100 in [gid, *(gids or [])] else 0
    return (mode >> shift) & want == want


def verdict(op, c, kind, mode):
    uid = c[0]
    own = uid in (0, 1000)
    if op in ("read", "write", "truncate"):
        want = 4 if op == "read" else 2
        if kind == 2:
            return S.ISDIR
        ok = may(*c, kind, mode, want) or (kind == 1 and (uid == 1000 or (want == 4 and may(*c, kind, mode, 1))))
        return S.OK if ok else S.ACCES
    if op == "chmod":
        return S.OK if own else S.PERM
    if op == "chown":
        return S.OK if own and uid == 0 else S.PERM  # asks for uid 7
    if op == "chgrp":
        return S.OK if own and (uid == 0 or 501 in [c[1], *(c[2] or [])]) else S.PERM
    if op == "settimes":
        return S.OK if own or may(*c, kind, mode, 2) else S.PERM
    want = {"lookup": 1, "readdir": 4, "addentry": 3, "removeentry": 3, "rename": 3}.get(op)
    if want is None:
        return S.SERVERFAULT
    return S.NOTDIR if kind != 2 else S.OK if may(*c, kind, mode, want) else S.ACCES


def test_all_rules(rows):
    modes = [*range(0, 0o1000, 3), 0o777, 0o7111, 0o7000, 0o100644]
    data = [(n, *c, k, m, op) for (n, c), k, m, op in itertools.product(CALLERS.items(), (0, 1, 2, 5), modes, OPS)]
    df = rows("name string, uid bigint, gid bigint, gids array<bigint>, type int, mode int, op string", *data)
    who, what = P.Who(F.col("uid"), F.col("gid"), F.col("gids")), P.What(F.col("type"), F.col("mode"), F.lit(1000), F.lit(100))
    got = df.select("name", "type", "mode", "op", P.check(F.col("op"), who, what, uid=F.lit(7), gid=F.lit(501)).alias("s"), P.access_bits(who, what).alias("bits")).collect()
    for r in got:
        c = CALLERS[r.name]
        assert r.s == verdict(r.op, c, r.type, r["mode"]), r
        m = lambda w: may(*c, r.type, r["mode"], w)  # noqa: E731, B023
        d = r.type == 2
        assert r.bits == m(4) * 1 + (d and (m(4) or m(1))) * 2 + m(2) * 12 + (m(2) and d) * 16 + (not d and bool(r["mode"] & 0o111) and m(1)) * 32


def test_out_of_range_wants_and_conjunction(spark):
    who, what = P.Who(F.lit(0), F.lit(0), F.array(F.lit(0))), P.What(F.lit(2), F.lit(0o777), F.lit(0), F.lit(0))
    row = spark.range(1).select(
        P.permits(who, what, 8).alias("a"), P.permits(who, what, 0).alias("b"), P.all_of().alias("c"), P.all_of(F.lit(0), F.lit(13), F.lit(1)).alias("d")).first()
    assert tuple(row) == (False, True, 0, 13)
