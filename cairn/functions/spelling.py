"""One spelling for values that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ways in which a chunk hash or a snapshot key may be prefixed.
HASH_PREFIX = r"^\s*(?i:chunks/|sha256:)?\s*"
KEY_PREFIX = r"^\s*(\./|/)*"


def chunk_hash(c: Column) -> Column:
    """Lower case, no prefix, no white space around; null for a hole (null or empty).

    A damaged hash keeps what is left of it, so it equals only its own copies.
    Only what is not 64 hex digits already is matched against patterns.
    """
    plain = F.lower(F.regexp_replace(F.regexp_replace(c, HASH_PREFIX, ""), r"\s+$", ""))
    return F.when(_hex64(c), F.lower(c)).otherwise(F.when(plain != "", plain))


def _hex64(c: Column) -> Column:
    return (F.octet_length(c) == 64) & F.unhex(c).isNotNull()


def hash_bytes(c: Column) -> Column:
    """The 32 bytes of a well-formed hash, however spelled; null of a hole or a damaged one."""
    plain = F.regexp_replace(F.regexp_replace(c, HASH_PREFIX, ""), r"\s+$", "")
    return F.when(F.octet_length(c) == 64, F.unhex(c)).otherwise(F.when(F.octet_length(plain) == 64, F.unhex(plain)))


def is_hash(c: Column) -> Column:
    """Whether a value made by chunk_hash is 64 hex digits; null is none."""
    return F.coalesce(_hex64(c), F.lit(False))


def snapshot_key(c: Column) -> Column:
    """A snapshot's key as the store lists it: no leading slash or dot, no white space."""
    return F.regexp_replace(F.regexp_replace(c, KEY_PREFIX, ""), r"\s+$", "")


def low_mode(c: Column) -> Column:
    """The permission bits; file-type bits above the low twelve are dropped."""
    return c.bitwiseAND(F.lit(4095))
