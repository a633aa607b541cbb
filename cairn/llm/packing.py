"""Filling containers of fixed capacity with whole documents."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.scratch import Scratch

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the public byte-level vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one size that one task numbers.
RANK_ROWS = 500_000


@lru_cache
def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space of this length is more than the tokenizer's pattern can look back over.
BLANK = 20_000
_BLANK = re.compile(r"[^\S\x1c-\x1f]{%d,}" % BLANK)


def count_tokens(text: str, tokenizer: str = TOKENIZER) -> int:
    """The tokens of the whole text, long blanks included: all but the last character of a blank are one piece, as in the pattern."""
    enc = encoding(tokenizer)
    if len(text) < BLANK or not _BLANK.search(text):
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    for m in _BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document's whole text; a null or empty text has 0."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([count_tokens(t, tokenizer) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


# --- the plan: from how many items there are of each size, not from the items ---


class _Counts:
    """Items by size, sizes ascending."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def least(self, k: int, without: int) -> list[int]:
        """The k smallest items besides one of size ``without``."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - (s == without))
            if len(out) == k:
                break
        return out

    def largest(self, most: int, without: int) -> int:
        """The largest item of at most that size, besides one of size ``without``; 0 if none."""
        i = bisect_left(self.sizes, most + 1) - 1
        while i >= 0 and self.n[self.sizes[i]] - (self.sizes[i] == without) <= 0:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def best_pair(self, most: int, without: int) -> tuple[int, int]:
        """The two items, larger first, that fill ``most`` best."""
        lo, hi, best = 0, len(self.sizes) - 1, (0, 0)
        have = lambda i: self.n[self.sizes[i]] - (self.sizes[i] == without)
        while lo <= hi:
            a, b = self.sizes[hi], self.sizes[lo]
            if not have(hi):
                hi -= 1
            elif not have(lo) or (lo == hi and have(lo) < 2):
                lo += 1
            elif a + b > most:
                hi -= 1
            else:
                if a + b > sum(best):
                    best = (a, b)
                lo += 1
        return best

    def between(self, a: int, b: int) -> list[int]:
        """The two items next larger than b and smaller than a, as far as there are any (at most two)."""
        out: list[int] = []
        for s in self.sizes[bisect_left(self.sizes, b + 1) : bisect_left(self.sizes, a)]:
            out += [s] * min(2 - len(out), self.n[s])
            if len(out) == 2:
                break
        return out


def reduce_by_dominance(counts: _Counts, capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fix sets of up to three items that dominate every other set with their largest item: (set, how often).

    The Martello–Toth reduction. For the largest item not yet fixed, let k be how
    many of the smallest items fit with it. It is fixed alone if k is 0; with the
    largest item that fits if k is 1 or the two fill the container; and if k is
    2, with that one where it is no smaller than the best-filling pair, or with
    the pair where no better pair could be meant. A set fixed for one item is
    fixed for as many as there are of the same sizes.
    """
    fixed = True
    while fixed:
        fixed = False
        for size in counts.sizes[::-1]:
            while size in counts.n:
                small = counts.least(3, size)
                room = capacity - size
                mate = counts.largest(room, size)
                if not mate:
                    pick: tuple[int, ...] = (size,)
                elif len(small) < 2 or sum(small[:2]) > room or mate == room:
                    pick = (size, mate)
                elif len(small) < 3 or sum(small) > room:
                    a, b = counts.best_pair(room, size)
                    near = counts.between(a, b)
                    if not b or mate >= a + b:
                        pick = (size, mate)
                    elif mate == a and (len(near) < 2 or sum(near) > room):
                        pick = (size, a, b)
                    else:
                        break
                else:
                    break
                times = min(counts.n[s] // pick.count(s) for s in set(pick))
                for s in pick:
                    counts.take(s, times)
                fixed = True
                yield pick, times


def best_fit(counts: _Counts, capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over what is left: each item goes where it leaves least room."""
    open_: dict[int, list[list]] = {}  # room left -> [items, containers]
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if not times:
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([items, times])

    for size in counts.sizes[::-1]:
        left = counts.n[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                put(capacity - each * size, (size,) * each, left // each)
                put(capacity - left % each * size, (size,) * (left % each), int(left % each > 0))
                break
            room = rooms[i]
            items, times = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            each = room // size
            full = min(times, left // each)
            put(room - each * size, items + (size,) * each, full)
            left -= full * each
            if full < times:
                put(room - left * size, items + (size,) * left, 1)
                put(room, items, times - full - 1)
                left = 0
    for groups in open_.values():
        yield from ((items, times) for items, times in groups)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Containers for so many items of each size: (sizes, how many such containers)."""
    left = _Counts(counts)
    return [*reduce_by_dominance(left, capacity), *best_fit(left, capacity)]


class _Places:
    """Where the r-th item of a size goes, as sorted arrays; bounded by the capacity, not by the items."""

    def __init__(self, containers: list[tuple[tuple[int, ...], int]]):
        rows, first, used = [], 0, {}
        for sizes, times in containers:
            for size in sorted(set(sizes), reverse=True):
                each = sizes.count(size)
                start = used.get(size, 0)
                rows.append((size, start, first, each, sum(s > size for s in sizes)))
                used[size] = start + each * times
            first += times
        rows.sort()
        self.n = first
        self.columns = np.array(rows, np.int64).reshape(-1, 5).T

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, start, first, each, before = self.columns
        width = max(int(start.max()), int(rank.max())) + 1
        i = np.searchsorted(sizes * width + start, size * width + rank, "right") - 1
        within = rank - start[i]
        return first[i] + within // each[i], before[i] + within % each[i]


def pack(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container, position) from (doc_id, n_tokens).

    A document of more than ``capacity`` tokens is cut into full pieces and a
    rest, which is packed like any document; no other is cut. How many items
    there are of each size, at most ``capacity`` figures, goes to the driver,
    where sets that dominate all others are fixed and the remainder is put by
    best fit. The items of a size are then numbered, by several tasks if there are
    many, and looked up in the plan. Containers count from 0, positions from 0 by
    falling size. ``counted`` is made and written once. A document without tokens comes out with null container and
    position; documents that come twice are packed twice; null ids are packed.
    """
    rows = Scratch(counted.sparkSession, "sizes").write(counted.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("_n")))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece")
    items = rows.select("doc_id", "_n", piece).select(
        "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start_token"),
        F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("piece").cast("bigint") * capacity).alias("n_tokens"))
    full = items.filter("n_tokens > 0")
    counts = {int(r.n_tokens): int(r["n"]) for r in full.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    empty = items.filter("n_tokens <= 0").select("*", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("position"))
    if not counts:
        return empty
    places = _Places(plan(counts, capacity))
    blocks = -(-max(counts.values()) // RANK_ROWS)
    ranked = full.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "_b").orderBy("doc_id", "piece")) - 1
    ranked = ranked.withColumn("_r", rank.cast("bigint"))
    if blocks > 1:
        before = F.sum("_c").over(Window.partitionBy("n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        offset = full.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks))).groupBy("n_tokens", "_b").agg(F.count("*").alias("_c")).select("n_tokens", "_b", F.coalesce(before, F.lit(0)).alias("_o"))
        ranked = ranked.join(offset, ["n_tokens", "_b"]).withColumn("_r", F.col("_r") + F.col("_o"))
    shared = counted.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        for b in batches:
            if b.num_rows:
                at, position = shared.value.find(b.column("n_tokens").to_numpy(), b.column("_r").to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(at), pa.array(position)], ["doc_id", "piece", "start_token", "n_tokens", "container", "position"])

    kind = counted.schema["doc_id"].dataType.simpleString()
    placed = ranked.select("doc_id", "piece", "start_token", "n_tokens", "_r").mapInArrow(run, f"doc_id {kind}, piece int, start_token bigint, n_tokens bigint, container bigint, position bigint")
    return placed.unionByName(empty)
