"""Evaluation texts that leaked into a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import word_places, words
from cairn.planning import broadcast_if_small
from cairn.scratch import Scratch

#: Consecutive words that make a leak; an item with fewer leaks as a whole.
LEAST = 12
#: Test n-grams broadcast at once, about 30 bytes each; a larger test set is scanned for in several passes.
BLOCK = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

SPANS = "doc_id bigint, item_id bigint, from_word int, to_word int"


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, plain, n_words): each distinct text of an item as its words between blanks; none of an item without words."""

    def run(batches):
        for b in batches:
            lists = [words(t) for t in b.column(1).to_pylist()]
            keep = [k for k, w in enumerate(lists) if w]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array([" ".join(lists[k]) for k in keep], pa.string()), pa.array([len(lists[k]) for k in keep], pa.int64())],
                ["item_id", "plain", "n_words"])

    return items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("bigint"), "text").mapInArrow(run, "item_id bigint, plain string, n_words bigint").distinct()


def _spans(documents: DataFrame, items: DataFrame, least: int, block: int) -> DataFrame:
    """SPANS and _text, a hash of the document's text."""
    spark = documents.sparkSession
    held = Scratch(spark, "items").write(item_words(items))
    parts = max(1, -(-(held.agg(F.sum(F.greatest(F.col("n_words") - least + 1, F.lit(1)))).first()[0] or 0) // block))
    out = None
    for part in range(parts):
        own = held.filter(F.pmod(F.xxhash64("item_id", "plain"), F.lit(parts)) == part).select("item_id", "plain").collect()
        shared = spark.sparkContext.broadcast(_Grams([(r.item_id, r.plain) for r in own], least))
        found = documents.select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInArrow(_Scan(shared), SPANS + ", _text bigint")
        out = found if out is None else out.unionByName(found)
    return out


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, from_word, to_word): every stretch of a document that is an item's.

    from_word counts the document's words from 0, to_word is one past the last.
    The hashes of the test n-grams are broadcast as one sorted array; the windows
    of each document are looked up in it, hits verified word by word with the
    item and overlapping windows of one item joined. Documents are read in place,
    whole, in one scan and without a shuffle; only test sets of more than
    ``block`` n-grams take several. Null or empty texts leak nothing; documents
    that come twice are reported twice; rows without doc_id are kept with a null.
    """
    return _spans(documents, items, least, block).drop("_text")


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id), one row per document and item it carries text of."""
    return leaked_spans(documents, items, least).select("doc_id", "item_id").distinct()


@cache
def _numbers() -> "_Numbers":
    return _Numbers()


class _Numbers(dict):
    """Words by 64-bit number, kept while there are not too many."""

    MOST = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word)
        return n

    def of(self, text_words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text_words), np.uint64, len(text_words))


def _windows(numbers: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of all windows of n words) for the lengths asked, ascending."""
    h = np.zeros(len(numbers), np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        m = len(numbers) - n + 1
        if m <= 0:
            return
        h = h[:m] * _BASE + numbers[n - 1 : n - 1 + m]
        if n in lengths:
            yield n, h * _MIX


class _Grams:
    """The n-grams of a block of items: sorted hashes, where each stands, a bit map to ask first, and the texts to verify with.

    Bounded by the block's size. Items are kept by row, so one that has two texts is two.
    """

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.items = np.array([i for i, _ in items], np.int64)
        self.texts = [t for _, t in items]
        numbers, by_length = _Numbers(), {}
        for row, text in enumerate(self.texts):
            w = numbers.of(text.split(" "))
            n = min(least, len(w))
            for _, h in _windows(w, [n]):
                by_length.setdefault(n, []).append((h, np.full(len(h), row, np.int32), np.arange(len(h), dtype=np.int32)))
        self.hashes, self.rows, self.places, self.maybe = {}, {}, {}, {}
        for n, several in by_length.items():
            h, row, place = (np.concatenate(c) for c in zip(*several))
            order = np.argsort(h, kind="stable")
            self.hashes[n], self.rows[n], self.places[n] = h[order], row[order], place[order]
            bits = max(16, int(8 * len(h) - 1).bit_length())
            at = np.unique(h >> np.uint64(64 - bits)).astype(np.int64)
            mask = np.zeros(1 << (bits - 3), np.uint8)
            np.bitwise_or.at(mask, at >> 3, (1 << (at & 7)).astype(np.uint8))
            self.maybe[n] = (bits, mask)

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(place, length, item's row, place in the item) of windows whose hash is a test n-gram's."""
        for n, h in _windows(numbers, sorted(self.hashes)):
            bits, mask = self.maybe[n]
            at = (h >> np.uint64(64 - bits)).astype(np.int64)
            some = np.flatnonzero((mask[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            lo, hi = (np.searchsorted(self.hashes[n], h[some], side) for side in ("left", "right"))
            for k in np.flatnonzero(hi > lo):
                for j in range(lo[k], hi[k]):
                    yield int(some[k]), n, int(self.rows[n][j]), int(self.places[n][j])


class _Scan:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches):
        grams, numbers, split = self.shared.value, _numbers(), {}
        for batch in batches:
            own = [words(t) for t in batch.column(1).to_pylist()]
            starts = np.cumsum([0, *(len(w) + 1 for w in own)])
            every = np.zeros(starts[-1], np.uint64)  # a number that is no word's stands between documents
            for w, at in zip(own, starts):
                every[at : at + len(w)] = numbers.of(w)
            found: dict[tuple[int, int], set] = {}
            for at, n, row, place in grams.hits(every):
                d = int(np.searchsorted(starts, at, "right")) - 1
                at -= int(starts[d])
                if row not in split:
                    if len(split) > 10_000:
                        split.clear()
                    split[row] = grams.texts[row].split(" ")
                if own[d][at : at + n] == split[row][place : place + n]:
                    found.setdefault((d, int(grams.items[row])), set()).add((at, at + n))
            rows = [(d, item, lo, hi) for (d, item), places in found.items() for lo, hi in _joined(places)]
            c = list(zip(*rows)) or [()] * 4
            docs = pa.array(c[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()).take(docs), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), batch.column(2).take(docs)],
                ["doc_id", "item_id", "from_word", "to_word", "_text"])


def _joined(places: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches with those that touch or overlap put together, in order."""
    lo = hi = None
    for a, b in sorted(places):
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def without_leaks(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents that leak nothing, all columns."""
    return documents.join(spans.select("doc_id").distinct(), "doc_id", "left_anti")


def _cut(text: str, spans: set[tuple[int, int]]) -> str:
    places, at, kept = word_places(text), 0, []
    for lo, hi in sorted((places[a][1], places[b - 1][2]) for a, b in spans):
        if lo > at:
            kept.append(text[at:lo])
        at = max(at, hi)
    return "".join([*kept, text[at:]])


def cleaned(documents: DataFrame, items: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """All documents, all columns, with every leaked stretch cut out of ``text``; those that leak nothing are as they were.

    A null text stays null; a text that is all leak becomes empty. The stretches
    are written once; few documents leak, so they are broadcast if their checked
    size is small. Rows are told apart by id and text, repeated ones are cut alike.
    """
    spans = Scratch(documents.sparkSession, "leaks").write(_spans(documents, items, least, block))
    none = F.lit(-(2**63)).cast("bigint")
    cuts = spans.groupBy(F.coalesce("doc_id", none).alias("_doc"), "_text").agg(F.collect_set(F.struct("from_word", "to_word")).alias("_cuts"))
    known = documents.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("bigint"), none), "_text": F.xxhash64("text")})
    both = known.join(broadcast_if_small(cuts, spans), ["_doc", "_text"], "left").select(*documents.columns, "_cuts")
    names, place = documents.columns, documents.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(place).to_pylist()
            for k, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if spans:
                    texts[k] = _cut(texts[k], {(c["from_word"], c["to_word"]) for c in spans})
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == place else b.column(k) for k in range(b.num_columns - 1)], names)

    return both.mapInArrow(run, documents.schema)


def without_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents that leak, the leaked stretches (leaked_spans) cut out."""
    cuts = spans.groupBy("doc_id").agg(F.collect_set(F.struct("from_word", "to_word")).alias("cuts"))

    def run(batches):
        for b in batches:
            texts = [_cut(t, {(c["from_word"], c["to_word"]) for c in cuts}) for t, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return documents.select("doc_id", "text").join(cuts, "doc_id").mapInArrow(run, "doc_id bigint, text string")
