"""Counts of every distinct term and term sequence: suffix sorting with a stack."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.spelling import hash_bytes
from cairn.planning import hot_keys, row_hash

#: Suffixes of one first term from which they are routed in several pieces, by record.
SPLIT_ROWS = 1_000_000
#: Positions of one record that one task puts in order; longer records are cut, each cut reaching into the next.
STRETCH = 65_536
#: From this many records a term says nothing, as does a term of one record.
COMMON = 100
_NOWHERE = -(2**62)


def _names(longest: int) -> list[str]:
    return [f"_t{k}" for k in range(1, longest + 1)]


def suffixes(occurrences: DataFrame, record: list[str], position: str, term: str, longest: int) -> DataFrame:
    """(_t1…, _rec, _pos): at every position the sequence of up to ``longest`` terms that starts there.

    A null term or a position that is not there ends a sequence and starts none.
    Positions count from 0; null and lower ones have no neighbours. Where ``longest`` is above 1 a position has
    one term, the smallest of several. _rec is a 64-bit hash of the record.
    """
    rows = occurrences.select(row_hash(*[F.col(c) for c in record]).alias("_rec"), F.coalesce(F.when(F.lit(longest == 1), F.col(position)).when(F.col(position) >= 0, F.col(position)).cast("bigint"), F.lit(_NOWHERE)).alias("_pos"), F.col(term).alias("_t1"))
    if longest == 1:  # a position needs no other: rows repeated elsewhere meet at the stack
        return rows.filter("_t1 IS NOT NULL").select("_t1", "_rec", "_pos")
    cut = F.floor(F.col("_pos") / STRETCH).cast("bigint")
    reach = (cut > 0) & (F.col("_pos") - cut * STRETCH < longest - 1)
    rows = rows.select("*", F.explode(F.when(reach, F.array(F.struct(cut.alias("cut"), F.lit(True).alias("own")), F.struct((cut - 1).alias("cut"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(cut.alias("cut"), F.lit(True).alias("own"))))).alias("_c")).select("_rec", "_pos", "_t1", "_c.*")
    one = rows.repartition("_rec", "cut").groupBy("_rec", "cut", "_pos").agg(F.min("_t1").alias("_t1"), F.max("own").alias("own"))
    by = Window.partitionBy("_rec", "cut").orderBy("_pos")
    near = one.select("*", *[F.when(F.lead("_pos", k).over(by) == F.col("_pos") + k, F.lead("_t1", k).over(by)).alias(f"_t{k + 1}") for k in range(1, longest)])
    for a, b in zip(_names(longest)[1:], _names(longest)[2:]):
        near = near.withColumn(b, F.when(F.col(a).isNotNull(), F.col(b)))
    return near.filter("own AND _t1 IS NOT NULL").select(*_names(longest), "_rec", "_pos")


def count_sequences(occurrences: DataFrame, record: list[str], position: str, term: str, longest: int = 1, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(terms, n, n_records) of every sequence of 1 to ``longest`` terms.

    ``occurrences`` has the columns of ``record``, ``position`` and ``term``;
    others are not read. The suffixes that start at each position, cut at
    ``longest``, are freed of repeats batch by batch and routed by their first
    term; sorted in reverse lexicographic order they are read by a stack whose
    entries are the prefixes still open. A prefix is complete when the next suffix
    no longer starts with it; its positions and its set of records have then been
    met. The full sequence comes sorted by record and needs no set, a shorter one
    holds the hashes of the records of one first term. A first term of more than
    ``split_rows`` suffixes is routed in pieces by record, whose counts add up
    since no record is in two of them.

    A position delivered several times counts once; a term repeated in a record
    counts in ``n`` each time, in ``n_records`` once. Null terms count nowhere
    and part the sequences around them, as does a position left out. Records are
    told apart by 64 bits. An empty input gives no rows.
    """
    names, kind = _names(longest), occurrences.schema[term].dataType.simpleString()
    each = suffixes(occurrences, record, position, term, longest)
    columns = ", ".join(f"{c} {kind}" for c in names) + ", _rec bigint, _pos bigint"
    once = each.mapInArrow(_without_repeats, columns)
    first = occurrences.select(F.xxhash64(term).alias("_k")).filter(F.col(term).isNotNull())
    pieces = hot_keys(first, "_k", split_rows)
    piece = F.pmod(F.col("_rec"), F.coalesce("_pieces", F.lit(1))).alias("_piece")
    routed = once.withColumn("_k", F.xxhash64("_t1")).join(F.broadcast(pieces), "_k", "left").select(*names, "_rec", "_pos", piece).repartition("_t1", "_piece").drop("_piece")
    sorted_ = routed.sortWithinPartitions(*[F.col(c).desc_nulls_last() for c in names], "_rec", "_pos")
    return sorted_.mapInArrow(_Stack(longest), f"terms array<{kind}>, n bigint, n_records bigint").groupBy("terms").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))


def _without_repeats(batches):
    """Each batch's rows once, equal first terms side by side, where the shuffle's compression finds them."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).select(batch.schema.names)
            yield from rows.take(pc.sort_indices(rows.column(0))).combine_chunks().to_batches()


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; null equals null. One shorter than the column."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
    none = column.is_null().to_numpy(zero_copy_only=False)
    return unequal & ~(none[1:] & none[:-1])


class _Open:
    """The prefix of one depth that is still open: positions, records, and their hashes where they do not come sorted."""

    def __init__(self):
        self.n = self.records = 0
        self.sets: list[np.ndarray] = []

    def add(self, n: int, records: int, hashes: np.ndarray | None) -> None:
        self.n += n
        self.records += records
        if hashes is not None and len(hashes):
            self.sets.append(hashes)
            if len(self.sets) > 1 and sum(map(len, self.sets[1:])) > len(self.sets[0]):
                self.sets = [np.unique(np.concatenate(self.sets))]

    def close(self) -> tuple[int, int]:
        return self.n, self.records + (len(np.unique(np.concatenate(self.sets))) if self.sets else 0)


class _Stack:
    """The stack over one sorted partition, a batch at a time; what is open at its end is given out last."""

    def __init__(self, longest: int):
        self.longest = longest

    def __call__(self, batches):
        depth = self.longest
        open_ = [_Open() for _ in range(depth)]
        last: list[pa.Array] | None = None  # the row before this batch
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = last is not None
            columns = [pa.concat_arrays([b, c]) if seen else c for b, c in zip(last or batch.columns, batch.columns)]
            new = [_changes(c) if seen else np.concatenate([[True], _changes(c)]) for c in columns]
            rec = batch.column(depth).to_numpy()
            changed = np.logical_or.accumulate(np.stack(new[:depth]))
            fresh_record = changed[-1] | new[depth]
            counted = fresh_record | new[depth + 1]  # a repeat changes nothing
            for k in range(depth):
                there = batch.column(k).is_valid().to_numpy(zero_copy_only=False)
                group = np.cumsum(changed[k])
                top = int(group[-1])
                n = np.bincount(group, weights=counted & there, minlength=top + 1).astype(np.int64)
                if k == depth - 1:
                    records, pairs = np.bincount(group, weights=fresh_record & there, minlength=top + 1).astype(np.int64), None
                else:
                    order = np.lexsort((rec, group))
                    g, r = group[order], rec[order]
                    one = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]) & there[order]
                    pairs = (g[one], r[one])
                    records = np.bincount(pairs[0], minlength=top + 1).astype(np.int64)
                of = lambda x: None if pairs is None else pairs[1][pairs[0] == x]  # noqa: B023, E731
                sets = pairs is not None
                open_[k].add(int(n[0]), 0 if sets else int(records[0]), of(0))
                if not top:
                    continue
                if seen or n[0]:
                    n[0], records[0] = open_[k].close()
                # a group is named by its first row; group 0 by the row before the batch
                first = np.concatenate([[0 if seen else -1], np.flatnonzero(changed[k]) + (1 if seen else 0)])
                yield from self._out(columns, k, first[:top], n[:top], records[:top])
                open_[k] = _Open()
                open_[k].add(int(n[top]), 0 if sets else int(records[top]), of(top))
            last = [c.slice(len(c) - 1) for c in columns]
        if last is not None:
            for k in range(depth):
                n, records = open_[k].close()
                yield from self._out(last, k, np.array([0]), np.array([n]), np.array([records]))

    @staticmethod
    def _out(columns, k, rows, n, records):
        """The prefixes of k + 1 terms that start these rows; of none that are shorter."""
        keep = n > 0
        rows, n, records = rows[keep], n[keep], records[keep]
        if len(rows):
            taken = pa.concat_arrays([columns[j].take(pa.array(rows)) for j in range(k + 1)])
            place = np.arange(len(taken)).reshape(k + 1, len(rows)).T.ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (k + 1), pa.int32()), taken.take(pa.array(place)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(n), pa.array(records)], ["terms", "n", "n_records"])


def mark(n_records: Column, common: int = COMMON) -> Column:
    """'rare' in one record, 'common' in ``common`` or more, else null."""
    return F.when(n_records == 1, "rare").when(n_records >= common, "common")


def hash_sequences(chunk_refs: DataFrame, longest: int = 1, common: int = COMMON) -> DataFrame:
    """(terms, n, n_records, mark) of every sequence of up to ``longest`` well-formed chunk hashes, however spelled, in the order of a file's chunks.

    A record is one (bucket, epoch, inode_id); holes and damaged hashes are no
    terms and part the sequences around them. Null keys are values like any other.
    """
    terms = chunk_refs.select("bucket", "epoch", "inode_id", "idx", hash_bytes(F.col("hash")).alias("hash"))
    counted = count_sequences(terms, ["bucket", "epoch", "inode_id"], "idx", "hash", longest)
    return counted.select(F.transform("terms", lambda t: F.lower(F.hex(t))).alias("terms"), "n", "n_records", mark(F.col("n_records"), common).alias("mark"))


def hash_frequencies(chunk_refs: DataFrame, common: int = COMMON) -> DataFrame:
    """(hash, n_refs, n_records, mark) of every well-formed chunk hash, however spelled."""
    return hash_sequences(chunk_refs, 1, common).select(F.get("terms", F.lit(0)).alias("hash"), F.col("n").alias("n_refs"), "n_records", "mark")
