"""Counts of terms and sequences: brute force, hot terms in pieces, cut records, small batches, nulls, repeats, an empty table."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("cairn.llm")
from cairn.llm import terms  # noqa: E402
from tests.conftest import as_set  # noqa: E402
from tests.test_found import REF, H, at  # noqa: E402


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_sequences_against_brute_force(rows, longest):
    rng = random.Random(longest)
    texts = {r: [rng.choice(["z", "z", "z", "a", "b", None]) for _ in range(rng.randint(0, 30))] for r in range(25)}
    data = [(r, k, t, "x") for r, ts in texts.items() for k, t in enumerate(ts)]
    df = rows("rec int, pos int, t string, terms string", *data, *data[:40])
    n, records = Counter(), defaultdict(set)
    for r, ts in texts.items():
        for k in range(len(ts)):
            for m in range(1, longest + 1):
                gram = tuple(ts[k : k + m])
                if len(gram) == m and None not in gram:
                    n[gram] += 1
                    records[gram].add(r)
    got = {tuple(r.terms): (r.n, r.n_records) for r in terms.count_sequences(df, ["rec"], "pos", "t", longest).collect()}
    assert got == {g: (n[g], len(records[g])) for g in n}
    assert terms.count_sequences(df.limit(0), ["rec"], "pos", "t", longest).count() == 0


def test_hash_frequencies(rows):
    ref = lambda e, i, idx, h: ("a", e, i, idx, h, 1, at(0), "x", "x")
    c = rows(REF, ref(1, 1, 0, H[1]), ref(1, 1, 0, H[1].upper()), ref(1, 1, 1, f" sha256:{H[1]}\n"), *[ref(e, 1, 0, H[2]) for e in range(100)], ref(1, 2, 0, H[3][:63]), ref(1, 2, 1, None), ref(1, 2, 2, ""), ref(1, 2, None, H[4]), ref(None, None, None, H[4]))
    assert as_set(terms.hash_frequencies(c)) == {(H[1], 2, 1, "rare"), (H[2], 100, 100, "common"), (H[4], 2, 2, None)}
    assert terms.hash_frequencies(c.limit(0)).count() == 0


@pytest.mark.parametrize("longest, split, batch", [(1, 5, 3), (2, 5, 3), (3, 5, 10_000), (3, 1_000_000, 3)])
def test_sequences_in_pieces(spark, rows, monkeypatch, longest, split, batch):
    monkeypatch.setattr(terms, "STRETCH", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(longest)
    data = [(r, k, rng.choice(["z", "z", "z", "a", None])) for r in range(9) for k in range(40) if rng.random() < 0.9] + [(1, None, "z"), (1, None, "a")]
    n, records, there = Counter(), defaultdict(set), {(r, k): t for r, k, t in data if k is not None}
    for r, k, t in data:
        gram = () if k is not None else (t,) if longest == 1 or t == "a" else ()
        for m in range(longest if k is not None else 0):
            gram += (there.get((r, k + m)),)
            if None in gram:
                break
            n[gram] += 1
            records[gram].add(r)
        if k is None and gram:
            n[gram] += 1
            records[gram].add(r)
    try:
        got = {tuple(r.terms): (r.n, r.n_records) for r in terms.count_sequences(rows("rec int, pos int, t string", *data, *data[:30]), ["rec"], "pos", "t", longest, split).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {g: (n[g], len(records[g])) for g in n}
