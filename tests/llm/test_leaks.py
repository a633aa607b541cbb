"""Leaks: a large test set in one scan, blocks, the cleaned corpus, clashing hashes, repeated and shared passages."""

import random

import numpy as np
import pytest

pytest.importorskip("cairn.llm")
from cairn.llm import leakage, words  # noqa: E402


def brute(docs, items, least):
    out = set()
    for d, text in docs:
        w = words.words(text)
        for i, t in items:
            g = words.words(t)
            n = min(least, len(g))
            grams = {tuple(g[k : k + n]) for k in range(len(g) - n + 1)} if n else set()
            hit = sorted(k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams) if n else []
            spans = []
            for k in hit:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], k + n)
                else:
                    spans.append([k, k + n])
            out |= {(d, i, a, b) for a, b in spans}
    return out


@pytest.mark.parametrize("block", [10**9, 7])
def test_spans_against_brute_force(rows, block):
    rng = random.Random(block)
    text = lambda n: " ".join(rng.choice("a b c d".split()) for _ in range(n))
    items = [(i, text(rng.randrange(0, 12))) for i in range(12)] + [(50, None), (51, "!"), (52, "a b c"), (53, "A, b; C")]
    docs = [(d, text(rng.randrange(0, 40))) for d in range(25)] + [(90, None), (91, "")]
    got = {tuple(r) for r in leakage.leaked_spans(rows("doc_id bigint, text string", *docs), rows("item_id bigint, text string", *items, *items[:3]), least=4, block=block).collect()}
    assert got == brute([(d, t or "") for d, t in docs], [(i, t or "") for i, t in items], 4)


def test_clashing_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(leakage, "_MIX", np.uint64(0))  # every window has the same hash
    grams = leakage._Grams([(7, "a b c"), (8, "x y z")], 3)
    own = "q x y z".split()
    hits = list(grams.hits(leakage._Numbers().of(own)))
    assert {(at, int(grams.items[r])) for at, n, r, p in hits if own[at : at + n] == grams.texts[r].split(" ")[p : p + n]} == {(1, 8)}


def test_a_million_grams_in_one_scan(rows, monkeypatch):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50_000, 1011))) for i in range(1000)]
    scans = []
    real = leakage._Scan
    monkeypatch.setattr(leakage, "_Scan", lambda shared: scans.append(1) or real(shared))
    part = " ".join(items[417][1].split()[300:320])
    docs = rows("doc_id bigint, text string", (1, "so " + part.upper() + " it goes"), (2, "w1 w2 w3 " * 9), (3, " ".join(items[5][1].split()[:11])))
    assert [tuple(r) for r in leakage.leaked_spans(docs, rows("item_id bigint, text string", *items)).collect()] == [(1, 417, 1, 21)]
    assert len(scans) == 1


def test_cleaned_corpus(rows):
    docs = rows("doc_id bigint, lang string, text string, _cuts int", (1, "en", "Before a B c, then d.", 1), (1, "en", "x a b c", 2), (None, None, "a b c", 3), (2, "en", None, 4), (3, "fr", "a b", 5), (4, "en", "ä&nbsp;b c A B C!", 6), (4, "en", "ä&nbsp;b c A B C!", 7))
    items = rows("item_id bigint, text string, doc_id int", (1, "a b c", 0), (2, "b c then", 0))
    got = sorted((tuple(r) for r in leakage.cleaned(docs.drop("_cuts").withColumnRenamed("lang", "_n"), items).collect()), key=str)
    assert got == sorted([(1, "en", "Before  d."), (1, "en", "x "), (None, None, ""), (2, "en", None), (3, "fr", "a b"), (4, "en", "!"), (4, "en", "!")], key=str)
    assert leakage.cleaned(docs.drop("_cuts"), items.limit(0)).count() == 7 and leakage.cleaned(docs.drop("_cuts").limit(0), items).count() == 0
