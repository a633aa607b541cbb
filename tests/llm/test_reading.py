"""Reading levels: calibrated quantiles, pages of unknown words, prose that shares a word with notices."""

import numpy as np
import pytest

pytest.importorskip("cairn.llm")
from cairn.llm import prose, reading  # noqa: E402
from tests.llm.test_llm import EASY, HARD, docs  # noqa: E402


def test_parts_that_tell_nothing_count_nothing():
    rng = np.random.default_rng(2)
    band = rng.integers(0, 4, 400)
    parts = rng.uniform(0, 30, (400, reading.PARTS))
    parts[:, 2] = np.array([1.0, 8.0, 14.25, 19.75])[band] + rng.normal(0, 0.1, 400)
    w = reading.calibrate_quantiles(parts, band)
    assert w.argmax() == 2 and w[2] > 0.9 and (w >= 0).all()
    cuts = reading.calibrate(parts @ w, band)
    assert (np.searchsorted(cuts, parts @ w, "right") == band).mean() > 0.98


def test_few_labels_and_none():
    none = np.zeros((0, reading.PARTS))
    assert np.allclose(reading.calibrate_quantiles(none, np.zeros(0, int)), 1 / reading.PARTS)
    assert (reading.calibrate_quantiles(np.full((1, reading.PARTS), 8.0), np.array([1])) >= 0).all()


def test_a_page_of_unknown_words_is_levelled_by_its_words(rows):
    pages = [(k, EASY * 8) for k in range(4)] + [(k, HARD * 5) for k in range(10, 14)]
    odd = "The quokka is a zorp of blick. It is on the mump and the frob is by the snod. " * 8
    labels = rows("doc_id bigint, band string", (0, "easy"), (1, "easy"), (10, "hard"), (11, "hard"))
    df = docs(rows, *pages, (20, odd))
    every = {r.doc_id: r.band for r in reading.reading_levels(df, labels, known=99).collect()}
    assert set(every) == {0, 1, 2, 3, 10, 11, 12, 13, 20} and every[20] == "easy" and every[13] == "hard"


@pytest.mark.parametrize("line, kept", [
    ("We washed a cow behind the log.", True), ("The log is soft.", True), ("They blocked the road.", True), ("The partners met in the old hall.", True),
    ("Please log in again.", False), ("Log in to reply.", False), ("All rights reserved.", False), ("Access denied.", False), ("We use cookies to improve your visit.", False), ("12 comments.", False)])
def test_notices(line, kept):
    assert bool(prose.sentences(line)) is kept
