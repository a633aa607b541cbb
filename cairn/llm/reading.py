"""Reading level of pages from the grades at which their words are acquired."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.prose import formula_grade, sentences
from cairn.planning import broadcast_if_small
from cairn.scratch import Scratch

LEAST_WORDS = 80
#: A word is known if it stands in this many graded pages.
KNOWN_PAGES = 3
#: Which place in the distribution of the grades of its pages is a word's acquisition grade.
ACQUIRED = 0.5
#: Quantiles of the grades of a page's known words, in PARTS of which each is the mean of its share.
STEPS, PARTS = 50, 5
BANDS = ("easy", "middle", "upper", "hard")
#: The school grades that part the bands.
CUTS = (4.5, 11.5, 17.0)
#: Labelled pages used to calibrate, at most; those of least hash.
LABELLED = 20_000
#: Known words broadcast at most; beyond, pages and words are joined.
BROADCAST_WORDS = 500_000

PROFILE = "doc_id bigint, words array<string>, counts array<int>, n_words int, grade double"


def profiles(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, words, counts, n_words, grade) of every page with English prose of that many words."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = sentences(text)
                n = sum(map(len, found))
                if n >= least_words:
                    bag = Counter(w for s in found for w in s)
                    for c, v in zip(out, (doc, list(bag), list(bag.values()), n, formula_grade(found))):
                        c.append(v)
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "words", "counts", "n_words", "grade"])

    return documents.select("doc_id", "text").mapInArrow(run, PROFILE)


def word_grades(pages: DataFrame, known: int = KNOWN_PAGES, acquired: float = ACQUIRED) -> DataFrame:
    """(word, grade, n_pages): the grade by which a word is acquired, from the distribution of the grades of all pages it stands in.

    Every page is a graded text: sentence length and syllables grade it. Words of
    fewer than ``known`` pages are not known.
    """
    seen = pages.select(F.round("grade", 1).alias("grade"), F.explode("words").alias("word")).groupBy("word", "grade").agg(F.count("*").alias("n"))
    return seen.groupBy("word").agg(F.percentile("grade", acquired, F.col("n")).alias("grade"), F.sum("n").alias("n_pages")).filter(F.col("n_pages") >= known)


def _quantiles(grade: np.ndarray, count: np.ndarray) -> list[float]:
    """Evenly spaced quantiles of the grades, averaged in PARTS from the easiest words to the hardest; each grade counts as often as its word occurs."""
    order = np.argsort(grade, kind="stable")
    upto = np.cumsum(count[order])
    at = (np.arange(STEPS) + 0.5) / STEPS * upto[-1]
    return grade[order][np.searchsorted(upto, at, "right")].reshape(PARTS, -1).mean(axis=1).tolist()


def quantiles(pages: DataFrame, grades: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, parts) of each page's known-word grades; a page without known words has null parts.

    Known words are broadcast if there are at most ``broadcast_words``; else the
    pages' words are joined with them, to the same result.
    """
    out, row = "doc_id bigint, parts array<double>", pa.list_(pa.float64())
    small = grades.limit(broadcast_words + 1).count() <= broadcast_words
    if small:
        shared = pages.sparkSession.sparkContext.broadcast({r.word: r.grade for r in grades.collect()})

        def run(batches):
            get = shared.value.get
            for b in batches:
                parts = []
                for words, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    g = np.array([get(w, np.nan) for w in words])
                    known = ~np.isnan(g)
                    parts.append(_quantiles(g[known], np.array(counts)[known]) if known.any() else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, row)], ["doc_id", "parts"])

        return pages.select("doc_id", "words", "counts").mapInArrow(run, out)
    each = pages.select("doc_id", F.explode(F.arrays_zip("words", "counts")).alias("_z")).select("doc_id", F.col("_z.words").alias("word"), F.col("_z.counts").alias("n"))
    sorted_ = F.array_sort(F.collect_list(F.when(F.col("grade").isNotNull(), F.struct("grade", "n"))))
    bag = each.join(grades, "word", "left").groupBy("doc_id").agg(sorted_.alias("_b"))

    def run(batches):
        for b in batches:
            parts = [_quantiles(np.array([x["grade"] for x in bag]), np.array([x["n"] for x in bag])) if bag else None for bag in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, row)], ["doc_id", "parts"])

    return bag.mapInArrow(run, out)


def calibrate_quantiles(parts: np.ndarray, band: np.ndarray, cuts: tuple[float, ...] = CUTS) -> np.ndarray:
    """What each part of the quantiles counts, at least 0: least squares against the middle grades of the labelled bands.

    A weight of one page holds them to the plain mean, so few labels move them
    little and none leaves it. With so few parts every choice of those that count
    is tried.
    """
    middle = np.array([cuts[0] - (cuts[1] - cuts[0]) / 2, *[(a + b) / 2 for a, b in zip(cuts, cuts[1:])], cuts[-1] + (cuts[-1] - cuts[-2]) / 2])
    k = parts.shape[1]
    hold = np.sqrt((parts**2).mean() if len(parts) else 1.0) * np.eye(k)
    a, y = np.vstack([parts, hold]), np.concatenate([middle[band], hold.sum(axis=1) / k])
    best, least = np.full(k, 1 / k), np.inf
    for chosen in range(1, 1 << k):
        on = [j for j in range(k) if chosen >> j & 1]
        w = np.linalg.lstsq(a[:, on], y, rcond=None)[0]
        if (w >= 0).all() and (loss := ((a[:, on] @ w - y) ** 2).sum()) < least:
            least, best = loss, np.zeros(k)
            best[on] = w
    return best


def calibrate(level: np.ndarray, band: np.ndarray, cuts: tuple[float, ...] = CUTS) -> list[float]:
    """The levels that part the bands: for each, where fewest labels are on the wrong side.

    Among equally good places the widest gap between levels is taken, in the
    middle. Where no label lies on one of the sides the band's own grade is kept.
    """
    out = []
    for k, cut in enumerate(cuts):
        above = band > k
        if above.all() or not above.any():
            out.append(cut)
            continue
        order = np.argsort(level, kind="stable")
        x, y = level[order], above[order]
        wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(~y[::-1])[::-1], [0]])
        inner = np.arange(1, len(x))
        best = inner[wrong[1:-1] == wrong[1:-1].min()]
        widest = best[np.argmax(x[best] - x[best - 1])]
        out.append(float((x[widest] + x[widest - 1]) / 2))
    return [max(out[: k + 1]) for k in range(len(out))]


def reading_levels(documents: DataFrame, labels: DataFrame, least_words: int = LEAST_WORDS, known: int = KNOWN_PAGES, labelled: int = LABELLED, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, band, level, n_words) of every page whose main text is English prose of ``least_words``.

    A word's acquisition grade comes from the distribution of the grades of all
    pages it stands in; a page's level from the quantiles of its known words'
    grades. What each part of the quantiles counts, and the levels that part the
    bands, are calibrated on at most ``labelled`` labelled pages. ``labels`` has
    doc_id and band; of several labels of a page the most frequent counts, the
    lower of equals; without labels the quantiles count alike and the bands' own
    grades part them. A page of which no word is known is levelled by what the
    pages that have its words tell of them, few as they are. Other pages, null
    and empty texts yield nothing; rows that repeat a page count once.
    """
    scratch = Scratch(documents.sparkSession, "reading")
    pages = scratch.write(profiles(documents, least_words))
    seen = scratch.write(word_grades(pages, 1))
    known_parts = scratch.write(quantiles(pages, seen.filter(F.col("n_pages") >= known).select("word", "grade"), broadcast_words))
    unknown = known_parts.filter("parts IS NULL").select("doc_id")
    rare = pages.join(broadcast_if_small(unknown, unknown), "doc_id", "left_semi")
    parts = known_parts.filter("parts IS NOT NULL").unionByName(quantiles(rare, seen.select("word", "grade"), 0))
    level = scratch.write(parts.join(pages.select("doc_id", "n_words"), "doc_id").distinct())
    number = F.array_position(F.array(*[F.lit(b) for b in BANDS]), F.col("band")) - 1
    one = labels.filter(F.col("band").isin(*BANDS)).groupBy("doc_id", number.alias("b")).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("b")).alias("low"))).alias("m")).select("doc_id", (-F.col("m.low")).alias("b"))
    rows = level.join(one, "doc_id").orderBy(F.xxhash64("doc_id")).select("parts", "b").limit(labelled).collect()
    fit, band_of = np.array([r.parts for r in rows]).reshape(-1, PARTS), np.array([r.b for r in rows], dtype=int)
    weights = calibrate_quantiles(fit, band_of)
    cuts = calibrate(fit @ weights, band_of) if rows else list(CUTS)
    at = sum((F.get("parts", F.lit(k)) * float(w) for k, w in enumerate(weights)), F.lit(0.0))
    band = F.lit(BANDS[-1])
    for b, cut in reversed(list(zip(BANDS, cuts))):
        band = F.when(F.col("level") < cut, b).otherwise(band)
    return level.select("doc_id", at.alias("level"), "n_words").select("doc_id", band.alias("band"), "level", "n_words")
