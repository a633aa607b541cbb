"""The main text of a page: its running sentences, without the furniture around them."""

from __future__ import annotations

import re
from functools import lru_cache

from cairn.llm.words import UNSEEN

END = re.compile(r"[.!?…][\"”’'»)\]]*$")
#: A remark under an article: a name or handle, a colon, and what was said.
REMARK = re.compile(r"^[\w.\-]{2,24}:\s+\S")
STOP = re.compile(r"[.!?…]+[\"”’'»)\]]*(?=\s|$)")
TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)*")
LETTER = re.compile(r"[^\W\d_]")
VOWELS = re.compile(r"[aeiouy]+")
#: Words of a site talking of itself, and phrases of words that prose has too; one in a short sentence marks it as a notice.
NOTICE = frozenset("cookie cookies privacy subscribe unsubscribe newsletter e-mail email advertisement login javascript copyright sitemap webmaster".split())
NOTICE_PHRASE = re.compile(r"\b(?:please log in|log in (?:to|again|or|with|first)|rights reserved|planned maintenance|your browser|access denied|address was blocked|requested url|\d+ comments?)\b")
PHRASE_WORDS = frozenset("log reserved maintenance browser denied blocked url comment comments".split())
NOTICE_WORDS = 14
#: Common English function words that are not common in neighbouring languages.
FUNCTION = frozenset("the of and to with that this for from by is are was were had has have it its he she they we you i not be been which whose as at on an but so because if when where there their each every most no any than upon into near".split())
LEAST_FUNCTION = 0.16


def paragraphs(text: str) -> list[str]:
    """Lines, joined again where a sentence was wrapped at a column."""
    lines = [" ".join(UNSEEN.sub("", x).split()) for x in text.splitlines()]
    wrap = max((len(a) for a, b in zip(lines, lines[1:]) if a and b[:1].islower() and not END.search(a)), default=0)
    out: list[str] = []
    last = ""
    for line in lines:
        wrapped = last and not END.search(last) and not REMARK.match(line) and (line[:1].islower() or (wrap and len(last) + 1 + len(line.split(" ", 1)[0]) > wrap))
        if line and wrapped:
            out[-1] += " " + line
        elif line:
            out.append(line)
        last = line
    return out


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of the main text, if that is English; else none.

    A sentence is a stretch of a paragraph up to its full stop, question or
    exclamation mark: menus, headings, teasers and lists of links have none.
    Remarks and short notices are passed over. The main text is English if its
    sentences are, for the most part.
    """
    found: list[list[str]] = []
    n = common = foreign = 0
    for p in paragraphs(text or ""):
        if REMARK.match(p):
            continue
        at, p = 0, p.lower().replace("’", "'")
        for m in STOP.finditer(p):
            stretch, at = p[at : m.end()], m.end()
            tokens = TOKEN.findall(stretch)
            if not tokens:
                foreign += len(LETTER.findall(stretch)) // 5
            elif len(tokens) > 1 and (len(tokens) > NOTICE_WORDS or NOTICE.isdisjoint(tokens) and (PHRASE_WORDS.isdisjoint(tokens) or not NOTICE_PHRASE.search(stretch))):
                english = sum(map(FUNCTION.__contains__, tokens))
                if english or len(tokens) < 4:
                    found.append(tokens)
                    n, common = n + len(tokens), common + english
                else:
                    foreign += len(tokens)
    return found if n > foreign and common >= LEAST_FUNCTION * n else []


@lru_cache(maxsize=1 << 16)
def syllables(word: str) -> int:
    n = len(VOWELS.findall(word))
    if n > 1 and word.endswith("e") and not word.endswith("le"):
        n -= 1
    return max(n, 1)


def formula_grade(found: list[list[str]]) -> float:
    """School grade by sentence length and syllables a word (the formula of Kincaid et al., 1975)."""
    n = sum(map(len, found))
    return 0.39 * n / len(found) + 11.8 * sum(syllables(w) for s in found for w in s) / n - 15.59
