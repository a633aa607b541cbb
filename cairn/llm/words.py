"""Words as a reader sees them."""

from __future__ import annotations

import html
import re
import unicodedata

ASCII = re.compile(r"[\x00-\x7f]+")
WORD = re.compile(r"[^\W_]+")
#: Characters that show nothing (soft hyphen, zero-width and direction marks, byte order mark).
UNSEEN = re.compile("[­​-‏‪-‮⁠-⁤⁦-⁩﻿]")


def plain(text: str) -> str:
    """Character references resolved, unseen characters and accents dropped, letters folded."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", UNSEEN.sub("", text)).casefold()
    if any(map(unicodedata.combining, set(ASCII.sub("", text)))):
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the plain text; none of a null or empty text."""
    return WORD.findall(plain(text)) if text else []


def word_places(text: str) -> list[tuple[str, int, int]]:
    """(word, from, to) with places in the text as given."""
    units: list[tuple[str, int, int]] = []
    at = 0
    for m in re.finditer(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", text):
        units += [(c, i, i + 1) for i, c in enumerate(text[at : m.start()], at)]
        shown = html.unescape(m.group())
        units += [(c, m.start(), m.end()) for c in shown] if shown != m.group() else [(c, i, i + 1) for i, c in enumerate(m.group(), m.start())]
        at = m.end()
    units += [(c, i, i + 1) for i, c in enumerate(text[at:], at)]
    shown, place = [], []
    for c, lo, hi in units:
        for p in plain(c):
            shown.append(p)
            place.append((lo, hi))
    return [(m.group(), place[m.start()][0], place[m.end() - 1][1]) for m in WORD.finditer("".join(shown))]
