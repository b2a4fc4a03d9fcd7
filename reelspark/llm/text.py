"""Text as readers see it: markup, time codes and disguises of form taken off, then words."""

from __future__ import annotations

import html
import re
import unicodedata

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ɡ": "g", "ı": "i", "ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v", "ρ": "p",
    "τ": "t", "υ": "u", "κ": "k", "χ": "x", "ł": "l", "ø": "o", "ӏ": "l", "ԛ": "q", "ԝ": "w",
}

_TAG = re.compile(r"<[^<>]{0,200}>")
_TIME = re.compile(r"\[?\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\]?(?:\s*-->\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?)?")
_LABEL = re.compile(r"^[ \t]*(?:(?:[-*•>]|\d{1,3}[.)]|\[[ xX]?\]|[A-Z]{3,8}:|(?:DEBUG|INFO|WARN|ERROR|TRACE)\b)[ \t]+)+", re.M)
_WORD = re.compile(r"[^\W_]+(?:[-'’‐‑][^\W_]+)*")
_LATIN = re.compile(r"[a-z]")
_FORMAT = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x200E, 0x200F, 0x180E, *range(0x202A, 0x202F), *range(0xFE00, 0xFE10))}


def plain(text: str) -> str:
    """Without markup, time codes, line labels and invisible characters, in compatibility form."""
    t = text
    if "<" in t:
        t = _TAG.sub(" \n", t)
    if "&" in t:
        t = html.unescape(t)
    t = _LABEL.sub("", _TIME.sub("\n", t.translate(_FORMAT)))
    return t if t.isascii() else unicodedata.normalize("NFKC", t)


def fold(word: str) -> str:
    """Lower case, Latin look-alikes and accents as plain letters."""
    w = word.casefold()
    if w.isascii():
        return w
    w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    if _LATIN.search(w) or all(c in LOOKALIKES for c in w):
        w = "".join(LOOKALIKES.get(c, c) for c in w)
    return w


_KEPT: dict[str, str] = {}


def word(token: str) -> str:
    """A folded word without hyphens and apostrophes; tokens recur, so answers are kept."""
    w = _KEPT.get(token)
    if w is None:
        w = fold(token)
        w = w if w.isalnum() else re.sub(r"[-'’‐‑]", "", w)
        if len(_KEPT) < 300_000 and len(token) < 64:
            _KEPT[token] = w
    return w


def words(text: str) -> list[str]:
    """Folded words of a text; a hyphenated word is one word without its hyphens."""
    return [word(m) for m in _WORD.findall(plain(text))]
