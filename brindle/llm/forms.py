"""Forms of a text: what a reader sees (seen text) and what is left for comparison (bare text).

A batch of texts is handled as one array of code points, so that per-character work is table look-ups in numpy.
Null counts as an empty text everywhere here.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

# Letters of other alphabets and the Latin letters they look like (upper to upper and lower to lower case).
CYRILLIC = "АВЕКМНОРСТУХЅІЈԚԜҮЁЇЀавекмнорстухѕіјԛԝүёїѐ"
CYRILLIC_AS = "ABEKMHOPCTYXSIJQWYËÏÈabekmhopctyxsijqwyëïè"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΆΈΊΌΪαικνορυχτάίόϊ"
GREEK_AS = "ABEZHIKMNOPTYXÁÉÍÓÏaikvopuxtáíóï"
LOOKS = {ord(a): b for a, b in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True)}

# Characters that show nothing.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
_IGNORE = re.compile(f"[{IGNORABLE}]+")
#: Characters that make the slow way necessary: ignorables, and accents that may wait for their letter.
_SPECIAL = re.compile(f"[{IGNORABLE}̀-゙゚ͯ]")
# The blanks that a stored text may differ in without differing as stored.
_STORED_BLANKS = re.compile("[ \t\r\n]+")

LETTER, BLANK, MARK, DIGIT = 0, 1, 2, 3


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the letter it looks like, the same in lower case, and its class."""
    n = 0x110000
    fold = np.arange(n, dtype=np.uint32)
    low = fold.copy()
    kind = np.zeros(n, np.uint8)
    for c, b in LOOKS.items():
        fold[c] = ord(b)
    for c in range(0x20000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if (y := x.lower()) != x and y:
            low[c] = ord(y[0])  # only one capital has a longer small form; its dot is dropped below
        cat = unicodedata.category(x)
        kind[c] = BLANK if x.isspace() or c == 0x307 else MARK if cat[0] == "P" else DIGIT if cat == "Nd" else LETTER
    return fold, low[fold], kind


def compose(t: str | None) -> str:
    """Compatibility forms, styles, widths and ignorable characters resolved; look-alike letters stay as they are."""
    if not t or t.isascii():
        return t or ""
    if _SPECIAL.search(t):
        return unicodedata.normalize("NFKC", _IGNORE.sub("", t))
    return unicodedata.normalize("NFKC", t)


def _composed(t: str | None) -> str:
    """compose(), and accents on look-alike letters moved to the letter they look like."""
    if not t or t.isascii():
        return t or ""
    if _SPECIAL.search(t):
        return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", _IGNORE.sub("", t)).translate(LOOKS))
    return unicodedata.normalize("NFKC", t)


def codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def split(arr: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts whose code points end at `ends` in `arr`."""
    s = arr.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [s[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def skeletons(texts: list[str | None]) -> list[str]:
    """The seen text with every look-alike letter as the Latin one: equal exactly where texts look the same."""
    rows = [_composed(t) for t in texts]
    ends = np.cumsum([len(t) for t in rows])
    return [" ".join(t.split()) for t in split(tables()[0][codes(rows)], ends)] if rows else []


def stored_forms(texts: list[str | None]) -> list[str]:
    """The text as stored but for runs of blank, tab and line break."""
    return [_STORED_BLANKS.sub(" ", t or "").strip(" ") for t in texts]


class Bare:
    """The bare texts of a batch: code points, and the end of each text in them."""

    def __init__(self, texts: list[str | None]):
        _, low, kind = tables()
        rows = [_composed(t) for t in texts]
        lens = np.array([len(t) for t in rows], np.int64)
        ends = np.cumsum(lens)
        a = low[codes(rows)]
        k = kind[a]
        digit = k == DIGIT
        inner = np.zeros(len(a), bool)  # marks with a digit on both sides stay
        inner[1:-1] = digit[:-2] & digit[2:]
        starts = ends - lens
        inner[starts[lens > 0]] = False
        inner[ends[lens > 0] - 1] = False
        use = (k == LETTER) | digit | ((k == MARK) & inner)
        self.arr = a[use]
        total = np.concatenate([[0], np.cumsum(use)])
        self.ends = total[ends]
        self.starts = total[starts]
        self.lens = self.ends - self.starts
        self.kept = use

    def texts(self) -> list[str]:
        return split(self.arr, self.ends)


def bare(t: str | None) -> str:
    return Bare([t]).texts()[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit values, in place of uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def grams(arr: np.ndarray, starts: np.ndarray, lens: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of q characters within each text (one for a shorter, non-empty text), their text and their place in `arr`."""
    n = len(arr)
    c = mix(arr.astype(np.uint64) + np.uint64(77))
    g = np.zeros(n, np.uint64)
    for i in range(q):
        g *= np.uint64(0x9E3779B97F4A7C15)
        if i < n:
            g[: n - i] += c[i:]
    ends, ok = starts + lens, np.ones(n, bool)
    for i in range(1, q):  # the last q - 1 places begin no run, but the first of a text always does
        ok[ends[lens > i] - i] = False
    at = np.flatnonzero(ok)
    row = np.repeat(np.arange(len(lens)), np.where(lens > 0, np.maximum(lens - q + 1, 1), 0))
    for r in np.flatnonzero((lens < q) & (lens > 0)):  # a short text must not reach into the next one
        x = np.uint64(lens[r])
        for v in c[starts[r] : starts[r] + lens[r]]:
            x = np.uint64((int(x) * 0x9E3779B97F4A7C15 + int(v)) & 0xFFFFFFFFFFFFFFFF)
        g[starts[r]] = x
    return mix(g[at]), row, at


def trigrams(t: str) -> frozenset[str]:
    """The distinct runs of three characters of a bare text."""
    return frozenset(t[i : i + 3] for i in range(len(t) - 2))


def alike_share(a: frozenset[str], b: frozenset[str]) -> float:
    """The share of all their distinct runs of three characters that occur in both; 0 where there are none."""
    n = len(a & b)
    return n / (len(a) + len(b) - n) if n else 0.0
