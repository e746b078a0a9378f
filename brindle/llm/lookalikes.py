"""Problem 2: text that looks the same but is stored in different characters.

Stored words are walked, unfolded, through a vocabulary trie by a weighted edit automaton in which look-alike letters and
ignorable characters cost nothing; a match yields the vocabulary's spelling. Words without a match are spelled by a table.
Either way the outcome depends only on what the word looks like, so texts that look the same become equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import keep
from .forms import CYRILLIC, CYRILLIC_AS, GREEK, IGNORABLE, LOOKS, _composed, compose, stored_forms
from .io import arrow_map, hash128, plain, slices

#: Words of alphabets that have look-alikes in each other.
WORD = re.compile("[A-Za-zÀ-ɏͰ-ϿЀ-ӿԚԛԜԝḀ-ỿ]+")
_ASCII_TOKENS = re.compile("([A-Za-z]+)")
ACCENTS = "\u0300-\u036f"
_BACK = {b: a for a, b in zip(CYRILLIC, CYRILLIC_AS, strict=True) if a not in "ЅІЈԚԜҮЇЀѕіјԛԝүїѐ"}
_GREEK = frozenset(GREEK)


def _look(word: str) -> str:
    return _composed(word).translate(LOOKS)


def _cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "ԯ"


def table_spelling(look: str) -> str:
    """The spelling of a word by table: in Cyrillic if a letter of it can only be Cyrillic and none only Latin, else in Latin."""
    only = [c for c in look if _cyrillic(c)]
    if only and all(_cyrillic(c) or c in _BACK for c in look):
        return "".join(_BACK.get(c, c) for c in look)
    return look


@cache
def token_pattern() -> re.Pattern:
    """Runs of stored characters that a word may be written in: its letters in any form, accents by themselves, and ignorables."""
    chars = [c for c in map(chr, range(0x20000)) if not "\ud800" <= c <= "\udfff" and WORD.search(unicodedata.normalize("NFKD", c))]
    spans: list[list[str]] = []
    for c in chars:
        if spans and ord(c) == ord(spans[-1][1]) + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    letters = "".join(f"{re.escape(x)}-{re.escape(y)}" for x, y in spans)
    return re.compile(f"([{letters}{ACCENTS}{IGNORABLE}]+)")


#: A stored character with what stands on it or shows nothing.
_CLUSTER = re.compile(f"[{ACCENTS}{IGNORABLE}]*.[{ACCENTS}{IGNORABLE}]*|[{ACCENTS}{IGNORABLE}]+", re.S)
_LABELS = re.compile(f".[{ACCENTS}]*", re.S)


@lru_cache(1 << 16)
def _labels(cluster: str) -> tuple[str, ...]:
    """The edges that a stored character, with its accents, takes at no cost: none if it shows nothing, several if it stands for several letters."""
    return tuple(_LABELS.findall(_look(cluster)))


class Trie:
    """Vocabulary by what its words look like, an edge for each letter seen; each end holds the spelling to use.

    A stored word is walked through it as it is. An edge is taken at no cost by every stored form of its letter:
    look-alikes of other alphabets, compatibility forms, letters with their accents apart. Ignorables take no edge.
    """

    __slots__ = ("root",)

    def __init__(self, words: list[tuple[str, str]]):
        self.root: dict = {}
        for look, spelling in words:
            node = self.root
            for c in _LABELS.findall(look):
                node = node.setdefault(c, {})
            node[""] = spelling

    def match(self, word: str, budget: float = 0.0, other: float = 1.0) -> tuple[str, float] | None:
        """The spelling at the least weighted edit distance within `budget`, and that distance.

        Look-alikes and ignorables cost 0, any other change, loss or addition of a letter `other`. Ties go to the
        first spelling in code point order.
        """
        states: dict[int, tuple[dict, float]] = {id(self.root): (self.root, 0.0)}
        for stored in word if word.isascii() else _CLUSTER.findall(word):
            for c in (stored,) if stored.isascii() else _labels(stored):
                if budget:
                    states = self._closure(states, budget, other)
                after: dict[int, tuple[dict, float]] = {}
                for node, cost in states.values():
                    steps = [(node[c], cost)] if c in node else []
                    if cost + other <= budget:
                        steps += [(node, cost + other)] + [(n, cost + other) for k, n in node.items() if k and k != c]
                    for n, x in steps:
                        if id(n) not in after or after[id(n)][1] > x:
                            after[id(n)] = (n, x)
                if not (states := after):
                    return None
        if budget:
            states = self._closure(states, budget, other)
        ends = [(x, n[""]) for n, x in states.values() if "" in n]
        return min(ends)[::-1] if ends else None

    @staticmethod
    def _closure(states: dict, budget: float, other: float) -> dict:
        """The states with letters of the vocabulary passed over."""
        todo = list(states.values())
        while todo:
            node, cost = todo.pop()
            if cost + other <= budget:
                for k, n in node.items():
                    if k and (id(n) not in states or states[id(n)][1] > cost + other):
                        states[id(n)] = (n, cost + other)
                        todo.append(states[id(n)])
        return states


def vocabulary(df: DataFrame, text: str, size: int = 20_000, least: int = 3) -> list[tuple[str, str]]:
    """(look, spelling) of the common words written in one alphabet, counted over all rows; of the spellings of a look the commonest.

    Common are words that make up a share of 1 / `size` of all words at least, which can't be more than `size` words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = []
            for w, n in seen.items():
                if w.isascii() or not (any(map(_cyrillic, w)) and any(not _cyrillic(c) for c in w) or _GREEK.intersection(w)):
                    rows.append((_look(w), w, n))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["look", "w", "n"])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(WORD.findall(compose(t)))
            if len(seen) > 500_000:
                yield out()
        yield out()

    n = keep(arrow_map(plain(df, t=text), count, "look string, w string, n long").groupBy("look", "w").agg(F.sum("n").alias("n")), "words")
    total = n.agg(F.sum("n")).first()[0] or 0
    top = sorted(n.where(F.col("n") >= max(least, total / size)).collect(), key=lambda r: (-r["n"], r["w"]))
    best: dict[str, str] = {}
    for r in top:
        best.setdefault(r["look"], r["w"])
    return sorted(best.items())


class Canon:
    """Texts to their one form, by a vocabulary."""

    def __init__(self, words: list[tuple[str, str]]):
        self.trie, self.known = Trie(words), {}

    def token(self, w: str) -> str:
        """The spelling of a stored word: the vocabulary's, or else by table."""
        if (x := self.known.get(w)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            if m := self.trie.match(w):
                x = m[0]
            elif WORD.fullmatch(s := _accents(compose(w))):
                x = table_spelling(_look(s))
            else:  # several words, as where one character stands for letters and marks
                x = WORD.sub(lambda m: self.token(m[0]), s)
            self.known[w] = x
        return x

    def text(self, t: str | None) -> str | None:
        if t is None:
            return None
        parts = (_ASCII_TOKENS if t.isascii() else token_pattern()).split(t)
        parts[1::2] = map(self.token, parts[1::2])
        if not t.isascii():
            parts[::2] = map(compose, parts[::2])
            return " ".join(unicodedata.normalize("NFC", "".join(parts)).split())
        return " ".join("".join(parts).split())


def _accents(s: str) -> str:
    """Accents that stand after a look-alike letter joined with the letter it looks like."""
    if s.isascii() or not any("̀" <= c <= "ͯ" for c in s):
        return s
    out = list(s)
    for i, c in enumerate(out):
        if i and "̀" <= c <= "ͯ" and ord(out[i - 1]) in LOOKS:
            out[i - 1] = LOOKS[ord(out[i - 1])]
    return unicodedata.normalize("NFC", "".join(out))


def canonical(df: DataFrame, key: str = "bullet_id", text: str = "t", words: list[tuple[str, str]] | None = None) -> DataFrame:
    """Every row's text in its one form: (`key`, canonical, changed).

    A null text stays null (changed false), an empty or blank one becomes empty. Repeated rows give repeated rows; other
    columns of the input, whatever their names, are ignored. An empty table gives an empty one.
    """
    known = vocabulary(df, text) if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(known)
        for b in slices(batches):
            ts = b.column(1).to_pylist()
            out = [canon.text(t) for t in ts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array([a != c for a, c in zip(ts, out)])], names=[key, "canonical", "changed"])

    src = plain(df, k=key, t=text)
    return arrow_map(src, run, f"`{key}` {src.schema['k'].dataType.simpleString()}, canonical string, changed boolean")


def same_looking_pairs(df: DataFrame, key: str = "bullet_id", text: str = "t") -> DataFrame:
    """Pairs (`key`_a < `key`_b) of rows with equal canonical text whose stored texts differ by more than runs of blank, tab and line break.

    Null, empty and blank texts are in no pair. Copies stored alike are grouped by hash first, so that only texts that
    do come in several stored forms reach the pairing; a hot form is split by adaptive skew handling.
    """
    known = vocabulary(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(known)
        for b in slices(batches):
            ids, ts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for i, t, s in zip(ids, ts, stored_forms(ts)):
                if t and (c := canon.text(t)):
                    rows.append((i, *hash128(c), hash128(s)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["id", "c1", "c2", "s"])

    rows = keep(arrow_map(plain(df, k=key, t=text), run, "id long, c1 long, c2 long, s long"), "looks")
    several = rows.groupBy("c1", "c2").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("c1", "c2")
    mine = keep(rows.join(several, ["c1", "c2"], "left_semi"), "several")
    a, b = (mine.select("c1", "c2", F.col("id").alias(f"id_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
    return a.join(b, ["c1", "c2"]).where("id_a < id_b and s_a <> s_b").select(F.col("id_a").alias(f"{key}_a"), F.col("id_b").alias(f"{key}_b")).distinct()
