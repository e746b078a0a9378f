"""Problem 9: sentence boundaries across languages and scripts.

A linear-chain model tags every character as boundary or inside; characters that can't end a sentence (inside words,
numbers, addresses, brackets and quotations) are fixed to inside, the others get a score from the words around them with
the punctuation stripped, from the mark itself and from the distance to the boundary before, and Viterbi decoding
picks the best tagging. The words' weights are learned from positions whose tag is beyond doubt (ends of units, marks
that always end, commas) in a bounded sample, so the same model also finds ends where a script has no marks, as the
blanks of Thai.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .io import arrow_map, bounded_sample, plain, slices

#: Documents that the model is fitted on, the bound of the sample.
SAMPLE = 3000
#: Characters from which on a unit in a script without blanks is looked at for ends without marks.
UNMARKED = 40
#: How far the learned score of an end without a mark must lie above that of none.
SURE = 0.0

LIST_MARK = r"[ \t]*(?:[-•*‣◦▪·]|\(?\d{1,2}[.)])[ \t 　]+"
_UNITS = re.compile(rf"[^\S\n]*\n(?:[^\S\n]*\n\s*|(?={LIST_MARK}))")
_MARKED = re.compile(rf"\s*{LIST_MARK}")
_MARKS = ".!?…。！？؟"
_ANY_MARK = re.compile(f"[{_MARKS}]")
_CLOSERS = "\"'”’»」』)）]】"
_EVENT = re.compile(r"https?://[^\s()（）「」『』“”\"'<>]+|[.!?…。！？؟]+|[,、，،;；]|[\"“«「『‘']|[(（\[【]|(?<=[฀-๿])\s+(?=[฀-๿])")
_PLAIN_EVENT = re.compile(r"[.!?…。！？؟\"“«「『‘'(（\[【฀-๿]")
# Quotation marks and brackets by their openings.
CLOSE = {'"': '"', "“": "”", "«": "»", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", "[": "]", "【": "】"}
_SINGLE = re.compile(rf"[{_MARKS}]'|'(?!\w)")
_SINGLE_MARKED = re.compile(rf"[{_MARKS}]'")
_WORD_END = re.compile(r"\w+$")
_WORD = re.compile(r"\w+")
_NEXT = re.compile(r"\s*[\"“«「『‘'(（\[¿¡-]*\s*(\w*)")
# Abbreviations that are written with a point, of the languages at hand.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st vs no vol ver feat approx fig etc jr sr sra srta dra ud uds pág núm av avda aprox ej ee uu p pp cf env m mme mlle bd éd fil tp ths ts pgs gs bs q dll dsb dst "
    "jl tn ny hal ex е a.n yth gng g bb blg hon atty e.g i.e eg ie j.-c j.c c d.c проф прибл ул д т г гг им тыс см стр др напр د أ م ص dr doç yrd yakl bkz örn no.lu sn vb mah cad พ.ศ ดร รร ค.ศ น.ส ม.ร.ว นพ พญ".split()
)


def is_thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def dense(c: str) -> bool:
    """Whether c is of a script without blanks between words, other than Thai."""
    return "぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "㐀" <= c <= "䶿"


_DENSE = re.compile("[぀-ヿ一-鿿㐀-䶿]")


def mostly_dense(text: str, a: int, b: int) -> bool:
    return bool(_DENSE.search(text, a, b)) and len(_DENSE.findall(text, a, b)) > 0.6 * (b - a)


def before(text: str, i: int) -> tuple[str, str]:
    """The key of what stands before position i, and its shape: the word, or the last characters where words aren't set apart."""
    c = text[i - 1 : i]
    if not c:
        return "", "none"
    if is_thai(c):
        return text[max(0, i - 4) : i], "thai"
    if dense(c):
        return text[max(0, i - 2) : i], "dense"
    m = _WORD_END.search(text, max(0, i - 30), i)
    if not m:
        return c, "mark"
    w = m[0]
    if "가" <= c <= "힣":
        return w, "hangul-" + c
    if c.isdigit():
        k = m.start()
        n = _WORD_END.search(text, max(0, k - 20), k - 1) if k > 1 else None
        return (n[0].lower() if n else "") + " 0", "digit"
    return w.lower() if not w[0].isupper() or len(w) < 3 else w, "cap" if w[0].isupper() else "lower" if w[0].islower() else "word"


def after(text: str, i: int, end: int) -> tuple[str, str]:
    """The key of what follows position i, and its shape."""
    m = _NEXT.match(text, i, end)
    w = m[1] if m else ""
    if not w:
        return "", "none"
    c = w[0]
    if is_thai(c):
        return w[:4], "thai"
    if dense(c):
        return w[:2], "dense"
    if "가" <= c <= "힣":
        return w, "hangul"
    if c.isdigit():
        return "0", "digit"
    return w, "cap" if c.isupper() else "lower" if c.islower() else "word"


def units(text: str) -> list[tuple[int, int]]:
    """Start and end of each paragraph, heading or list item, without list marks and blanks around."""
    out = []
    at = 0
    for m in [*_UNITS.finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        if m:
            at = m.end()
        if x := _MARKED.match(text, a, b):
            a = x.end()
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def closing(text: str, i: int, end: int) -> int:
    """Where the quotation or bracket opened at i closes; -1 if it doesn't, or if this opens none."""
    c = text[i]
    if c == "'":
        if i and text[i - 1].isalnum() or i + 1 >= end or text[i + 1].isspace():
            return -1
        m = _SINGLE_MARKED.search(text, i + 1, end) or _SINGLE.search(text, i + 1, end)
        return m.end() - 1 if m else -1
    return text.find(CLOSE[c], i + 1, end)


def events(text: str, a: int, b: int) -> Iterator[tuple[str, int, int, bool]]:
    """Marks, commas and Thai blanks of a unit outside addresses, brackets and quotations: (kind, start, end, first).

    Kinds: the mark itself ('.' also for several, unless they are three dots), ',' for commas, ' ' for a blank between
    Thai characters, 'q' after a quotation that holds its own mark; first tells that the quotation began its sentence,
    so that who said it follows.
    """
    at = a
    while m := _EVENT.search(text, at, b):
        c, i, j = m[0][0], m.start(), m.end()
        at = j
        if c == "h":
            while text[at - 1] in ".,;:!?":  # the address doesn't hold the mark after it
                at -= 1
            if at < j and at > i:
                continue
        elif c in CLOSE or c == "'":
            if (k := closing(text, i, b)) >= 0:
                at = k + 1
                if c not in "([（【" and text[k - 1] in _MARKS and at < b and text[at].isspace():
                    p = i
                    while p > a and text[p - 1].isspace():
                        p -= 1
                    yield "q", k, at, p == a or text[p - 1] in _MARKS + _CLOSERS
        elif c in ",、，،;；":
            yield ",", i, j, False
        elif c.isspace():
            yield " ", i, i, False
        else:
            s = m[0]
            kind = "…" if "…" in s or len(s) > 2 and set(s) == {"."} else "。" if set(s) & set("。！？") else "!" if set(s) & set("!?؟") else "."
            while at < b and text[at] in _CLOSERS and not (text[at] in "\"'" and at + 1 < b and text[at + 1].isalnum() and "가" > text[at + 1]):
                at += 1
            yield kind, i, at, False


def stripped(text: str, a: int, b: int) -> tuple[str, list[int]]:
    """The letters and digits of text[a:b], and the place of each."""
    at = [i for i in range(a, b) if text[i].isalnum()]
    return "".join(text[i] for i in at), at


def unmarked(text: str, a: int, b: int) -> bool:
    """Whether a unit is long, of a script without blanks (other than Thai), and without any mark that could end a sentence."""
    return b - a >= UNMARKED and not _ANY_MARK.search(text, a, b) and mostly_dense(text, a, b)


class Tagger:
    """A linear chain over characters without punctuation: each is tagged as the first of a sentence or as inside one.

    Emissions are log-odds of the runs of characters before and after, joined by logistic regression; transitions are
    log-odds of a sentence's length so far, up to MOST characters, all counted on text whose punctuation was stripped.
    """

    MOST = 60

    def __init__(self, rows: list[tuple[str, list[int]]]):
        """Fitted on (stripped text, places of the firsts of sentences but for 0)."""
        yes, no = Counter(), Counter()
        last, lived = np.ones(self.MOST + 1), np.ones(self.MOST + 1) * 2
        for s, firsts in rows:
            ends = set(firsts)
            at = 0
            for p in range(1, len(s)):
                n = min(p - at, self.MOST)
                lived[n] += 1
                (yes if p in ends else no).update(self._keys(s, p))
                if p in ends:
                    last[n] += 1
                    at = p
        n_yes, n_no = max(1, sum(len(f) for _, f in rows)), max(1, sum(max(0, len(s) - 1 - len(f)) for s, f in rows))
        rate = n_yes / n_no
        self.odds = {k: log((yes[k] + 0.5) / (no[k] + 0.5 / rate) / rate) for k in yes.keys() | no.keys() if yes[k] + no[k] >= 2}
        self.prior = log(rate)
        hazard = last / lived
        smooth = np.convolve(np.pad(hazard, 2, "edge"), np.ones(5) / 5, "valid")
        self.length = np.clip(np.log(np.maximum(smooth, 1e-4) / (1 - np.minimum(smooth, 0.99))) - self.prior, -6, 2)
        self.weights = np.ones(6) * 0.5
        x = [self._x(s, p) for s, _ in rows for p in range(1, len(s))]
        if x:
            x, y = np.array(x), np.concatenate([np.isin(np.arange(1, len(s)), f) for s, f in rows]).astype(float)
            w = np.append(self.weights, self.prior)
            x = np.column_stack([x, np.ones(len(x))])
            for _ in range(15):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(7)
                w = w + np.linalg.solve(h, x.T @ (y - p) - np.append(w[:-1], 0) * 1.0)
            self.weights, self.prior = w[:-1], float(w[-1])

    @staticmethod
    def _keys(s: str, p: int) -> tuple[str, ...]:
        return "<" + s[max(0, p - 1) : p], "<" + s[max(0, p - 2) : p], "<" + s[max(0, p - 4) : p], ">" + s[p : p + 1], ">" + s[p : p + 2], ">" + s[p : p + 4]

    def _x(self, s: str, p: int) -> list[float]:
        return [self.odds.get(k, 0.0) for k in self._keys(s, p)]

    def firsts(self, s: str) -> list[int]:
        """The places at which sentences begin, other than 0, by Viterbi over place and length of the sentence so far."""
        n, m = len(s), self.MOST
        if n < 2:
            return []
        emit = np.array([self._x(s, p) for p in range(1, n)]) @ self.weights + self.prior - SURE
        score = np.full(m + 1, -np.inf)
        score[1] = 0.0  # one character of the sentence is there
        begun = np.zeros(n, np.int32)  # length of the sentence before, where one begins
        came = []  # for the longest state, whether it came from itself
        for p in range(1, n):
            begin = score + emit[p - 1] + self.length
            k = int(begin.argmax())
            begun[p] = k
            stay = np.full(m + 1, -np.inf)
            stay[2:] = score[1:-1]
            came.append(bool(score[m] > score[m - 1]))
            stay[m] = max(score[m - 1], score[m])
            stay[1] = begin[k]
            score = stay
        out, p, k = [], n - 1, int(score.argmax())
        while p > 0:
            if k == 1:
                out.append(p)
                k = int(begun[p])
            elif not (k == m and came[p - 1]):
                k -= 1
            p -= 1
        return out[::-1]


@dataclass
class Model:
    """Log-odds of a boundary by what stands before and after, and the weights that join them."""

    left: dict[str, float] = field(default_factory=dict)
    right: dict[str, float] = field(default_factory=dict)
    left_shape: dict[str, float] = field(default_factory=dict)
    right_shape: dict[str, float] = field(default_factory=dict)
    abbreviated: dict[str, float] = field(default_factory=dict)
    tagger: Tagger | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 0.0)

    def context(self, text: str, i: int, j: int, end: int) -> tuple[float, float]:
        w, shape = before(text, i)
        v, next_shape = after(text, j, end)
        x = self.left.get(w)
        y = self.right.get(v)
        return x if x is not None else self.left_shape.get(shape, 0.0), y if y is not None else self.right_shape.get(next_shape, 0.0)

    def score(self, text: str, kind: str, i: int, j: int, end: int) -> float:
        """How much more likely a boundary at j, behind the mark at i, is than none."""
        if kind in "!。":
            return 9.0
        x, y = self.context(text, i, j, end)
        s = self.weights[0] * x + self.weights[1] * y + self.weights[2]
        nxt = text[j] if j < end else ""
        if kind == " ":
            return self.left.get(before(text, i)[0], -4.0) * 2
        if kind == "q":
            return 4.0 if nxt and after(text, j, end)[1] == "cap" else -9.0
        if kind == "…":
            if i and text[i - 1].isspace():
                return s - 6.0
            return s + (1.0 + (y > 2.5) if nxt.isspace() else -3.0)
        w, shape = before(text, i)
        word = w.lower()
        if w not in self.left and not word.isdigit():
            x = max(x, -0.3)  # that a word is unknown says nothing about its point
        s = 5.0 + max(-8.0, min(6.0, self.weights[0] * x + self.weights[1] * y + self.weights[2])) + self.abbreviated.get(word, 0.0)
        if word in ABBREVIATIONS or (shape == "thai" and not nxt.isspace()):
            s -= 9.0
        elif shape == "cap" and len(w) == 1:
            s -= 6.0
        elif i > 1 and not text[i - 1].isspace() and (k := text.rfind(".", max(0, i - 5), i)) > 0 and text[k - 1 : k].isalpha() and text[k + 1 : i].strip("-").isalpha() and len(w) <= 2:
            s -= 9.0  # points within the word, as in J.-C. or v.v.
        if not nxt.isspace():
            n = after(text, j, end)[1] if nxt.isalnum() or nxt in _OPENERS else "mark"
            s -= {"digit": 9.0, "mark": 9.0, "lower": 5.0, "thai": 9.0}.get(n, 0.0)
        return s


_OPENERS = "\"“«「『‘'(（["


def fit(texts: list[str]) -> Model:
    """A model from the positions of `texts` that are beyond doubt."""
    ends, mids, starts, inner, dotted = Counter(), Counter(), Counter(), Counter(), Counter()
    end_shape, mid_shape, start_shape, inner_shape = Counter(), Counter(), Counter(), Counter()
    sure: list[tuple[str, int, int, int, int]] = []
    for text in texts:
        for a, b in units(text):
            i = b
            while i > a and text[i - 1] in _MARKS + _CLOSERS:
                i -= 1
            marked = [*events(text, a, b)]
            if len(marked) > 1 or b - a > 60:  # a sentence rather than a heading
                w, s = before(text, i)
                ends[w] += 1
                end_shape[s] += 1
            w, s = after(text, a, b)
            starts[w] += 1
            start_shape[s] += 1
            for kind, p, q, _ in marked:
                if q >= b:
                    continue
                w, s = before(text, p)
                v, t = after(text, q, b)
                if kind in "!。":
                    ends[w] += 1
                    end_shape[s] += 1
                    starts[v] += 1
                    start_shape[t] += 1
                    sure.append((text, p, q, b, 1))
                elif kind == ",":
                    mids[w] += 1
                    mid_shape[s] += 1
                    inner[v] += 1
                    inner_shape[t] += 1
                    sure.append((text, p, q, b, 0))
                elif kind == ".":
                    dotted[w.lower()] += 1
            words = [*_WORD.finditer(text, a, b)]
            for m, n in zip(words, words[1:]):  # words that follow each other
                if n.start() == m.end() + 1 and text[m.end()] == " " and not is_thai(text[m.end() - 1]):
                    w, s = before(text, m.end())
                    mids[w] += 1
                    mid_shape[s] += 1
                    v, t = after(text, n.start(), b)
                    inner[v] += 1
                    inner_shape[t] += 1
            if any(is_thai(c) for c in text[a : a + 40]):
                for p in range(a + 4, b, 7):
                    if is_thai(text[p - 1]):
                        w, s = before(text, p)
                        mids[w] += 1

    unpunctuated = []  # text of scripts without blanks, its punctuation stripped, and where its sentences begin
    for text in texts:
        for a, b in units(text):
            if mostly_dense(text, a, b):
                marked = [q for kind, _, q, _ in events(text, a, b) if kind == "。" and q < b]
                s, at = stripped(text, a, b)
                if marked and len(s) > 10:
                    unpunctuated.append((s, sorted({int(np.searchsorted(at, e)) for e in marked} - {0, len(s)})))

    def odds(yes: Counter, no: Counter, least: int) -> dict[str, float]:
        n, m = sum(yes.values()) + 1, sum(no.values()) + 1
        rate = n / m
        return {w: max(-5.0, min(5.0, log((yes[w] + 0.3) / (no[w] + 0.3 / rate) / rate))) for w in yes.keys() | no.keys() if yes[w] + no[w] >= least}

    model = Model(odds(ends, mids, 3), odds(starts, inner, 3), odds(end_shape, mid_shape, 1), odds(start_shape, inner_shape, 1))
    if sum(len(f) for _, f in unpunctuated) >= 20:
        model.tagger = Tagger(unpunctuated)
    base = (sum(ends.values()) + 1) / (sum(ends.values()) + sum(dotted.values()) + 1)
    by_lower = Counter()
    for w, n in ends.items():
        by_lower[w.lower()] += n
    for w, n in dotted.items():  # a word that has its point time and again, but hardly ever ends anything, is abbreviated
        if n >= 4 and model.left.get(w, 0.0) <= 1.0:
            model.abbreviated[w] = min(0.0, 3 * log((by_lower[w] + 4 * base) / (n + by_lower[w] + 4) / base)) if len(w) <= 5 else 0.0
    if sure:
        x = np.array([[*model.context(t, p, q, b), 1.0] for t, p, q, b, _ in sure])
        y = np.array([s[-1] for s in sure], float)
        w = np.zeros(3)
        for _ in range(12):  # logistic regression by Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-4)[:, None]).T @ x + np.diag([0.5, 0.5, 0.5])
            w = w + np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
        model.weights = (float(np.clip(w[0], 0.5, 2)), float(np.clip(w[1], 0.2, 2)), float(np.clip(w[2], -2, 0)))
    return model


def decode(cands: list[tuple[int, float]], start: int, near: int = 3, cost: float = 6.0) -> list[int]:
    """Viterbi over the characters that may be boundaries, (place, score): the boundaries of the best tagging.

    All characters between are inside at no cost, so only the candidates are steps. A boundary within `near` characters
    of the one before costs `cost`, which makes the chain first-order in the last boundary.
    """
    # Best total with the last boundary at each of the last few candidates, and the way back.
    states: list[tuple[float, int, int | None]] = [(0.0, start, None)]  # total, last boundary, index of it in back
    back: list[tuple[int, int | None]] = []
    for at, score in cands:
        total, last, link = max((t - (cost if at - p <= near else 0.0), -p, k if k is not None else -1) for t, p, k in states)
        back.append((at, None if link == -1 else link))
        states.append((total + score, at, len(back) - 1))
        if len(states) > 4:  # boundaries further back than `near` differ by their total alone
            far = [s for s in states if at - s[1] > near]
            states = ([max(far, key=lambda s: s[0])] if far else []) + [s for s in states if at - s[1] <= near]
    out = []
    k = max(states, key=lambda s: s[0])[2]
    while k is not None:
        out.append(back[k][0])
        k = back[k][1]
    return out[::-1]


def sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """Start and end of every sentence, heading and list item, in code points."""
    out = []
    for a, b in units(text):
        cands = []
        if _PLAIN_EVENT.search(text, a, b):
            for kind, i, j, first in events(text, a, b):
                if kind != "," and j < b and not (kind == "q" and first):
                    if not (kind == "。" and text[j : j + 1] in "、，,"):
                        cands.append((j, model.score(text, kind, i, j, b)))
        at = a
        if not cands and model.tagger is not None and unmarked(text, a, b):
            letters, places = stripped(text, a, b)
            cuts = [places[p] for p in model.tagger.firsts(letters)]
            for j in cuts:
                end = j
                while not text[end - 1].isalnum():
                    end -= 1
                out.append((at, end))
                at = j
            out.append((at, b))
            continue
        for j in decode(cands, a) if cands else ():
            out.append((at, j))
            at = j
            while text[at].isspace():
                at += 1
        out.append((at, b))
    return out


def fit_on(df: DataFrame, text: str, key: str, sample: int = SAMPLE) -> Model:
    """A model fitted on `sample` documents at most, chosen by a hash of their key."""
    rows = bounded_sample(plain(df, k=key, t=text).where("length(t) > 0"), sample, "k", "t")
    return fit([r["t"] for r in rows])


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(`key`, start_pos, end_pos, sentence) of every sentence of every document.

    Offsets are in code points of the stored text, from 0, end exclusive, without blanks around. A null, empty or blank
    text has no sentences; a very long one is handled unit by unit. Repeated rows give repeated rows, other columns are
    ignored whatever their names, and an empty table gives an empty one.
    """
    m = fit_on(df, text, key) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, starts, ends, said = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    for x, y in sentences(t, m):
                        ids.append(k)
                        starts.append(x)
                        ends.append(y)
                        said.append(t[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(said, pa.string())], names=[key, "start_pos", "end_pos", "sentence"])

    return arrow_map(plain(df, k=key, t=text), run, f"`{key}` long, start_pos int, end_pos int, sentence string")
