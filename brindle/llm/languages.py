"""Problem 1: the language of each document and of each stretch of a mixed one.

The scripts in a text narrow the candidate languages. Every word then gets a score for each of them, from a word model
fitted on a bounded sample of labelled rows (and refitted on those whose label it agrees with); Viterbi decoding with a
penalty for switching, lower between clauses than within them, turns the scores into stretches of one language.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .forms import skeletons
from .io import arrow_map, bounded_sample, plain, slices

# The languages, and other codes and names for them.
LANGS = ("ko", "en", "ja", "zh", "es", "fr", "th", "id", "vi", "ru", "tl", "pt", "tr", "ar")
CODES = {
    "kor": "ko", "eng": "en", "jpn": "ja", "zho": "zh", "chi": "zh", "spa": "es", "fra": "fr", "fre": "fr", "tha": "th", "ind": "id", "vie": "vi",
    "rus": "ru", "tgl": "tl", "fil": "tl", "por": "pt", "tur": "tr", "ara": "ar", "cmn": "zh", "in": "id",
    "korean": "ko", "english": "en", "japanese": "ja", "chinese": "zh", "spanish": "es", "french": "fr", "thai": "th", "indonesian": "id",
    "vietnamese": "vi", "russian": "ru", "tagalog": "tl", "filipino": "tl", "portuguese": "pt", "turkish": "tr", "arabic": "ar",
}
#: Labelled rows that the model is fitted on, the bound of the sample.
SAMPLE = 20_000
#: With fewer usable labels in the sample than this the model starts from SEED_WORDS instead of the labels.
LEAST_LABELLED = 500
# Words of much use in languages that share a script.
SEED_WORDS = {
    "en": "the of and to in that with for was from this are were their which they has after", "es": "el los las del que con para por una más como pero sus fue desde entre y en",
    "fr": "le les des du et est dans pour avec une qui sur aux plus cette ont par au", "id": "yang dan di dari untuk dengan pada ini itu adalah akan tidak para telah oleh ke",
    "vi": "của và các cho được với những trong một là người có này để đã từ tại", "tl": "ang ng mga sa na ay para nang ito siya kung hindi noong mula at upang",
    "pt": "os da do das dos que com para uma não em mais pelo foi ao são pela um", "tr": "ve bir bu için ile olarak daha çok gibi olan sonra kadar oldu ise her",
    "zh": "的 了 是 在 们 这 个 为 与 后 对 应 团 会", "ja": "年 月 日 人 部 表 新 発 売 観 図 気 駅 広",
}
#: Cells of the tables that decoding fills at once: rows times the tokens of the longest.
CELLS = 1 << 18
#: Cost of switching language in nats, between clauses and within one.
BETWEEN, WITHIN = 9.0, 24.0

_TOKEN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿЀ-ӿ]+|[가-힣]+|[぀-ヿｦ-ﾟ]+|[㐀-鿿]|[฀-๿]{1,6}|[؀-ۿ]+|[.!?…。！？؟|\n;]+|(?<=\s)[/—–·-](?=\s)")
_SEPARATOR = re.compile(r"[.!?…。！？؟|\n;/—–·-]")
_CYRILLIC = re.compile("[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯё]")
# Which languages a script admits.
SCRIPTS = {"hangul": ("ko",), "kana": ("ja",), "han": ("zh", "ja"), "thai": ("th",), "arabic": ("ar",), "cyrillic": ("ru",), "latin": ("en", "es", "fr", "id", "vi", "tl", "pt", "tr")}
_SCRIPT_NO = {s: i for i, s in enumerate(SCRIPTS)}
_ADMITS = np.array([[l in SCRIPTS[s] for l in LANGS] for s in SCRIPTS])


def label(declared: str | None) -> str | None:
    """The language that a declared label names; None if it names none of LANGS."""
    if not declared:
        return None
    c = re.split(r"[-_\s]", declared.strip().lower())[0]
    c = CODES.get(c, c)
    return c if c in LANGS else None


def script(w: str) -> str:
    c = w[0]
    if c < "Ѐ" or "Ḁ" <= c <= "ỿ":
        return "cyrillic" if not w.isascii() and _CYRILLIC.search(w) else "latin"
    if c <= "ӿ":
        return "cyrillic"
    if "가" <= c <= "힣":
        return "hangul"
    if "฀" <= c <= "๿":
        return "thai"
    if "؀" <= c <= "ۿ":
        return "arabic"
    return "han" if "㐀" <= c <= "鿿" else "kana"


def tokens(texts: list[str | None]) -> list[list[str]]:
    """Of each text the words, runs of characters where words aren't set apart, and single Han characters, in lower case, with the separators of clauses between them."""
    return [_TOKEN.findall(t.lower()) for t in skeletons([t and t.replace("\n", " | ") for t in texts])]


@lru_cache(1 << 17)
def _script_no(w: str) -> int:
    """The number of a token's script; one more than the last for a separator."""
    return len(_SCRIPT_NO) if _SEPARATOR.match(w) else _SCRIPT_NO[script(w)]


@dataclass
class WordModel:
    """Scores by language of known words, and of unknown ones by script."""

    number: dict[str, int]
    scores: np.ndarray  # of known words, then of the scripts' unknown words, then 0 for separators
    prior: np.ndarray  # how common each language is

    def ids(self, words: list[str]) -> list[int]:
        get, n = self.number.get, len(self.number)
        return [n + _script_no(w) if (k := get(w)) is None else k for w in words]


def _estimate(rows: list[tuple[list[str], int]], least: int = 3) -> WordModel:
    count: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
    for ws, l in rows:
        for w in ws:
            if not _SEPARATOR.match(w):
                count[w][l] += 1
    unknown = np.zeros((len(_SCRIPT_NO), len(LANGS)))
    known = {}
    for w, c in count.items():
        if c.sum() >= least:
            known[w] = c
        else:
            unknown[_SCRIPT_NO[script(w)]] += c
    total = np.sum(list(known.values()), axis=0) + unknown.sum(0) + 1 if known else unknown.sum(0) + 1
    table = np.array([*known.values(), *unknown]) if known else unknown
    p = (table + 0.3) / (total + 0.3 * len(table))  # a few chance counts of a name are no evidence
    s = np.log(p)
    s -= s.max(1, keepdims=True)
    s = np.maximum(s, -9.0)
    n = np.bincount([l for _, l in rows], minlength=len(LANGS)) + 1.0
    return WordModel({w: i for i, w in enumerate(known)}, np.vstack([s, np.zeros(len(LANGS))]).astype(np.float32), np.log(n / n.sum()).astype(np.float32))


def fit(rows: list[tuple[str, str]], rounds: int = 2) -> WordModel:
    """A model from (text, language), some of which are wrong or mixed: refitted on the rows that it agrees with."""
    return _refit([(ws, LANGS.index(l)) for ws, (_, l) in zip(tokens([t for t, _ in rows]), rows)], rounds)


def _refit(data: list[tuple[list[str], int]], rounds: int) -> WordModel:
    model = _estimate(data)
    for _ in range(rounds):
        said = decode([ws for ws, _ in data], model)
        agreed = [d for d, s in zip(data, said) if len(s) == 1 and s[0][0] == d[1]]
        model = _estimate(agreed)
    return model


def fit_unlabelled(texts: list[str], rounds: int = 3) -> WordModel:
    """A model from texts without labels: where scripts, or else most of the SEED_WORDS in a text, name one language, that is its first label."""
    number = {w: [] for words in SEED_WORDS.values() for w in words.split()}
    for l, words in SEED_WORDS.items():
        for w in words.split():
            number[w].append(LANGS.index(l))
    data = []
    for ws in tokens(texts):
        scripts = [*{_script_no(w) for w in ws} - {len(_SCRIPT_NO)}]
        if not scripts:
            continue
        score = np.zeros(len(LANGS))
        for w in ws:
            for l in number.get(w, ()):
                score[l] += 1
        one = [l for l in range(len(LANGS)) if _ADMITS[scripts, l].any() and not any(_ADMITS[k].sum() == 1 and not _ADMITS[k, l] for k in scripts)]
        best = [l for l in one if score[l] == max(score[one])] if len(one) > 1 else one
        if len(best) == 1 and (len(one) == 1 or score[best[0]] >= 2):
            data.append((ws, best[0]))
    return _refit(data, rounds)


def _chunks(rows: list[list[str]], cells: int) -> Iterator[list[int]]:
    """Numbers of the rows that hold something, by length, in parts that fill `cells` at most when padded (or hold one row)."""
    part: list[int] = []
    for i in sorted((i for i, r in enumerate(rows) if r), key=lambda i: len(rows[i])):
        if part and (len(part) + 1) * len(rows[i]) > cells:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def decode(rows: list[list[str]], model: WordModel, cells: int = CELLS) -> list[list[tuple[int, int, int, float]]]:
    """For each row of tokens its stretches (language, first token, token after the last, confidence).

    Rows without words have none. Rows of about one length are decoded at once, shorter ones padded, so that memory goes by
    the longest row or by `cells`.
    """
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in rows]
    nothing = len(model.scores) - 1
    for part in _chunks(rows, cells):
        n, t = len(part), max(len(rows[i]) for i in part)
        ids = np.full((n, t), nothing, np.int64)
        scripts = np.zeros((n, len(_SCRIPT_NO) + 1), bool)
        for r, i in enumerate(part):
            x = model.ids(rows[i])
            ids[r, : len(x)] = x
            scripts[r, [*{_script_no(w) for w in rows[i]}]] = True
        barred = np.where(scripts[:, :-1] @ _ADMITS, 0.0, -60.0).astype(np.float32)
        e = model.scores[ids]
        cost = np.where(ids == nothing, BETWEEN, WITHIN).astype(np.float32)
        v = e[:, 0] + barred + model.prior
        back = np.empty((t, n, len(LANGS)), np.int8)
        own = np.arange(len(LANGS), dtype=np.int8)[None, :]
        for k in range(1, t):
            best = v.argmax(1)
            # a switch is cheap next to a separator
            move = v[np.arange(n), best] - np.minimum(cost[:, k], cost[:, k - 1])
            stay = v >= move[:, None]
            back[k] = np.where(stay, own, best[:, None].astype(np.int8))
            v = np.where(stay, v, move[:, None]) + e[:, k]
        path = np.empty((n, t), np.int8)
        path[:, -1] = v.argmax(1)
        for k in range(t - 1, 0, -1):
            path[:, k - 1] = back[k, np.arange(n), path[:, k]]
        for r, i in enumerate(part):
            m = len(rows[i])
            if not scripts[r, :-1].any():
                continue
            cuts = [0, *(np.flatnonzero(np.diff(path[r, :m])) + 1).tolist(), m]
            for a, b in zip(cuts, cuts[1:]):
                s = e[r, a:b].sum(0) + barred[r] + model.prior
                l = int(path[r, a])
                p = np.exp((s - s.max()) / max(1.0, np.sqrt(b - a)))
                out[i].append((l, a, b, float(p[l] / p.sum())))
    return out


def fit_on(df: DataFrame, text: str, lang: str, key: str, sample: int = SAMPLE) -> WordModel:
    """A model fitted on `sample` labelled rows at most, chosen by a hash of their key; without labels on as many of any."""
    rows = bounded_sample(plain(df, k=key, t=text, l=lang).where("length(t) > 0 and length(l) > 0"), sample, "k", "t")
    known = [(r["t"], l) for r in rows if (l := label(r["l"]))]
    if len(known) >= LEAST_LABELLED:
        return fit(known)
    every = bounded_sample(plain(df, k=key, t=text).where("length(t) > 0"), sample, "k", "t")
    return fit_unlabelled([r["t"] for r in every]) if len(every) > 2 * len(known) else fit(known)


def stretches(df: DataFrame, key: str = "bullet_id", text: str = "t", lang: str = "lang", model: WordModel | None = None) -> DataFrame:
    """(`key`, seg_no, lang, confidence, n_segs, declared) of every stretch of one language of every row.

    seg_no counts from 1 in text order, n_segs is the number of the row's stretches, confidence is between 0 and 1, and
    declared is the language that the row's own label names, null if it names none. Rows with a null or empty text, or
    one without a word of the scripts of LANGS, have no stretch. Repeated rows give repeated rows, other columns are
    ignored whatever their names, and an empty table gives an empty one.
    """
    m = fit_on(df, text, lang, key) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, ls = b.column(0).to_pylist(), b.column(2).to_pylist()
            rows = []
            for i, l, found in zip(ids, ls, decode(tokens(b.column(1).to_pylist()), m)):
                d = label(l)
                rows.extend((i, k + 1, LANGS[f[0]], f[3], len(found), d) for k, f in enumerate(found))
            types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=[key, "seg_no", "lang", "confidence", "n_segs", "declared"])

    return arrow_map(plain(df, k=key, t=text, l=lang), run, f"`{key}` long, seg_no int, lang string, confidence double, n_segs int, declared string")
