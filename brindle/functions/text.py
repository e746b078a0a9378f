"""String functions on columns: tokens, scripts, counts and keywords. All stay in the JVM.

Digits and blanks are Unicode's, as in the engine's definitions; look-around is used where Java has it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

KANA, HAN, THAI, HANGUL, CYRILLIC = "[\\u3040-\\u30ff]", "[\\u4e00-\\u9fff]", "[\\u0e00-\\u0e7f]", "[가-힣]", "[\\u0400-\\u04ff]"
VIETNAMESE, LATIN_EXT, LATIN = "[đơưĐƠƯ]|[\\u1e00-\\u1eff]", "[\\u00c0-\\u024f]", "[A-Za-z]"
TOKEN = "[가-힣A-Za-z0-9\\u00c0-\\u024f\\u1e00-\\u1eff\\u0400-\\u04ff]{2,}"
OLD_TOKEN = "[가-힣A-Za-z0-9]{2,}"
WORD = "[^\\s.,;:!?\"'“”‘’()\\[\\]{}<>·•\\-–—/\\\\|~`^*+=_@#$%&《》「」『』]+"
HOST_LIKE = "(?iU)(?<![\\w.])(?:[a-z0-9-]+\\.)+[a-z]{2,}(?![\\w.])"
NUMBER = "\\p{Nd}+[.,]?\\p{Nd}*[\\s\\p{Z}]*(?:" + "|".join(V.UNITS) + ")"


def literal(s: str) -> str:
    """A string as a pattern that matches it."""
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", s)


def array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def find_all(t: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def strip_hosts(t: Column) -> Column:
    """Host-like fragments, as a.example, replaced by a blank."""
    return F.regexp_replace(t, HOST_LIKE, " ")


def strip_particle(w: Column, particles: list[str] | None = None) -> Column:
    """The longest ending of the list that leaves at least two characters is cut, once."""
    ends = "|".join(sorted({literal(p) for p in particles or V.PARTICLES}, key=lambda p: (-len(p), p)))
    cut = F.regexp_replace(w, f"^(.{{2,}}?)(?:{ends})$", "$1")
    if particles is not None:
        return cut
    last = "".join(sorted({p[-1] for p in V.PARTICLES}))
    return F.when(w.rlike(f"[{last}]$"), cut).otherwise(w)  # most words end otherwise, and the long pattern is spared


def keep_word(w: Column, stop: list[str] | None = None, stop_lower: list[str] | None = None) -> Column:
    """Whether a token is kept: two characters or more, no stop word (in its own case, and in lower case), not only digits."""
    stop = V.STOP_KO + V.STOP_KO_MORE if stop is None else stop
    lower = V.STOP_EN + V.STOP_EN_MORE + V.STOP_LATIN + V.STOP_RU if stop_lower is None else stop_lower
    return (F.length(w) >= 2) & ~w.isin(*stop) & ~F.lower(w).isin(*lower) & ~w.rlike("^\\p{Nd}+$")


def generic_tokens(t: Column, slug: Column | None = None) -> Column:
    """Tokens of a text: host fragments out, endings cut, stop words out, and words that repeat the source's own name."""
    words = F.transform(find_all(strip_hosts(t), TOKEN), lambda w: strip_particle(w))
    words = F.filter(words, lambda w: keep_word(w))
    if slug is None:
        return words
    # the name is bound to a variable, lest it be worked out anew for every word
    return F.get(F.transform(F.array(F.coalesce(slug, F.lit(""))), lambda s: F.filter(words, lambda w: F.lower(w) != s)), F.lit(0))


def vectorizer_words(doc: Column) -> Column:
    """The words that a bag-of-words model sees: lower case, split at whatever is no letter, digit or underscore."""
    return find_all(F.lower(doc), "[\\p{L}\\p{N}_]+")


def token_script(w: Column) -> Column:
    rules = ((KANA, "kana"), (HAN, "han"), (THAI, "thai"), (HANGUL, "hangul"), (CYRILLIC, "cyrillic"), ("[A-Za-z\\u00c0-\\u024f\\u1e00-\\u1eff]", "latin"))
    return _first(w, rules, "other")


def _first(w: Column, rules, default: str) -> Column:
    out = F
    for p, name in rules:
        out = out.when(w.rlike(p), name)
    return out.otherwise(default)


def single_bucket(t: Column) -> Column:
    """The one script bucket of a text, by precedence."""
    return _first(t, ((KANA, "ja"), (HAN, "zh"), (THAI, "th"), (HANGUL, "ko"), (CYRILLIC, "ru"), (VIETNAMESE, "vi"), (LATIN_EXT, "latin"), (LATIN, "en")), "other")


def buckets(t: Column) -> Column:
    """All script buckets that a text has words of, sorted: kana stand for ja, runs of Han characters without kana for zh, words by their own letters."""
    words = F.filter(find_all(t, WORD), lambda w: ~w.rlike("^[\\p{Nd},.%]+$"))
    own = F.transform(words, lambda w: F.when(w.rlike(HANGUL), "ko").when(w.rlike(CYRILLIC), "ru").when(w.rlike(VIETNAMESE), "vi").when(w.rlike(f"{KANA}|{HAN}|{THAI}"), None).when(w.rlike("^[\\x00-\\x7f]+$"), F.when(w.rlike(LATIN), "en")).otherwise("latin"))
    east = F.when(t.rlike(KANA), "ja").when(t.rlike(HAN + "{2,}"), "zh")
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(east, F.when(t.rlike(THAI), "th")), own), lambda x: x.isNotNull())))


def number_count(t: Column) -> Column:
    """Numbers followed by a counting unit."""
    return F.regexp_count(t, F.lit(NUMBER))


def digit_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit("[0-9]"))


def years(t: Column, lo: int = V.YEARS[0], hi: int = V.YEARS[1]) -> Column:
    """The distinct years of a text, as four digits with no digit beside them, sorted."""
    found = F.filter(find_all(t, "[0-9]+"), lambda y: (F.length(y) == 4) & (y >= str(lo)) & (y <= str(hi)))
    return F.array_sort(F.array_distinct(found))


def has(t: Column, word: str, mode: str = "literal") -> Column:
    """Whether a text has a word: literal, folded (in either case), or bounded (no letter or digit beside an ASCII word)."""
    if not word:
        raise ValueError("an empty keyword would match everything")
    if mode == "folded":
        return F.contains(F.lower(t), F.lit(word.lower()))
    if mode == "bounded" and re.fullmatch("[A-Za-z]+", word):
        return t.rlike(f"(?iU)\\b{word}\\b")
    return F.contains(t, F.lit(word))


def hits(t: Column, words: list[str], mode: str = "literal") -> Column:
    """The words of a list that a text has, in the list's order."""
    return F.filter(F.array(*[F.when(has(t, w, mode), F.lit(w)) for w in words]), lambda x: x.isNotNull())


def any_of(t: Column, words: list[str], mode: str = "literal") -> Column:
    out = F.lit(False)
    if mode == "bounded":  # one pattern for all words that need one
        plain = [w for w in words if re.fullmatch("[A-Za-z]+", w)]
        words = [w for w in words if w not in plain]
        if plain:
            out = t.rlike("(?iU)\\b(?:" + "|".join(plain) + ")\\b")
    for w in words:
        out = out | has(t, w, mode)
    return out


def mention_after_break(t: Column, word: str) -> Column:
    """Whether a word occurs with no Hangul right before it."""
    return t.rlike("(^|[^가-힣])" + literal(word))


def positions(t: Column, word: str) -> Column:
    """The places, from 1, at which a word occurs, without overlap, from the lengths of what stands between."""
    before = F.slice(F.split(t, literal(word), -1), 1, F.greatest(F.size(F.split(t, literal(word), -1)) - 1, F.lit(0)))
    step = lambda acc, part: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(word), F.lit(1)) + F.length(part))
    return F.aggregate(before, F.array().cast("array<int>"), step)


def around(t: Column, at: Column, before: int, after: int) -> Column:
    """The text from `before` characters ahead of a place to `after` from it on."""
    start = F.greatest(at - before, F.lit(1))
    return F.substring(t, start, at - start + after)


def short_hash(t: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(t), 1, n)


def label_head(name: Column) -> Column:
    """A label without its bracketed part."""
    return F.trim(F.split(name, "\\(")[0])


def label_words(name: Column, sep: str = "·") -> Column:
    inner = F.regexp_extract(name, "\\(([^)]*)\\)", 1)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, literal(sep)))


def round_key(name: Column) -> Column:
    """(number, rank of suffix) of a round's name; what sorts rounds."""
    n = F.regexp_extract(name, "r([0-9]+)", 1)
    suffix = F.regexp_extract(name, "r[0-9]+_(p2|2ch)", 1)
    return F.struct(F.when(n != "", n.cast("int")).alias("n"), F.when(suffix == "p2", 1).when(suffix == "2ch", 2).otherwise(0).alias("suffix"))


def auto_label(words: Column, n: int = 4, sep: str = "·", end: str = "") -> Column:
    return F.concat(F.concat_ws(sep, F.slice(words, 1, n)), F.lit(end))
