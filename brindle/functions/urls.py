"""Address and language-of-source functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import HAN, HANGUL, KANA, THAI, find_all


def domain(u: Column) -> Column:
    """The host of an address in lower case without www., with port and user as given; empty where there is none."""
    host = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(host), "^www\\.", "")


def http_host(u: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(u, "https?://([^/\\s]+)", 1)), "^www\\.", "")


def first_address(u: Column) -> Column:
    return F.regexp_extract(u, "https?://[^\\s;]+", 0)


def cut_leak(u: Column) -> Column:
    """An address without a leaked agent mark."""
    return F.regexp_replace(u, "\\)agentId:.*$", "")


def in_hosts(d: Column, hosts: list[str]) -> Column:
    """Whether a host is one of the list or below one: its last labels, as many as a host of the list has, are that host."""
    by_labels: dict[int, list[str]] = {}
    for h in hosts:
        by_labels.setdefault(h.count(".") + 1, []).append(h)
    out = F.lit(False)
    for n, own in by_labels.items():
        out = out | F.substring_index(d, ".", -n).isin(*own)
    return out


def source_type(d: Column) -> Column:
    return F.when(in_hosts(d, V.HOSTS["community"]), "community_social").when(in_hosts(d, V.HOSTS["wiki"]), "reference_wiki").otherwise("news_media")


def source_language(d: Column, t: Column) -> Column:
    """One of six languages, by lists of hosts, then kana in the text, else ko."""
    out = F
    for lang in ("ja", "zh", "es", "fr"):
        out = out.when(in_hosts(d, V.HOSTS[lang]), lang)
    return out.when(in_hosts(d, V.HOSTS["en"]) | d.isin(*V.EN_SOCIAL), "en").when(t.rlike(KANA), "ja").otherwise("ko")


def host_suffixes(d: Column) -> Column:
    """A host and what remains as its labels are taken off from the left, down to two labels."""
    parts = F.split(d, "\\.")
    n = F.size(parts)
    return F.when(n < 2, F.array(d)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def domain_language(d: Column, overrides: dict[str, str] | None = None) -> Column:
    """struct(lang, basis) of a host: a wiki's prefix, else an override of the host or what it is below, else the first matching ending, else en."""
    wiki = F.regexp_extract(d, "^([a-z]{2})\\.(?:wikipedia\\.org|namu\\.wiki)$", 1)
    bare = F.regexp_replace(d, "^www\\.", "")
    known = overrides or {}
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else None
    named = F.lit(None).cast("string") if lookup is None else F.get(F.filter(F.transform(F.concat(F.array(d), host_suffixes(bare)), lambda s: F.try_element_at(lookup, s)), lambda x: x.isNotNull()), F.lit(0))
    tld = F
    for end, lang in V.TLDS:
        tld = tld.when(d.endswith(F.lit(end)), lang)
    tld = tld.otherwise(None)
    lang = F.when(wiki != "", F.when(wiki.isin(*V.LANGS), wiki).otherwise("en")).otherwise(F.coalesce(named, tld, F.lit("en")))
    basis = F.when(wiki != "", "wiki").when(named.isNotNull(), "override").when(tld.isNotNull(), "tld").otherwise("default")
    return F.struct(lang.alias("lang"), basis.alias("basis"))


def text_fallback(t: Column) -> Column:
    """The language that a text's script suggests, for sources that nothing is known about."""
    return F.when(t.rlike(HANGUL), "ko").when(t.rlike(KANA), "ja").when(t.rlike(HAN), "zh").when(t.rlike(THAI), "th").otherwise("en")


def slug(u: Column) -> Column:
    """The label under which a source is registered: a.co.kr gives a; null without a host of two labels."""
    parts = F.filter(F.split(domain(u), "\\."), lambda x: x != "")
    n = F.size(parts)
    third = (n >= 3) & (F.length(F.get(parts, n - 1)) == 2) & F.get(parts, n - 2).isin(*V.SECOND_LEVEL)
    return F.when(n >= 2, F.lower(F.when(third, F.get(parts, n - 3)).otherwise(F.get(parts, n - 2))))


SCRIPT_LETTERS = {"ko": "[가-힣]", "kana": "[\\u3040-\\u30ff]", "han": "[\\u4e00-\\u9fff]", "th": "[\\u0e00-\\u0e7f]", "ru": "[\\u0400-\\u04ff]", "ar": "[\\u0600-\\u06ff]", "latin": "[A-Za-z\\u00c0-\\u024f\\u1e00-\\u1eff]"}
VI_LETTERS = "[ăâđêôơưĂÂĐÊÔƠƯàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]"
TR_LETTERS = "[ğşıİĞŞ]"


def body_script(t: Column) -> Column:
    """The script that most letters of a text are of; kana take the Han characters with them. ko without any letter."""
    n = {k: F.regexp_count(t, F.lit(p)) for k, p in SCRIPT_LETTERS.items()}
    n["ja"] = F.when(n["kana"] > 0, n["kana"] + n["han"]).otherwise(0)
    n["zh"] = F.when(n["kana"] > 0, 0).otherwise(n["han"])
    order = ("ko", "ja", "zh", "th", "ru", "ar", "latin")
    top = F.greatest(*[n[k] for k in order])
    out = F.when(top == 0, "ko")
    for k in order:
        out = out.when(n[k] == top, k)
    return out


def body_language(t: Column) -> Column:
    """body_script(), with Latin text told apart as vi or tr by two letters of their own, else left as latin for a frequency model."""
    s = body_script(t)
    return F.when(s != "latin", s).when(F.regexp_count(t, F.lit(VI_LETTERS)) >= 2, "vi").when(F.regexp_count(t, F.lit(TR_LETTERS)) >= 2, "tr").otherwise("latin")


def addresses(u: Column) -> Column:
    return find_all(u, "https?://[^\\s;]+")
