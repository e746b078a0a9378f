"""Queries over text, addresses and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..functions import tokenizers as K
from ..functions import urls as U
from ..functions import values as V
from ..operators import indices as I
from ..operators import lineage as L
from ..operators import scoring as S
from ..operators import tables as R
from ..runtime import table
from ..sources.corpus import bullets
from .base import CODE, DOMAIN, ITEMS, THEME_HITS, THEMES, any_word, lower, strings

_ENDS = "|".join(sorted(set(V.PARTICLES), key=lambda p: (-len(p), p)))
_STRIPPED = "regexp_replace(t, '(^|[^\\p{L}\\p{M}\\p{N}_.])(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}($|[^\\p{L}\\p{M}\\p{N}_.])', '\\1 \\2', 'g')"
_TOKEN = "[가-힣A-Za-z0-9\\x{00c0}-\\x{024f}\\x{1e00}-\\x{1eff}\\x{0400}-\\x{04ff}]{2,}"
_PARTS = f"list_filter(string_split({DOMAIN}, '.'), lambda x: x <> '')"
_SLUG = f"""CASE WHEN len({_PARTS}) >= 2 THEN CASE WHEN len({_PARTS}) >= 3 AND length({_PARTS}[-1]) = 2 AND list_contains({strings(V.SECOND_LEVEL)}, {_PARTS}[-2]) THEN {_PARTS}[-3] ELSE {_PARTS}[-2] END END"""
_STOP, _STOP_LOWER = strings(V.STOP_KO + V.STOP_KO_MORE), strings(V.STOP_EN + V.STOP_EN_MORE + V.STOP_LATIN + V.STOP_RU)
_WORDS = f"""w AS (SELECT bullet_id, entity, category, kind, t, u, list_filter(list_transform(regexp_extract_all({_STRIPPED}, '{_TOKEN}'), lambda w: regexp_replace(w, '^(.{{2,}}?)(?:{_ENDS})$', '\\1')),
  lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w) AND NOT list_contains({_STOP_LOWER}, {lower('w')}) AND NOT regexp_matches(w, '^\\p{{Nd}}+$') AND {lower('w')} <> coalesce({_SLUG}, '')) AS words FROM b)"""
_KANA, _HAN, _THAI = "[\\x{3040}-\\x{30ff}]", "[\\x{4e00}-\\x{9fff}]", "[\\x{0e00}-\\x{0e7f}]"


def _tokens(spark, d):
    b = bullets(spark, d)
    return b.withColumn("words", T.generic_tokens(F.col("t"), U.slug(F.col("u"))))


@query("tokens", f"WITH {ITEMS}, {_WORDS} SELECT bullet_id, array_to_string(words, ' ') AS tokens FROM w")
def tokens(spark, d):
    return _tokens(spark, d).select("bullet_id", F.array_join("words", " ").alias("tokens"))


@query("tokens_excluded", f"WITH {ITEMS}, {_WORDS} SELECT bullet_id, entity, len(words)::INT AS n_tokens FROM w WHERE len(words) < 3")
def tokens_excluded(spark, d):
    return _tokens(spark, d).where(F.size("words") < 3).select("bullet_id", "entity", F.size("words").alias("n_tokens"))


@query("tokens_old", f"WITH {ITEMS} SELECT bullet_id, len(regexp_extract_all(t, '[가-힣A-Za-z0-9]{{2,}}'))::INT AS n_old, array_to_string(list_filter(regexp_extract_all(t, '[^\\s\\p{{Z}}\\p{{P}}\\p{{S}}]{{2,}}'), lambda x: NOT regexp_matches(x, '^[\\p{{Nd}}]+$')), ' ') AS split FROM b")
def tokens_old(spark, d):
    """Two earlier tokenizers: runs of Hangul and ASCII, and runs between marks without numbers."""
    t = F.col("t")
    split = F.filter(T.find_all(t, "[^\\s\\p{Z}\\p{P}\\p{S}]{2,}"), lambda x: ~x.rlike("^[\\p{Nd}]+$"))
    return bullets(spark, d).select("bullet_id", F.size(T.find_all(t, T.OLD_TOKEN)).alias("n_old"), F.array_join(split, " ").alias("split"))


def _n_runs(pattern: str, stop: list[str]) -> str:
    return f"len(list_filter(regexp_extract_all(t, '{pattern}'), lambda x: NOT list_contains({strings(stop)}, x)))"


_N_JA, _N_ZH, _N_TH = _n_runs("[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]{2,}", V.STOP_JA), _n_runs(_HAN + "{2,}", V.STOP_ZH), f"len(regexp_extract_all(t, '{_THAI}{{2,}}'))"


@query("tokens_routed", f"WITH {ITEMS}, {_WORDS} SELECT bullet_id, len(words)::INT AS n_generic, CASE WHEN regexp_matches(t, '{_KANA}') THEN {_N_JA} ELSE 0 END::INT AS n_ja, CASE WHEN NOT regexp_matches(t, '{_KANA}') THEN {_N_ZH} ELSE 0 END::INT AS n_zh, {_N_TH}::INT AS n_th FROM w")
def tokens_routed(spark, d):
    """Words by the tokenizer that a text's scripts route it to, beside the generic one."""
    parts = K.routed(F.col("t"), U.slug(F.col("u")))
    return bullets(spark, d).select("bullet_id", *[F.size(c).alias(f"n_{k}") for k, c in parts.items()])


@query("tokens_by_era", f"WITH {ITEMS}, x AS (SELECT CASE WHEN coalesce(nullif(regexp_extract(added_round, 'r([0-9]+)', 1), '')::INT, 99) < 40 THEN 'both' ELSE 'one' END AS era, regexp_matches(t, '{_KANA}') AS kana, regexp_matches(t, '{_HAN}') AS han, {_N_JA} AS ja, {_N_ZH} AS zh FROM b) SELECT era, sum(CASE WHEN kana OR (han AND era = 'both') THEN ja ELSE 0 END)::BIGINT AS n_ja, sum(CASE WHEN han AND (NOT kana OR era = 'both') OR (kana AND era = 'both') THEN zh ELSE 0 END)::BIGINT AS n_zh FROM x GROUP BY era")
def tokens_by_era(spark, d):
    """Words of the Japanese and Chinese tokenizers: before a round both ran, since then a text goes to one of them."""
    t = F.col("t")
    old = F.coalesce(T.round_key(F.col("added_round"))["n"], F.lit(99)) < 40
    was, now = K.routed(t, exclusive=False), K.routed(t)
    n = [F.sum(F.when(old, F.size(was[k])).otherwise(F.size(now[k]))).alias(f"n_{k}") for k in ("ja", "zh")]
    return bullets(spark, d).groupBy(F.when(old, "both").otherwise("one").alias("era")).agg(*n)


@query("vectorizer_words", f"WITH {ITEMS} SELECT word, count(*) AS uses, count(DISTINCT bullet_id) AS docs FROM (SELECT bullet_id, unnest(regexp_extract_all({lower('t')}, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM b) GROUP BY word HAVING count(DISTINCT bullet_id) >= 2")
def vectorizer_words(spark, d):
    w = bullets(spark, d).select("bullet_id", F.explode(T.vectorizer_words(F.col("t"))).alias("word"))
    per = w.groupBy("word", "bullet_id").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("uses"), F.count("*").alias("docs")).where("docs >= 2")


_SCRIPT_OF = f"CASE WHEN regexp_matches(word, '{_KANA}') THEN 'kana' WHEN regexp_matches(word, '{_HAN}') THEN 'han' WHEN regexp_matches(word, '{_THAI}') THEN 'thai' WHEN regexp_matches(word, '[가-힣]') THEN 'hangul' WHEN regexp_matches(word, '[\\x{{0400}}-\\x{{04ff}}]') THEN 'cyrillic' WHEN regexp_matches(word, '[A-Za-z\\x{{00c0}}-\\x{{024f}}\\x{{1e00}}-\\x{{1eff}}]') THEN 'latin' ELSE 'other' END".replace("{{", "{").replace("}}", "}")


@query("token_scripts", f"WITH {ITEMS}, {_WORDS}, x AS (SELECT {_SCRIPT_OF} AS script, count(*) AS n, count(DISTINCT word) AS types FROM (SELECT unnest(words) AS word FROM w) GROUP BY 1) SELECT script, n, types, sum(n) OVER (ORDER BY n DESC, script)::BIGINT AS cum, round(sum(n) OVER (ORDER BY n DESC, script) / sum(n) OVER (), 6) AS cum_share FROM x")
def token_scripts(spark, d):
    # an inner explode would let the optimizer work the tokens out a second time, to leave out rows without any
    w = _tokens(spark, d).select(F.explode_outer("words").alias("word")).where("word is not null")
    n = w.groupBy("word").agg(F.count("*").alias("n")).groupBy(T.token_script(F.col("word")).alias("script")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    return L.cumulative(n, [F.desc("n"), F.asc("script")], "n").withColumn("cum_share", F.round("cum_share", 6))


_BUCKET = f"CASE WHEN regexp_matches(t, '{_KANA}') THEN 'ja' WHEN regexp_matches(t, '{_HAN}') THEN 'zh' WHEN regexp_matches(t, '{_THAI}') THEN 'th' WHEN regexp_matches(t, '[가-힣]') THEN 'ko' WHEN regexp_matches(t, '[\\x{{0400}}-\\x{{04ff}}]') THEN 'ru' WHEN regexp_matches(t, '[đơưĐƠƯ]|[\\x{{1e00}}-\\x{{1eff}}]') THEN 'vi' WHEN regexp_matches(t, '[\\x{{00c0}}-\\x{{024f}}]') THEN 'latin' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'other' END".replace("{{", "{").replace("}}", "}")


@query("script_single", f"WITH {ITEMS} SELECT entity, {_BUCKET} AS bucket, count(*) AS n FROM b GROUP BY ALL")
def script_single(spark, d):
    return bullets(spark, d).groupBy("entity", T.single_bucket(F.col("t")).alias("bucket")).agg(F.count("*").alias("n"))


_WORD = "[^\\s.,;:!?\"''“”‘’()\\[\\]{}<>·•\\-–—/\\\\|~`^*+=_@#$%&《》「」『』]+"
_OWN = f"CASE WHEN regexp_matches(w, '[가-힣]') THEN 'ko' WHEN regexp_matches(w, '[\\x{{0400}}-\\x{{04ff}}]') THEN 'ru' WHEN regexp_matches(w, '[đơưĐƠƯ]|[\\x{{1e00}}-\\x{{1eff}}]') THEN 'vi' WHEN regexp_matches(w, '{_KANA}|{_HAN}|{_THAI}') THEN NULL WHEN regexp_matches(w, '^[\\x00-\\x7f]+$') THEN CASE WHEN regexp_matches(w, '[A-Za-z]') THEN 'en' END ELSE 'latin' END".replace("{{", "{").replace("}}", "}")


@query(
    "script_multi",
    f"""WITH {ITEMS} SELECT bullet_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([CASE WHEN regexp_matches(t, '{_KANA}') THEN 'ja' WHEN regexp_matches(t, '{_HAN}{{2,}}') THEN 'zh' END, CASE WHEN regexp_matches(t, '{_THAI}') THEN 'th' END],
  list_transform(list_filter(regexp_extract_all(t, '{_WORD}'), lambda w: NOT regexp_matches(w, '^[\\p{{Nd}},.%]+$')), lambda w: {_OWN})), lambda x: x IS NOT NULL))), ' ') AS buckets FROM b""",
)
def script_multi(spark, d):
    return bullets(spark, d).select("bullet_id", F.array_join(T.buckets(F.col("t")), " ").alias("buckets"))


@query("token_context", f"WITH {ITEMS}, {_WORDS} SELECT CASE WHEN list_bool_or(list_transform(words, lambda x: regexp_matches(x, '[đơưĐƠƯ]|[\\x{{1e00}}-\\x{{1eff}}]'))) THEN 'vi' ELSE 'latin' END AS bucket, sum(len(list_filter(words, lambda x: regexp_matches(x, '[\\x{{00c0}}-\\x{{024f}}\\x{{1e00}}-\\x{{1eff}}]'))))::BIGINT AS n FROM w GROUP BY 1".replace("list_bool_or(list_transform(words, lambda x: ", "len(list_filter(words, lambda x: ").replace("'[đơưĐƠƯ]|[\\x{1e00}-\\x{1eff}]'))) THEN", "'[đơưĐƠƯ]|[\\x{1e00}-\\x{1eff}]'))) > 0 THEN"))
def token_context(spark, d):
    """Accented tokens, which are Vietnamese wherever their document has a Vietnamese letter."""
    vi = F.exists("words", lambda x: x.rlike(T.VIETNAMESE))
    n = F.size(F.filter("words", lambda x: x.rlike("[\\u00c0-\\u024f\\u1e00-\\u1eff]")))
    return _tokens(spark, d).groupBy(F.when(vi, "vi").otherwise("latin").alias("bucket")).agg(F.sum(n).alias("n"))


@query("numbers_and_years", f"WITH {ITEMS} SELECT bullet_id, len(regexp_extract_all(t, '\\p{{Nd}}+[.,]?\\p{{Nd}}*[\\s\\p{{Z}}]*(?:{'|'.join(V.UNITS)})'))::INT AS n_num, len(regexp_extract_all(t, '[0-9]'))::INT AS n_digits, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '[0-9]+'), lambda y: length(y) = 4 AND y BETWEEN '2015' AND '2026'))), ' ') AS years FROM b")
def numbers_and_years(spark, d):
    t = F.col("t")
    return bullets(spark, d).select("bullet_id", T.number_count(t).alias("n_num"), T.digit_count(t).alias("n_digits"), F.array_join(T.years(t), " ").alias("years"))


_KEYS = ["fandom", "records", "팬클럽", "para"]
_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"


@query(
    "keyword_modes",
    f"WITH {ITEMS} "
    + " UNION ALL ".join(
        f"SELECT '{w}' AS word, '{m}' AS mode, count(*) FILTER ({c}) AS n FROM b"
        for w in _KEYS
        for m, c in (("literal", f"contains(t, '{w}')"), ("folded", f"contains({lower('t')}, '{w}')"), ("bounded", f"regexp_matches(t, '(?i)(^|{_EDGE}){w}($|{_EDGE})')" if w.isascii() else f"contains(t, '{w}')"), ("after_break", f"regexp_matches(t, '(^|[^가-힣]){w}')"))
    ),
)
def keyword_modes(spark, d):
    t = F.col("t")
    conds = [(w, m, T.mention_after_break(t, w) if m == "after_break" else T.has(t, w, m)) for w in _KEYS for m in ("literal", "folded", "bounded", "after_break")]
    one = bullets(spark, d).agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(conds)])
    rows = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(m).alias("mode"), F.col(f"c{i}").alias("n")) for i, (w, m, _) in enumerate(conds)])
    return one.select(F.inline(rows))


@query("keyword_positions", f"WITH {ITEMS}, p AS (SELECT bullet_id, t, unnest(list_filter(range(1, length(t)::BIGINT), lambda i: substr(t, i, 2) = '나무')) AS pos FROM b WHERE contains(t, '나무')) SELECT bullet_id, pos::INT AS pos, substr(t, greatest(pos - 6, 1), pos - greatest(pos - 6, 1) + 8) AS around FROM p")
def keyword_positions(spark, d):
    b = bullets(spark, d).where(F.contains("t", F.lit("나무"))).select("bullet_id", "t", F.explode(T.positions(F.col("t"), "나무")).alias("pos"))
    return b.select("bullet_id", "pos", T.around(F.col("t"), F.col("pos"), 6, 8).alias("around"))


@query("text_hashes", f"WITH {ITEMS} SELECT bullet_id, substr(sha1(t), 1, 12) AS hash FROM b")
def text_hashes(spark, d):
    return bullets(spark, d).select("bullet_id", T.short_hash(F.col("t")).alias("hash"))


@query("round_keys", f"WITH {ITEMS} SELECT added_round, nullif(regexp_extract(added_round, 'r([0-9]+)', 1), '')::INT AS n, CASE regexp_extract(added_round, 'r[0-9]+_(p2|2ch)', 1) WHEN 'p2' THEN 1 WHEN '2ch' THEN 2 ELSE 0 END AS suffix, count(*) AS items FROM b WHERE added_round IS NOT NULL GROUP BY ALL")
def round_keys(spark, d):
    return bullets(spark, d).where("added_round is not null").groupBy("added_round").agg(F.count("*").alias("items")).withColumn("k", T.round_key(F.col("added_round"))).select("added_round", F.col("k.n").alias("n"), F.col("k.suffix").alias("suffix"), "items")


@query("cloud_labels", "SELECT cloud_id, concat(array_to_string(list_slice(list_filter(list_transform(top_30, lambda x: trim(x.word)), lambda w: w IS NOT NULL AND w <> ''), 1, 4), '·'), '형') AS label FROM wordcloud_by_language_v7 WHERE top_30 IS NOT NULL")
def cloud_labels(spark, d):
    words = F.filter(F.transform("top_30", lambda x: F.trim(x["word"])), lambda w: w.isNotNull() & (w != ""))
    return table(spark, d, "wordcloud_by_language_v7").where("top_30 is not null").select("cloud_id", T.auto_label(words, end="형").alias("label"))


@query("address_parts", f"WITH {ITEMS} SELECT bullet_id, {DOMAIN} AS domain, regexp_replace(lower(regexp_extract(u, 'https?://([^/\\s]+)', 1)), '^www\\.', '') AS host, regexp_extract(u, 'https?://[^\\s;]+', 0) AS first, {_SLUG} AS slug, regexp_replace(u, '\\)agentId:.*$', '') <> u AS leaked FROM b")
def address_parts(spark, d):
    u = F.col("u")
    return bullets(spark, d).select("bullet_id", U.domain(u).alias("domain"), U.http_host(u).alias("host"), U.first_address(u).alias("first"), U.slug(u).alias("slug"), (U.cut_leak(u) != u).alias("leaked"))


def _in(hosts):
    return "(" + " OR ".join(f"d = '{h}' OR ends_with(d, '.{h}')" for h in hosts) + ")"


@query(
    "source_kinds",
    f"""WITH {ITEMS}, x AS (SELECT *, regexp_replace({DOMAIN}, '(-daily|news|board|wiki)?\\.[a-z]+\\.example$', '.com') AS d FROM b) SELECT entity, CASE WHEN {_in(V.HOSTS['community'])} THEN 'community_social' WHEN {_in(V.HOSTS['wiki'])} THEN 'reference_wiki' ELSE 'news_media' END AS source,
  CASE {' '.join(f"WHEN {_in(V.HOSTS[x])} THEN '{x}'" for x in ('ja', 'zh', 'es', 'fr'))} WHEN {_in(V.HOSTS['en'])} OR list_contains({strings(V.EN_SOCIAL)}, d) THEN 'en' WHEN regexp_matches(t, '{_KANA}') THEN 'ja' ELSE 'ko' END AS language, count(*) AS n FROM x GROUP BY ALL""",
)
def source_kinds(spark, d):
    host = F.regexp_replace(U.domain(F.col("u")), "(-daily|news|board|wiki)?\\.[a-z]+\\.example$", ".com")
    return bullets(spark, d).withColumn("_d", host).groupBy("entity", U.source_type(F.col("_d")).alias("source"), U.source_language(F.col("_d"), F.col("t")).alias("language")).agg(F.count("*").alias("n"))


_TLD = "CASE " + " ".join(f"WHEN ends_with(d, '{e}') THEN '{x}'" for e, x in V.TLDS) + " END"
_HOST = f"regexp_replace({DOMAIN}, '\\.example$', '')"
_OVERRIDES = {"covenu.kr": "en", "int": "en", "kiniki.mx": "pt"}
_KNOWN = "coalesce(" + ", ".join(f"CASE WHEN d = '{h}' OR ends_with(d, '.{h}') THEN '{x}' END" for h, x in _OVERRIDES.items() if "." in h) + ")"


@query("domain_languages", f"WITH {ITEMS}, x AS (SELECT bullet_id, {_HOST} AS d FROM b), y AS (SELECT d, {_KNOWN} AS k, {_TLD} AS tld FROM x) SELECT coalesce(k, tld, 'en') AS lang, CASE WHEN k IS NOT NULL THEN 'override' WHEN tld IS NOT NULL THEN 'tld' ELSE 'default' END AS basis, count(*) AS n FROM y GROUP BY ALL")
def domain_languages(spark, d):
    host = F.regexp_replace(U.domain(F.col("u")), "\\.example$", "")
    x = U.domain_language(host, {k: v for k, v in _OVERRIDES.items() if "." in k})
    return bullets(spark, d).select(x.alias("x")).groupBy("x.lang", "x.basis").agg(F.count("*").alias("n"))


_LETTERS = {"ko": "[가-힣]", "kana": _KANA, "han": _HAN, "th": _THAI, "ru": "[\\x{0400}-\\x{04ff}]", "ar": "[\\x{0600}-\\x{06ff}]", "latin": "[A-Za-z\\x{00c0}-\\x{024f}\\x{1e00}-\\x{1eff}]"}
_COUNTED = f"c AS (SELECT *, {', '.join(f'''len(regexp_extract_all(t, '{p}')) AS n_{k}''' for k, p in _LETTERS.items())} FROM b), c2 AS (SELECT *, CASE WHEN n_kana > 0 THEN n_kana + n_han ELSE 0 END AS n_ja, CASE WHEN n_kana > 0 THEN 0 ELSE n_han END AS n_zh FROM c), c3 AS (SELECT *, greatest(n_ko, n_ja, n_zh, n_th, n_ru, n_ar, n_latin) AS top FROM c2)"
_BODY = f"CASE WHEN top = 0 OR n_ko = top THEN 'ko' WHEN n_ja = top THEN 'ja' WHEN n_zh = top THEN 'zh' WHEN n_th = top THEN 'th' WHEN n_ru = top THEN 'ru' WHEN n_ar = top THEN 'ar' WHEN len(regexp_extract_all(t, '{U.VI_LETTERS}')) >= 2 THEN 'vi' WHEN len(regexp_extract_all(t, '{U.TR_LETTERS}')) >= 2 THEN 'tr' ELSE 'latin' END"


@query("body_languages", f"WITH {ITEMS}, {_COUNTED} SELECT bullet_id, {_BODY} AS body FROM c3")
def body_languages(spark, d):
    return bullets(spark, d).select("bullet_id", U.body_language(F.col("t")).alias("body"))


@query("domain_body_agreement", f"WITH {ITEMS}, {_COUNTED}, x AS (SELECT {_BODY} AS body, {_HOST} AS d FROM c3), y AS (SELECT body, coalesce({_TLD}, 'en') AS domain FROM x) SELECT domain, count(*) AS n, round(avg((domain = body)::INT), 6) AS agree_share FROM y GROUP BY domain")
def domain_body_agreement(spark, d):
    host = F.regexp_replace(U.domain(F.col("u")), "\\.example$", "")
    b = bullets(spark, d).select(U.domain_language(host)["lang"].alias("domain"), U.body_language(F.col("t")).alias("body"))
    return R.agreement(b, "domain", "body").withColumn("agree_share", F.round("agree_share", 6))


@query("top_domains", f"WITH {ITEMS}, n AS (SELECT kind, {DOMAIN} AS domain, count(*) AS n FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, domain) AS rank FROM n) SELECT kind, domain, n, rank::INT AS rank FROM r WHERE rank <= 20 UNION ALL SELECT kind, NULL, sum(n)::BIGINT, 21 FROM r WHERE rank > 20 GROUP BY kind")
def top_domains(spark, d):
    return R.rest_beyond(bullets(spark, d).withColumn("domain", U.domain(F.col("u"))), "kind", "domain", 20)


# --- dictionaries ---

_TAGS = list(THEMES)


@query(
    "tag_index",
    f"WITH {ITEMS}, {THEME_HITS}, t AS (SELECT entity, count(*) AS n_total FROM b GROUP BY entity), h AS (SELECT entity, count(DISTINCT bullet_id) AS n_hit, {', '.join(f'''count(*) FILTER (tag = '{x}') AS {x}''' for x in _TAGS)} FROM hits GROUP BY entity), "
    f"m AS (SELECT entity, tag, ord, count(*) AS n FROM hits GROUP BY ALL), top AS (SELECT entity, tag FROM m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, ord) = 1) "
    f"SELECT entity, n_total, coalesce(n_hit, 0) AS n_hit, {', '.join(f'coalesce({x}, 0) AS {x}' for x in _TAGS)}, tag AS top_tag, round(coalesce(n_hit, 0) / n_total, 6) AS share FROM t LEFT JOIN h USING (entity) LEFT JOIN top USING (entity)",
)
def tag_index(spark, d):
    return I.tag_counts(bullets(spark, d), THEMES).withColumn("share", F.round("share", 6))


_SIGNALS, _NEG = ["관광객", "tourists", "수익금"], ["측은", "7일"]
_GUARD = f"({any_word('t', _SIGNALS[:2])} OR (contains(t, '수익금') AND NOT {any_word('t', _NEG)}))"


@query("guarded_signal", f"WITH {ITEMS} SELECT entity, count(*) FILTER ({_GUARD}) AS n_signal, count(*) AS n FROM b GROUP BY entity")
def guarded_signal(spark, d):
    s = I.guarded_signal(F.col("t"), _SIGNALS, "수익금", _NEG)
    return bullets(spark, d).groupBy("entity").agg(F.count_if(s).alias("n_signal"), F.count("*").alias("n"))


_GATE = ["chart", "차트", "relay"]


@query("two_stage_gated", f"WITH {ITEMS}, {THEME_HITS} SELECT entity, tag, count(*) AS n FROM hits WHERE {_GUARD} AND (tag <> 'music' OR {any_word('t', _GATE)}) GROUP BY ALL")
def two_stage_gated(spark, d):
    hit = I.two_stage(bullets(spark, d), I.guarded_signal(F.col("t"), _SIGNALS, "수익금", _NEG), THEMES, {"music": _GATE})
    return hit.groupBy("entity", "tag").agg(F.count("*").alias("n"))


@query("tag_flags", f"WITH {ITEMS} SELECT bullet_id, {', '.join(f'{any_word(chr(116), ws)} AS {k}' for k, ws in THEMES.items())}, {any_word('t', [w for ws in THEMES.values() for w in ws])} AS any_tag FROM b")
def tag_flags(spark, d):
    flags = [T.any_of(F.col("t"), ws).alias(k) for k, ws in THEMES.items()]
    return bullets(spark, d).select("bullet_id", *flags).withColumn("any_tag", F.greatest(*THEMES))


@query("tag_diversity", f"WITH {ITEMS}, {THEME_HITS}, m AS (SELECT entity, tag, ord, count(*) AS n FROM hits GROUP BY ALL) SELECT entity, sum(n)::BIGINT AS mentions, count(*) AS n_tags_hit, round(count(*) / 5.0, 6) AS diversity, first(tag ORDER BY n DESC, ord) AS primary, round(max(n) / sum(n), 6) AS primary_share FROM m GROUP BY entity".replace(" AS primary,", ' AS "primary",'))
def tag_diversity(spark, d):
    hits = S.tag_hits(bullets(spark, d), THEMES)
    return I.diversity(hits, "tag", len(THEMES), _TAGS).withColumn("diversity", F.round("diversity", 6)).withColumn("primary_share", F.round("primary_share", 6))


_REGION_HITS = " UNION ALL ".join(f"SELECT entity, '{r}' AS region FROM b WHERE {any_word('t', ws)}" for r, ws in V.REGIONS.items())


@query("region_mentions", f"WITH {ITEMS} SELECT entity, region, count(*) AS n FROM ({_REGION_HITS}) GROUP BY ALL")
def region_mentions(spark, d):
    return I.region_hits(bullets(spark, d)).groupBy("entity", "region").agg(F.count("*").alias("n"))


@query(
    "match_classes",
    f"WITH {ITEMS}, p AS (SELECT t, unnest(list_filter(range(1, length(t)::BIGINT), lambda i: substr(t, i, 2) = '나무')) AS pos FROM b WHERE contains(t, '나무')), c AS (SELECT t, CASE WHEN regexp_matches(t, '나무\\s*(집|배)') THEN 'common' WHEN regexp_matches(substr(t, greatest(pos - 6, 1), pos - greatest(pos - 6, 1) + 8), '숲|[0-9]') THEN 'place' ELSE 'uncertain' END AS class, CASE WHEN regexp_matches(t, '고향|출신') THEN 'hometown' WHEN regexp_matches(t, '공연|팬 모임|투어') THEN 'activity' ELSE 'other' END AS type FROM p) SELECT class, type, count(*) AS n FROM c GROUP BY ALL",
)
def match_classes(spark, d):
    t = F.col("t")
    p = bullets(spark, d).where(F.contains("t", F.lit("나무"))).select("t", F.explode(T.positions(t, "나무")).alias("at"))
    return p.groupBy(I.match_class(t, F.col("at"), "나무", "나무\\s*(집|배)", "숲|[0-9]").alias("class"), I.mention_type(t, "고향|출신", "공연|팬 모임|투어").alias("type")).agg(F.count("*").alias("n"))


# Names of places in the tables' texts, standing in for regions: words that also mean something else, and one name that stands for two.
_PLACES = {"grove": ["나무", "숲"], "station": ["역과"], "alley": ["골목"], "shop": ["제과점"]}
_CONTEXT, _COMMON = "숲|[0-9]", {"나무": "나무\\s*(집|배)", "골목": "골목길"}
_RULES = {"station": [("alley", "골목|광장", "[0-9]{3}")]}


def _place_sql() -> str:
    """Hits of every keyword as lists of places without overlap, classed and reassigned as region_mentions() does."""
    at = lambda w: f"list_transform(range(1, len(string_split(t, '{w}'))), lambda i: (list_sum(list_transform(string_split(t, '{w}')[1:i], lambda x: length(x))) + (i - 1) * {len(w)} + 1)::BIGINT)"
    parts = []
    for k, (r, ws) in enumerate(_PLACES.items()):
        hits = " || ".join(f"list_transform({at(w)}, lambda p: {{'at': p, 'class': " + (f"CASE WHEN regexp_matches(t, '{_COMMON[w]}') THEN 'common' WHEN " if w in _COMMON else "CASE WHEN ") + f"regexp_matches(substr(t, greatest(p - 6, 1), p - greatest(p - 6, 1) + {len(w) + 6}), '{_CONTEXT}') THEN 'place' ELSE 'uncertain' END}})" for w in ws)
        near = "substr(t, greatest(h[1].at - 6, 1), h[1].at - greatest(h[1].at - 6, 1) + 8)"
        to = "".join(f"WHEN regexp_matches({near}, '{p}')" + (f" AND NOT regexp_matches({near}, '{u}')" if u else "") + f" THEN '{o}' " for o, p, u in _RULES.get(r, []))
        parts.append(f"SELECT bullet_id, entity, '{r}' AS region, class, CASE WHEN class <> 'common' THEN {f'CASE {to} ELSE {chr(39)}{r}{chr(39)} END' if to else chr(39) + r + chr(39)} END AS strict_region FROM (SELECT *, CASE WHEN len(list_filter(h, lambda x: x.class = 'place')) > 0 THEN 'place' WHEN len(list_filter(h, lambda x: x.class = 'uncertain')) > 0 THEN 'uncertain' ELSE 'common' END AS class FROM (SELECT bullet_id, entity, t, {hits} AS h FROM b WHERE {any_word('t', ws)}))")
    return "pm AS (" + " UNION ALL ".join(parts) + ")"


@query("place_mentions", f"WITH {ITEMS}, {_place_sql()} SELECT * FROM pm")
def place_mentions(spark, d):
    """Mentions of places with their class, and the place that a name shared by several stands for."""
    return I.region_mentions(bullets(spark, d), _PLACES, _CONTEXT, _COMMON, _RULES)


@query("strict_index", f"WITH {ITEMS}, {_place_sql()}, m AS (SELECT entity, strict_region AS r, count(*) AS n FROM pm WHERE strict_region IS NOT NULL GROUP BY ALL) SELECT entity, sum(n)::BIGINT AS strict_total, count(*) AS strict_regions_hit, round(count(*) / 4.0, 6) AS strict_diversity, first(r ORDER BY n DESC, list_position({strings(_PLACES)}, r)) AS strict_primary FROM m GROUP BY entity")
def strict_index(spark, d):
    """The index of places without common words, after reassignment."""
    m = I.region_mentions(bullets(spark, d), _PLACES, _CONTEXT, _COMMON, _RULES)
    return I.strict_index(m, list(_PLACES)).withColumn("strict_diversity", F.round("strict_diversity", 6))


_ALIASES = "al AS (SELECT DISTINCT entity, trim(x) AS alias FROM (SELECT entity, unnest(string_split(replace(entity, ')', ''), '(')) AS x FROM roster_history) WHERE trim(x) <> '')"


def _aliases(spark, d):
    names = table(spark, d, "roster_history").select("entity", F.explode(F.split(F.regexp_replace("entity", "\\)", ""), "\\(")).alias("alias"))
    return names.select("entity", F.trim("alias").alias("alias")).where("alias <> ''").distinct()


@query("member_mentions", f"WITH {ITEMS}, {_ALIASES} SELECT entity, alias AS member, count(*) AS n FROM b JOIN al USING (entity) WHERE contains(t, alias) GROUP BY ALL")
def member_mentions(spark, d):
    return I.member_mentions(bullets(spark, d), _aliases(spark, d).withColumn("member", F.col("alias")))


@query("alias_audit", f"WITH {ITEMS}, {_ALIASES}, j AS (SELECT entity, alias, regexp_matches(t, concat('(^|[^가-힣])', regexp_escape(alias))) AS broken FROM b JOIN al USING (entity) WHERE contains(t, alias)), n AS (SELECT entity, alias, count(*) AS n_contained, count(*) FILTER (broken) AS n_after_break FROM j GROUP BY ALL) SELECT *, length(alias) <= 1 AS short, n_contained <> n_after_break AS differs FROM n")
def alias_audit(spark, d):
    return I.alias_audit(bullets(spark, d), _aliases(spark, d))


@query("concentration", f"WITH {ITEMS}, {THEME_HITS}, m AS (SELECT entity, tag, count(*) AS n FROM hits GROUP BY ALL), s AS (SELECT entity, n, n / sum(n) OVER (PARTITION BY entity) AS sh FROM m), c AS (SELECT entity, count(*) AS n_parts, sum(n)::BIGINT AS total, sum(sh * sh) AS mci FROM s GROUP BY entity) SELECT entity, n_parts, total, round(mci, 6) AS mci, round(1.0 / n_parts, 6) AS floor, round(mci - 1.0 / n_parts, 6) AS excess, round((mci - 1.0 / n_parts) / nullif(1 - 1.0 / n_parts, 0), 6) AS normalized, CASE WHEN mci < 0.3 THEN 'low' WHEN mci < 0.45 THEN 'middle' ELSE 'high' END AS band FROM c")
def concentration(spark, d):
    m = S.tag_hits(bullets(spark, d), THEMES).groupBy("entity", "tag").agg(F.count("*").alias("n"))
    c = I.concentration(m, "entity", "n").withColumn("band", I.concentration_band(F.col("mci")))
    return c.select("entity", "n_parts", "total", *[F.round(x, 6).alias(x) for x in ("mci", "floor", "excess", "normalized")], "band")


@query("foreign_share", f"WITH {ITEMS}, q AS (SELECT entity, {CODE} AS code FROM b), l AS (SELECT entity, code AS lang, count(*) AS n FROM q WHERE code IS NOT NULL GROUP BY entity, code) SELECT entity, sum(n)::BIGINT AS total, count(*) AS n_langs, coalesce(sum(n) FILTER (lang <> 'ko'), 0)::BIGINT AS foreign_n, count(*) FILTER (lang <> 'ko') AS n_foreign, first(lang ORDER BY n DESC, lang) FILTER (lang <> 'ko') AS primary_foreign, round(coalesce(sum(n) FILTER (lang <> 'ko'), 0) / sum(n), 6) AS foreign_ratio, round(count(*) FILTER (lang <> 'ko') / 13.0, 6) AS foreign_diversity FROM l GROUP BY entity")
def foreign_share(spark, d):
    code = F.when(F.lower("lang").rlike("^[a-z]{2}(-[a-z]+)?$"), F.lower(F.substring("lang", 1, 2)))
    n = bullets(spark, d).withColumn("lang", code).where("lang is not null").groupBy("entity", "lang").agg(F.count("*").alias("n"))
    return I.foreign(n).withColumnRenamed("foreign", "foreign_n").withColumn("foreign_ratio", F.round("foreign_ratio", 6)).withColumn("foreign_diversity", F.round("foreign_diversity", 6))


_CLOUD_WORDS = f"list_filter(list_transform(coalesce(top_30, []), lambda x: trim({lower('x.word')})), lambda w: w IS NOT NULL AND w <> '')"
_OVER = [f"len(list_intersect(ws, {strings(ws)}))" for _, ws in V.LABELS]


@query("label_buckets", f"WITH c AS (SELECT cloud_id, list_distinct({_CLOUD_WORDS}) AS ws FROM wordcloud_by_language_v7), g AS (SELECT *, greatest({', '.join(_OVER)}) AS top FROM c) SELECT cloud_id AS key, CASE WHEN top = 0 THEN '{V.NO_LABEL}' {' '.join(f'''WHEN {o} = top THEN '{n}' ''' for o, (n, _) in zip(_OVER, V.LABELS))} END AS label FROM g")
def label_buckets(spark, d):
    words = F.filter(F.transform(F.coalesce("top_30", F.array().cast("array<struct<word:string,n:bigint>>")), lambda x: F.trim(F.lower(x["word"]))), lambda w: w.isNotNull() & (w != ""))
    return I.label_of(table(spark, d, "wordcloud_by_language_v7").select(F.col("cloud_id").alias("key"), words.alias("words")), V.LABELS, V.NO_LABEL)


@query("dictionary_drift", "WITH a AS (SELECT DISTINCT entity, category FROM roster_history), b AS (SELECT DISTINCT entity, category FROM fandoms_v3_100) SELECT *, 'a' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def dictionary_drift(spark, d):
    cols = ["entity", "category"]
    return I.drift(table(spark, d, "roster_history").select(cols).distinct(), table(spark, d, "fandoms_v3_100").select(cols).distinct())
