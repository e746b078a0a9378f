"""What the queries share: the dictionary they use on the tables at hand, and pieces of SQL."""

from __future__ import annotations

from ..functions import values as V

#: Words of the tables' texts by theme, standing in for an application's own dictionary.
THEMES = {
    "pledge": ["서명", "pledges", "firmas", "署名"], "tree": ["나무", "trees", "árboles", "苗木"], "travel": ["관광객", "tourists", "turistas", "観光客"],
    "music": ["음원", "streams", "reproducciones", "Records", "레코드"], "food": ["제과점", "bakery", "pastelería", "洋菓子"],
}
FACTORS = {"pledge": "F1", "tree": "F2", "travel": "F3", "music": "F4", "food": "F5"}

ITEMS = "b AS (SELECT bullet_id, entity, category, kind, idx, coalesce(t, '') AS t, coalesce(u, '') AS u, lang, added_round FROM fandoms_v3_100)"


def strings(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def lower(x: str) -> str:
    return f"lower(replace({x}, 'İ', 'i̇'))"


def any_word(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


DOMAIN = "regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
THEME_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT *, '{tag}' AS tag, {i} AS ord FROM b WHERE {any_word('t', ws)}" for i, (tag, ws) in enumerate(THEMES.items())) + ")"
NUMBER = "\\p{Nd}+[.,]?\\p{Nd}*[\\s\\p{Z}]*(?:" + "|".join(V.UNITS) + ")"
N_NUM = f"len(regexp_extract_all(t, '{NUMBER}'))"
N_KW = "CASE kind " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"contains(t, '{w}')::INT" for w in ws) for k, ws in V.BONUS.items()) + " ELSE 0 END"
SCORED = f"s AS (SELECT *, {N_NUM} AS n_num, {N_KW} AS n_kw, 10 + 5 * {N_NUM} + 3 * ({N_KW}) AS score10 FROM b)"
RAW = """e AS (SELECT entity, coalesce(sum(score10) FILTER (kind = 'loyalty'), 0) / 10.0::DOUBLE AS loyalty_raw, coalesce(sum(score10) FILTER (kind = 'spillover'), 0) / 10.0::DOUBLE AS spillover_raw,
  count(*) FILTER (kind = 'loyalty') AS n_loyalty, count(*) FILTER (kind = 'spillover') AS n_spillover, count(*) AS activity FROM s GROUP BY entity)"""
NORMED = """n AS (SELECT *, (loyalty_raw - min(loyalty_raw) OVER ()) / nullif(max(loyalty_raw) OVER () - min(loyalty_raw) OVER (), 0) AS loyalty_score,
  (spillover_raw - min(spillover_raw) OVER ()) / nullif(max(spillover_raw) OVER () - min(spillover_raw) OVER (), 0) AS spillover_score FROM e)"""
SCORES = f"WITH {ITEMS}, {SCORED}, {RAW}, {NORMED}"
SHARES = f"{THEME_HITS}, f AS (SELECT entity, CASE tag " + " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in FACTORS.items()) + " END AS factor, count(*) AS w FROM hits GROUP BY ALL), sh AS (SELECT entity, factor, w / sum(w) OVER (PARTITION BY entity) AS share FROM f)"
CODE = "CASE WHEN regexp_matches(lower(lang), '^[a-z]{2}(-[a-z]+)?$') THEN lower(substr(lang, 1, 2)) END"
