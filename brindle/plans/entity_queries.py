"""Queries over entities: scores, statistics, joins, rounds, topics, samples, checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import text as T
from ..functions import values as V
from ..operators import checks as C
from ..operators import indices as I
from ..operators import lineage as L
from ..operators import resample as RS
from ..operators import scoring as S
from ..operators import stats as ST
from ..operators import tables as R
from ..operators import topics as TP
from ..runtime import keep, table
from ..sources.corpus import bullets
from ..streaming import rounds
from .base import DOMAIN, FACTORS, ITEMS, SCORED, SCORES, SHARES, THEME_HITS, THEMES, any_word, lower, strings


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def scores(spark, d) -> DataFrame:
    """The scores of entities, a row each, kept, so that whatever uses them several times reads the items once."""
    return S.normalized(keep(S.entity_scores(bullets(spark, d)), "scores"))


# --- items and scores ---


@query("item_list", f"WITH {ITEMS} SELECT bullet_id, entity, category, kind, CASE kind WHEN 'loyalty' THEN 0 ELSE 1 END AS kind_ord, idx, t, u FROM b")
def item_list(spark, d):
    """Items in the order of their corpus: by entity, kind and place."""
    b = bullets(spark, d)
    return b.select("bullet_id", "entity", "category", "kind", F.when(F.col("kind") == "loyalty", 0).otherwise(1).alias("kind_ord"), "idx", "t", "u")


@query("item_scores", f"WITH {ITEMS}, {SCORED} SELECT bullet_id, n_num::INT AS n_num, n_kw::INT AS n_kw, score10::INT AS score10 FROM s")
def item_scores(spark, d):
    return S.item_scores(bullets(spark, d)).select("bullet_id", "n_num", "n_kw", "score10")


@query("entity_scores", f"{SCORES} SELECT entity, loyalty_raw, spillover_raw, n_loyalty, n_spillover, activity, round(loyalty_score, 6) AS loyalty_score, round(spillover_score, 6) AS spillover_score FROM n")
def entity_scores(spark, d):
    return r6(scores(spark, d), "loyalty_score", "spillover_score")


_QUAD = "CASE WHEN loyalty_score >= avg(loyalty_score) OVER () AND spillover_score >= avg(spillover_score) OVER () THEN 'both' WHEN loyalty_score >= avg(loyalty_score) OVER () THEN 'loyalty' WHEN spillover_score >= avg(spillover_score) OVER () THEN 'spillover' ELSE 'neither' END"


@query("quadrants", f"{SCORES} SELECT entity, {_QUAD} AS quadrant FROM n")
def quadrants(spark, d):
    return S.quadrants(scores(spark, d))


def _hosts(names):
    return "(" + " OR ".join(f"dm = '{h}' OR ends_with(dm, '.{h}')" for h in names) + ")"


def _theme_sql(tags, folded):
    return " UNION ALL ".join(f"SELECT entity, '{t}' AS tag FROM b WHERE {any_word(lower('t') if folded else 't', [w.lower() for w in ws] if folded else ws)}" for t, ws in tags.items())


_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"
_ORG = " UNION ALL ".join(f"SELECT entity, '{t}' AS tag FROM b WHERE " + " OR ".join(f"regexp_matches(t, '(?i)(^|{_EDGE}){w}($|{_EDGE})')" if w.isascii() and w.isalpha() else f"contains(t, '{w}')" for w in ws) for t, ws in V.ORGANISATIONS.items())
_COVERAGE = f"""dom AS (SELECT *, {DOMAIN} AS dm FROM b), ls AS (SELECT entity, CASE {' '.join(f"WHEN {_hosts(V.HOSTS[x])} THEN '{x}'" for x in ('ja', 'zh', 'es', 'fr'))} WHEN {_hosts(V.HOSTS['en'])} OR list_contains({strings(V.EN_SOCIAL)}, dm) THEN 'en' WHEN regexp_matches(t, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'ja' ELSE 'ko' END AS l,
  CASE WHEN {_hosts(V.HOSTS['community'])} THEN 'c' WHEN {_hosts(V.HOSTS['wiki'])} THEN 'w' ELSE 'n' END AS s FROM dom),
 lc AS (SELECT entity, l, count(*) AS n FROM ls GROUP BY ALL), lp AS (SELECT entity, n / sum(n) OVER (PARTITION BY entity) AS p FROM lc), lang AS (SELECT entity, -sum(p * ln(p)) / ln(6) AS language FROM lp GROUP BY entity),
 mk AS (SELECT entity, count(DISTINCT tag) / {len(V.MARKETS)}.0 AS market FROM ({_theme_sql(V.MARKETS, True)}) GROUP BY entity), sr AS (SELECT entity, count(DISTINCT s) / 3.0 AS source FROM ls GROUP BY entity),
 yr AS (SELECT DISTINCT entity, y FROM (SELECT entity, unnest(list_filter(regexp_extract_all(t, '[0-9]+'), lambda y: length(y) = 4 AND y BETWEEN '2015' AND '2026')) AS y FROM b)), tm AS (SELECT entity, count(*) / (SELECT greatest(count(DISTINCT y), 1) FROM yr)::DOUBLE AS time FROM yr GROUP BY entity),
 og AS (SELECT entity, count(DISTINCT tag) / {len(V.ORGANISATIONS)}.0 AS kinds FROM ({_ORG}) GROUP BY entity),
 cov AS (SELECT entity, language, coalesce(market, 0) AS market, source, coalesce(time, 0) AS time, coalesce(kinds, 0) AS entity_kinds FROM lang JOIN sr USING (entity) LEFT JOIN mk USING (entity) LEFT JOIN tm USING (entity) LEFT JOIN og USING (entity)),
 cv AS (SELECT *, 0.30 * language + 0.25 * market + 0.20 * source + 0.15 * time + 0.10 * entity_kinds AS coverage FROM cov)"""
_PARTS = ("language", "market", "source", "time", "entity_kinds", "coverage")


@query("coverage", f"WITH {ITEMS}, {_COVERAGE} SELECT entity, " + ", ".join(f"round({c}::DOUBLE + 0.0, 6) AS {c}" for c in _PARTS) + " FROM cv")
def coverage(spark, d):
    c = S.coverage(bullets(spark, d))
    return c.select("entity", *[F.round(F.col(x) + 0.0, 6).alias(x) for x in _PARTS])


@query("index_card", f"{SCORES}, {_COVERAGE} SELECT entity, loyalty_raw, spillover_raw, activity, round(loyalty_score, 6) AS loyalty_score, round(spillover_score, 6) AS spillover_score, {_QUAD} AS quadrant, round(coverage::DOUBLE, 6) AS coverage FROM n JOIN cv USING (entity)")
def index_card(spark, d):
    """The flagship: raw and scaled scores, quadrant and coverage of every entity."""
    n = scores(spark, d)
    c = S.coverage(bullets(spark, d)).select("entity", "coverage")
    out = n.join(S.quadrants(n), "entity").join(c, "entity")
    return r6(out.select("entity", "loyalty_raw", "spillover_raw", "activity", "loyalty_score", "spillover_score", "quadrant", "coverage"), "loyalty_score", "spillover_score", "coverage")


@query("group_totals", f"WITH {ITEMS}, {SCORED} SELECT entity, kind, count(*) AS n, sum(score10)::BIGINT AS score10, grouping(entity)::INT + grouping(kind)::INT AS level FROM s GROUP BY GROUPING SETS ((entity, kind), (entity), ())")
def group_totals(spark, d):
    """Totals by entity and kind, by entity, and of all, in one pass."""
    s = S.item_scores(bullets(spark, d))
    c = s.groupingSets([["entity", "kind"], ["entity"], []], "entity", "kind").agg(F.count("*").alias("n"), F.sum("score10").alias("score10"), (F.grouping("entity") + F.grouping("kind")).cast("int").alias("level"))
    return c


@query("category_means", f"{SCORES}, c AS (SELECT entity, max(category) AS category FROM b GROUP BY entity) SELECT category, round(avg(loyalty_score), 6) AS loyalty, round(avg(spillover_score), 6) AS spillover, count(*) AS n, array_to_string(list_sort(list(entity)), '|') AS members FROM n JOIN c USING (entity) GROUP BY category")
def category_means(spark, d):
    c = bullets(spark, d).groupBy("entity").agg(F.max("category").alias("category"))
    g = scores(spark, d).join(c, "entity").groupBy("category")  # entities, a bounded roster
    return r6(g.agg(F.avg("loyalty_score").alias("loyalty"), F.avg("spillover_score").alias("spillover"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("entity")), "|").alias("members")), "loyalty", "spillover")


@query("outlet_ratio", f"WITH {ITEMS}, {THEME_HITS} SELECT entity, count(*) AS n, count(DISTINCT {DOMAIN}) AS outlets, round(count(DISTINCT {DOMAIN}) / count(*), 6) AS ratio FROM b WHERE {any_word('t', THEMES['travel'])} GROUP BY entity")
def outlet_ratio(spark, d):
    from ..functions.urls import domain

    b = bullets(spark, d).where(T.any_of(F.col("t"), THEMES["travel"]))
    per = b.groupBy("entity", domain(F.col("u")).alias("dm")).agg(F.count("*").alias("k")).groupBy("entity").agg(F.sum("k").alias("n"), F.count("*").alias("outlets"))
    return per.withColumn("ratio", F.round(F.col("outlets") / F.col("n"), 6))


# --- factors and profiles ---


def shares(spark, d) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    w = S.tag_hits(bullets(spark, d), THEMES).groupBy("entity", "tag").agg(F.count("*").alias("w"))
    return w.select("entity", m[F.col("tag")].alias("factor"), (F.col("w") / F.sum("w").over(Window.partitionBy("entity"))).alias("share"))


@query("factor_shares", f"WITH {ITEMS}, {SHARES} SELECT entity, factor, round(share, 6) AS share FROM sh")
def factor_shares(spark, d):
    topics = spark.createDataFrame(list(FACTORS.items()), "topic string, factor string")
    w = S.tag_hits(bullets(spark, d), THEMES).groupBy("entity", F.col("tag").alias("topic")).agg(F.count("*").alias("weight"))
    return r6(TP.factor_share(w, topics), "share")


@query("factor_diversity", f"WITH {ITEMS}, {SHARES} SELECT entity, round(-sum(share * ln(share)) / ln(5), 6) AS entropy FROM sh GROUP BY entity")
def factor_diversity(spark, d):
    w = S.tag_hits(bullets(spark, d), THEMES).groupBy("entity", "tag").agg(F.count("*").alias("n"))
    return r6(S.entropy(w, "entity", "n", len(THEMES)).withColumn("entropy", F.col("entropy") + 0.0), "entropy")


@query("personas", f"WITH {ITEMS}, {SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY share DESC, factor) AS k FROM sh), k AS (SELECT entity, string_agg(factor, '|' ORDER BY factor) AS key FROM r WHERE k <= 2 GROUP BY entity), d AS (SELECT entity, factor AS dominant FROM r WHERE k = 1) SELECT entity, key, CASE key {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in V.PERSONAS.items())} END AS persona, dominant FROM k JOIN d USING (entity)")
def personas(spark, d):
    s = shares(spark, d)
    return TP.personas(s, V.PERSONAS).join(TP.dominant(s).select("entity", "dominant"), "entity")


def _kind_persona(spark, d, kind):
    m = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    w = S.tag_hits(bullets(spark, d).where(F.col("kind") == kind), THEMES).groupBy("entity", m[F.col("tag")].alias("factor")).agg(F.count("*").cast("double").alias("share"))
    return TP.top2_key(w).withColumnRenamed("key", "persona")


_KP = "f2 AS (SELECT entity, kind, CASE tag " + " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in FACTORS.items()) + " END AS factor, count(*) AS n FROM hits GROUP BY ALL), r2 AS (SELECT *, row_number() OVER (PARTITION BY entity, kind ORDER BY n DESC, factor) AS k FROM f2), p2 AS (SELECT entity, kind, string_agg(factor, '|' ORDER BY factor) AS p FROM r2 WHERE k <= 2 GROUP BY ALL)"


@query("persona_migration", f"WITH {ITEMS}, {THEME_HITS}, {_KP} SELECT a.p AS old, b2.p AS new, count(*) AS n, string_agg(entity, '|' ORDER BY entity) AS members FROM p2 a JOIN p2 b2 USING (entity) WHERE a.kind = 'loyalty' AND b2.kind = 'spillover' GROUP BY ALL")
def persona_migration(spark, d):
    return TP.migration(_kind_persona(spark, d, "loyalty"), _kind_persona(spark, d, "spillover"))


@query("factor_impact", f"{SCORES}, {SHARES} SELECT entity, factor, round(share * loyalty_score, 6) AS loyalty, round(share * spillover_score, 6) AS spillover FROM sh JOIN n USING (entity)")
def factor_impact(spark, d):
    return r6(S.impact(shares(spark, d), scores(spark, d)), "loyalty", "spillover")


# --- statistics ---


@query("pearson", f"{SCORES}, p AS (SELECT count(*) AS n, corr(loyalty_score, spillover_score) AS r FROM n) SELECT n, round(r, 6) AS r, round(r * r, 6) AS r2, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t, round(tanh(atanh(r) - 1.959964 / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + 1.959964 / sqrt(n - 3)), 6) AS hi FROM p")
def pearson(spark, d):
    return r6(ST.pearson(scores(spark, d), "loyalty_score", "spillover_score"), "r", "r2", "t", "lo", "hi")


@query("spearman", f"{SCORES}, k AS (SELECT rank() OVER (ORDER BY loyalty_raw) + (count(*) OVER (PARTITION BY loyalty_raw) - 1) / 2.0 AS a, rank() OVER (ORDER BY spillover_raw) + (count(*) OVER (PARTITION BY spillover_raw) - 1) / 2.0 AS c FROM n) SELECT round(corr(a, c), 6) AS rho FROM k")
def spearman(spark, d):
    return r6(ST.spearman(scores(spark, d), "loyalty_raw", "spillover_raw"), "rho")


@query("ols1", f"{SCORES} SELECT count(*) AS n, round(regr_slope(spillover_raw, loyalty_raw), 6) AS slope, round(regr_intercept(spillover_raw, loyalty_raw), 5) AS intercept, round(regr_r2(spillover_raw, loyalty_raw), 6) AS r2 FROM n")
def ols1(spark, d):
    o = ST.ols1(scores(spark, d), "spillover_raw", "loyalty_raw")
    return o.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("ols2", f"""{SCORES}, c AS (SELECT count(*) AS n, avg(spillover_score) AS my, avg(loyalty_score) AS ma, avg(activity) AS mb, var_pop(loyalty_score) AS aa, var_pop(activity) AS bb, covar_pop(loyalty_score, activity) AS ab, covar_pop(loyalty_score, spillover_score) AS ay, covar_pop(activity, spillover_score) AS cy, var_pop(spillover_score) AS yy FROM n),
 k AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS b1, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c) SELECT n, round(my - b1 * ma - b2 * mb, 5) AS b0, round(b1, 5) AS b1, round(b2, 6) AS b2, round((b1 * ay + b2 * cy) / yy, 6) AS r2, round(aa * bb / (aa * bb - ab * ab), 4) AS vif FROM k""")
def ols2(spark, d):
    o = ST.ols2(scores(spark, d), "spillover_score", "loyalty_score", "activity")
    return o.select("n", *[F.round(c, k).alias(c) for c, k in (("b0", 5), ("b1", 5), ("b2", 6), ("r2", 6), ("vif", 4))])


@query("cooks_distance", f"""{SCORES}, l AS (SELECT count(*)::DOUBLE AS m, regr_slope(spillover_score, loyalty_score) AS b, regr_intercept(spillover_score, loyalty_score) AS a, avg(loyalty_score) AS mx, regr_sxx(spillover_score, loyalty_score) AS sxx, regr_syy(spillover_score, loyalty_score) AS syy, regr_sxy(spillover_score, loyalty_score) AS sxy FROM n),
 x AS (SELECT entity, spillover_score - a - b * loyalty_score AS e, 1 / m + (loyalty_score - mx) ** 2 / sxx AS h, (syy - b * sxy) / (m - 2) AS mse, m FROM n, l) SELECT entity, round(e, 6) AS residual, round(h, 6) AS leverage, round(e / sqrt(mse * (1 - h)), 5) AS student, round(e * e / (2 * mse) * h / (1 - h) ** 2, 6) AS cook, e * e / (2 * mse) * h / (1 - h) ** 2 > 4.0 / m AS influential FROM x""")
def cooks_distance(spark, d):
    c = ST.cooks(scores(spark, d), "entity", "spillover_score", "loyalty_score")
    return c.select("entity", F.round("residual", 6).alias("residual"), F.round("leverage", 6).alias("leverage"), F.round("student", 5).alias("student"), F.round("cook", 6).alias("cook"), "influential")


@query("leave_one_out", f"""{SCORES}, g AS (SELECT count(*)::DOUBLE AS m, avg(loyalty_score) AS mx, avg(spillover_score) AS my, var_pop(loyalty_score) AS vx, var_pop(spillover_score) AS vy, covar_pop(loyalty_score, spillover_score) AS cxy, corr(loyalty_score, spillover_score) AS r FROM n),
 x AS (SELECT entity, r, (m * cxy - m / (m - 1) * (loyalty_score - mx) * (spillover_score - my)) / sqrt((m * vx - m / (m - 1) * (loyalty_score - mx) ** 2) * (m * vy - m / (m - 1) * (spillover_score - my) ** 2)) AS q FROM n, g) SELECT entity, round(q, 6) AS r_without, round(r - q, 6) + 0.0 AS delta FROM x""")
def leave_one_out(spark, d):
    o = ST.leave_one_out(scores(spark, d), "entity", "loyalty_score", "spillover_score")
    return o.select("entity", F.round("r_without", 6).alias("r_without"), (F.round("delta", 6) + 0.0).alias("delta"))


@query("chi2_quadrants", f"{SCORES}, t AS (SELECT count(*) FILTER (x AND y) AS a, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) FILTER (NOT x AND NOT y) AS d FROM (SELECT loyalty_score >= 0.5 AS x, spillover_score >= 0.5 AS y FROM n)) SELECT a, b, c, d, round((a + b + c + d)::DOUBLE * greatest(abs(a * d - b * c)::DOUBLE - (a + b + c + d) / 2, 0) ** 2 / nullif(((a + b) * (c + d) * (a + c) * (b + d))::DOUBLE, 0), 6) AS chi2 FROM t")
def chi2_quadrants(spark, d):
    return r6(ST.contingency(scores(spark, d), F.col("loyalty_score") >= 0.5, F.col("spillover_score") >= 0.5), "chi2")


@query("partial_corr", f"{SCORES}, c AS (SELECT corr(loyalty_score, spillover_score) AS xy, corr(loyalty_score, activity) AS xz, corr(spillover_score, activity) AS yz FROM n) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 5) AS partial_r FROM c")
def partial_corr(spark, d):
    return ST.partial_corr(scores(spark, d), "loyalty_score", "spillover_score", "activity").select(F.round("partial_r", 5).alias("partial_r"))


@query("loglog_residual", f"{SCORES}, l AS (SELECT entity, ln(activity) AS x, ln(loyalty_raw) AS y FROM n WHERE loyalty_raw > 0), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l) SELECT entity, round(y - a - b * x, 6) + 0.0 AS residual FROM l, f")
def loglog_residual(spark, d):
    return ST.loglog_residual(scores(spark, d), "entity", "loyalty_raw", "activity").select("entity", (F.round("residual", 6) + 0.0).alias("residual"))


@query("density_scores", f"{SCORES}, a AS (SELECT entity, loyalty_raw / nullif(n_loyalty, 0) AS dens FROM n) SELECT entity, round((dens - min(dens) OVER ()) / nullif(max(dens) OVER () - min(dens) OVER (), 0), 6) AS density FROM a")
def density_scores(spark, d):
    a = scores(spark, d).select("entity", (F.col("loyalty_raw") / F.nullif(F.col("n_loyalty"), F.lit(0))).alias("dens"))
    return r6(S.with_minmax(a, density="dens"), "density").select("entity", "density")


@query("wilson_recall", f"WITH {ITEMS}, w AS (SELECT entity, count(*) FILTER ({any_word('t', THEMES['travel'])})::DOUBLE AS k, count(*)::DOUBLE AS m FROM b GROUP BY entity) SELECT entity, round((k / m + 1.959964 ** 2 / (2 * m) - 1.959964 * sqrt(k / m * (1 - k / m) / m + 1.959964 ** 2 / (4 * m * m))) / (1 + 1.959964 ** 2 / m), 6) + 0.0 AS lo, round((k / m + 1.959964 ** 2 / (2 * m) + 1.959964 * sqrt(k / m * (1 - k / m) / m + 1.959964 ** 2 / (4 * m * m))) / (1 + 1.959964 ** 2 / m), 6) AS hi FROM w")
def wilson_recall(spark, d):
    w = bullets(spark, d).groupBy("entity").agg(F.count_if(T.any_of(F.col("t"), THEMES["travel"])).cast("double").alias("k"), F.count("*").alias("m"))
    lo, hi = ST.wilson(F.col("k"), F.col("m"))
    return w.select("entity", (F.round(lo, 6) + 0.0).alias("lo"), F.round(hi, 6).alias("hi"))


@query("percentile_ci", f"{SCORES} SELECT round(quantile_cont(loyalty_raw, 0.025), 6) AS lo, round(quantile_cont(loyalty_raw, 0.975), 6) AS hi FROM n")
def percentile_ci(spark, d):
    return r6(ST.percentile_ci(scores(spark, d), "loyalty_raw"), "lo", "hi")


# --- joins and sets ---


@query("roster_status", "WITH l AS (SELECT DISTINCT entity FROM fandoms_v3_100), r AS (SELECT DISTINCT entity FROM roster_history) SELECT entity, CASE WHEN l.entity IS NULL THEN 'roster only' WHEN r.entity IS NULL THEN 'corpus only' ELSE 'both' END AS side FROM l FULL JOIN r USING (entity)".replace("l.entity IS NULL", "lh IS NULL").replace("r.entity IS NULL", "rh IS NULL").replace("DISTINCT entity FROM fandoms", "DISTINCT entity, 1 AS lh FROM fandoms").replace("DISTINCT entity FROM roster", "DISTINCT entity, 1 AS rh FROM roster"))
def roster_status(spark, d):
    live = table(spark, d, "fandoms_v3_100").select("entity").distinct().withColumn("l", F.lit(1))
    known = table(spark, d, "roster_history").select("entity").distinct().withColumn("r", F.lit(1))
    return R.grid(live, known, "entity", "l", "r").select("entity", F.when(F.col("l").isNull(), "roster only").when(F.col("r").isNull(), "corpus only").otherwise("both").alias("side"))


@query("roster_semi_anti", "SELECT entity, status, entity IN (SELECT entity FROM fandoms_v3_100) AS in_corpus FROM roster_history")
def roster_semi_anti(spark, d):
    r, b = table(spark, d, "roster_history").select("entity", "status"), table(spark, d, "fandoms_v3_100")
    return R.common(r, b, "entity").withColumn("in_corpus", F.lit(True)).unionByName(R.only(r, b, "entity").withColumn("in_corpus", F.lit(False)))


@query("kind_pivot", "SELECT entity, count(*) FILTER (kind = 'loyalty') AS loyalty, count(*) FILTER (kind = 'spillover') AS spillover FROM fandoms_v3_100 GROUP BY entity")
def kind_pivot(spark, d):
    return R.pivot_counts(table(spark, d, "fandoms_v3_100"), "entity", "kind", ["loyalty", "spillover"])


@query("entity_filter", f"{SCORES}, c AS (SELECT entity, max(category) AS category FROM b GROUP BY entity) SELECT entity, category, activity FROM n JOIN c USING (entity) WHERE category IN ('솔로', '밴드') AND contains(lower(entity), 'a')")
def entity_filter(spark, d):
    c = bullets(spark, d).groupBy("entity").agg(F.max("category").alias("category"), F.count("*").alias("activity"))
    return R.interactive_filter(c, "category", ["솔로", "밴드"], query="A")


@query("top_entities", f"{SCORES} SELECT entity, loyalty_raw + spillover_raw AS score FROM n ORDER BY score DESC, entity LIMIT 15")
def top_entities(spark, d):
    s = scores(spark, d).select("entity", (F.col("loyalty_raw") + F.col("spillover_raw")).alias("score"))
    return R.top(s, 15, F.desc("score"), F.asc("entity"))


@query("top_items", f"WITH {ITEMS}, {SCORED} SELECT entity, bullet_id, score10::INT AS score10, row_number() OVER (PARTITION BY entity ORDER BY score10 DESC, bullet_id)::INT AS rank FROM s QUALIFY rank <= 3")
def top_items(spark, d):
    s = S.item_scores(bullets(spark, d)).select("entity", "bullet_id", "score10")
    return R.top_each(s, ["entity"], 3, F.desc("score10"), F.asc("bullet_id"), salt=F.col("bullet_id"))


@query("cloud_overlap", f"WITH c AS (SELECT cloud_id, entity, list_distinct(list_filter(list_transform(coalesce(top_30, []), lambda x: trim({lower('x.word')})), lambda w: w IS NOT NULL AND w <> '')) AS ws FROM wordcloud_by_language_v7), l AS (SELECT *, lag(ws) OVER (PARTITION BY entity ORDER BY cloud_id) AS ps FROM c) SELECT cloud_id, len(list_intersect(ws, ps))::INT AS common, round(len(list_intersect(ws, ps)) / nullif(len(list_distinct(list_concat(ws, ps))), 0), 6) AS jaccard FROM l WHERE ps IS NOT NULL")
def cloud_overlap(spark, d):
    """Each cloud's words against those of the entity's cloud before it."""
    ws = F.array_distinct(F.filter(F.transform(F.coalesce("top_30", F.array().cast("array<struct<word:string,n:bigint>>")), lambda x: F.trim(F.lower(x["word"]))), lambda w: w.isNotNull() & (w != "")))
    c = table(spark, d, "wordcloud_by_language_v7").select("cloud_id", "entity", ws.alias("ws"))
    l = c.withColumn("ps", F.lag("ws").over(Window.partitionBy("entity").orderBy("cloud_id"))).where("ps is not null")
    return l.select("cloud_id", F.size(F.array_intersect("ws", "ps")).alias("common"), F.round(TP.jaccard(F.col("ws"), F.col("ps")), 6).alias("jaccard"))


@query("cloud_maps", "WITH x AS (SELECT cloud_id, unnest(list_filter(top_30, lambda x: x.word IS NOT NULL AND x.n IS NOT NULL)) AS x FROM wordcloud_by_language_v7), m AS (SELECT cloud_id, x.word AS word, sum(x.n) AS n FROM x GROUP BY ALL) SELECT cloud_id, sum(n)::DOUBLE AS total, count(*) FILTER (n > 0)::INT AS positive, coalesce(sum(n) FILTER (word = 'fandom'), 0)::BIGINT AS fandom FROM m GROUP BY cloud_id")
def cloud_maps(spark, d):
    w = table(spark, d, "wordcloud_by_language_v7").select("cloud_id", F.inline("top_30")).where("word is not null and n is not null")
    m = w.groupBy("cloud_id", "word").agg(F.sum("n").alias("n")).groupBy("cloud_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m"))  # thirty words a row
    return m.select("cloud_id", R.map_total(F.col("m")).alias("total"), R.positive_values(F.col("m")).alias("positive"), R.map_lookup(F.col("m"), "fandom", 0).alias("fandom"))


# --- rounds and snapshots ---

_KEY = "nullif(regexp_extract({0}, 'r([0-9]+)', 1), '')::INT AS n, CASE regexp_extract({0}, 'r[0-9]+_(p2|2ch)', 1) WHEN 'p2' THEN 1 WHEN '2ch' THEN 2 ELSE 0 END AS suffix"


@query("growth_gaps", f"WITH g AS (SELECT stage, {_KEY.format('stage')}, before_total, after_total, coalesce(net_new_bullets, after_total - before_total) AS net_new FROM growth_history), p AS (SELECT *, lag(after_total) OVER (ORDER BY n, suffix) AS prev FROM g) SELECT stage, n, suffix, before_total, after_total, net_new, CASE WHEN prev <> before_total THEN concat(prev, ' -> ', before_total) END AS gap FROM p")
def growth_gaps(spark, d):
    return L.growth(table(spark, d, "growth_history"))


@query("growth_segments", f"WITH g AS (SELECT {_KEY.format('stage')}, net_new_bullets FROM growth_history WHERE net_new_bullets IS NOT NULL), p AS (SELECT n, net_new_bullets, CASE WHEN n - lag(n) OVER (ORDER BY n) > 1 THEN 1 ELSE 0 END AS leap FROM g) SELECT n, net_new_bullets, sum(leap) OVER (ORDER BY n)::BIGINT AS segment, sum(net_new_bullets) OVER (ORDER BY n)::BIGINT AS cum, round(sum(net_new_bullets) OVER (ORDER BY n) / sum(net_new_bullets) OVER (), 6) AS cum_share FROM p")
def growth_segments(spark, d):
    g = table(spark, d, "growth_history").where("net_new_bullets is not null").select(T.round_key(F.col("stage"))["n"].alias("n"), "net_new_bullets")
    s = L.segments(g, "n", 1)
    return r6(L.cumulative(s, [F.col("n")], "net_new_bullets"), "cum_share")


@query("growth_interpolated", f"WITH g AS (SELECT {_KEY.format('stage')}, net_new_bullets AS v FROM growth_history), k AS (SELECT n, v, max(CASE WHEN v IS NOT NULL THEN n END) OVER (ORDER BY n) AS a, min(CASE WHEN v IS NOT NULL THEN n END) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM g) SELECT k.n, round(coalesce(k.v::DOUBLE, p.v + (q.v - p.v) * (k.n - k.a) / nullif(k.z - k.a, 0)::DOUBLE), 6) AS value, k.v IS NOT NULL AS measured FROM k LEFT JOIN g p ON p.n = k.a LEFT JOIN g q ON q.n = k.z")
def growth_interpolated(spark, d):
    g = table(spark, d, "growth_history").select(T.round_key(F.col("stage"))["n"].alias("n"), F.col("net_new_bullets").alias("value"))
    return r6(L.interpolate(g, "n", "value"), "value").select("n", "value", "measured")


@query("rejections", "WITH g AS (SELECT nullif(regexp_extract(stage, 'r([0-9]+)', 1), '')::INT AS n, net_new_bullets AS v FROM growth_history WHERE net_new_bullets IS NOT NULL), o AS (SELECT max(n) FILTER (v >= 100) AS ok FROM g) SELECT count(*) AS measured, count(*) FILTER (v < 100) AS below, count(*) FILTER (ok IS NULL OR n > ok) AS in_a_row FROM g, o")
def rejections(spark, d):
    g = table(spark, d, "growth_history").select(T.round_key(F.col("stage"))["n"].alias("n"), F.col("net_new_bullets").alias("v"))
    return L.rejected_in_a_row(g, "n", "v", 100)


_LENGTHS = "lens AS (SELECT entity, kind, (count(*) * 2) // 5 AS n1, (count(*) * 4) // 5 AS n2 FROM b GROUP BY ALL)"


def _lengths(spark, d):
    return bullets(spark, d).groupBy("entity", "kind").agg(F.floor(F.count("*") * 2 / 5).alias("n1"), F.floor(F.count("*") * 4 / 5).alias("n2"))


@query("prefix_snapshot", f"WITH {ITEMS}, {_LENGTHS} SELECT bullet_id, entity, kind, idx FROM b JOIN lens USING (entity, kind) WHERE idx < n1")
def prefix_snapshot(spark, d):
    return L.prefix(bullets(spark, d), _lengths(spark, d).select("entity", "kind", F.col("n1").alias("n"))).select("bullet_id", "entity", "kind", "idx")


@query("provenance", f"WITH {ITEMS}, {_LENGTHS} SELECT bullet_id, entity, kind, idx, substr(sha1(t), 1, 12) AS hash, CASE WHEN idx < n1 THEN 's1' WHEN idx < n2 THEN 's2' ELSE 'live' END AS bin FROM b JOIN lens USING (entity, kind)")
def provenance(spark, d):
    n = _lengths(spark, d)
    snaps = n.select("entity", "kind", F.inline(F.array(*[F.struct(F.lit(f"s{i}").alias("snapshot"), F.col(f"n{i}").alias("n")) for i in (1, 2)])))
    return L.provenance(bullets(spark, d), snaps, "live")


@query("prefix_violations", f"WITH {ITEMS}, m AS (SELECT entity, kind, idx, CASE WHEN bullet_id % 50 = 0 THEN 'edited' ELSE t END AS t FROM b) SELECT b.entity, b.kind, b.idx, b.t AS was, m.t AS \"is\" FROM b LEFT JOIN m USING (entity, kind, idx) WHERE b.t IS DISTINCT FROM m.t")
def prefix_violations(spark, d):
    """Two versions of the lists compared place by place; the second has an edit in some places."""
    b = bullets(spark, d)
    return L.prefix_violations(b, b.withColumn("t", F.when(F.col("bullet_id") % 50 == 0, "edited").otherwise(F.col("t"))))


@query("reconciliation", f"WITH {ITEMS}, r AS (SELECT entity, bullets_at_entry FROM roster_history) SELECT entity, count(bullet_id) AS live, max(bullets_at_entry) AS at_entry, count(bullet_id) - max(bullets_at_entry) AS grown, count(bullet_id) >= max(bullets_at_entry) AS ok FROM r LEFT JOIN b USING (entity) GROUP BY entity")
def reconciliation(spark, d):
    r = table(spark, d, "roster_history").select("entity", "bullets_at_entry")
    n = bullets(spark, d).groupBy("entity").agg(F.count("*").alias("live"))
    g = r.groupBy("entity").agg(F.max("bullets_at_entry").alias("at_entry"), F.count("*").alias("k")).join(n, "entity", "left").withColumn("live", F.coalesce("live", F.lit(0)) * F.col("k"))
    return g.select("entity", "live", "at_entry", (F.col("live") - F.col("at_entry")).alias("grown"), (F.col("live") >= F.col("at_entry")).alias("ok"))


@query("roster_swaps", "WITH s AS (SELECT entered_round AS round, replaces AS removed, entity AS added FROM roster_history WHERE replaces IS NOT NULL), l AS (SELECT DISTINCT entity FROM roster_history WHERE status = 'live'), a AS (SELECT l.entity AS e, 1 AS live FROM l), c AS (SELECT added AS e, round, removed FROM s), g AS (SELECT removed AS e, round AS rr, added AS rb FROM s) SELECT e AS entity, CASE WHEN live = 1 THEN 'live' ELSE 'removed' END AS status, coalesce(round, 'initial') AS entered_round, removed AS replaces, rr AS removed_round, rb AS replaced_by FROM a FULL JOIN c USING (e) FULL JOIN g USING (e)")
def roster_swaps(spark, d):
    r = table(spark, d, "roster_history")
    swaps = r.where("replaces is not null").select(F.col("entered_round").alias("round"), F.col("replaces").alias("removed"), F.col("entity").alias("added"))
    return L.roster(r.where("status = 'live'").select("entity").distinct(), swaps)


_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("snapshot_compare", f"WITH {ITEMS}, {SCORED}, {_LENGTHS}, a AS (SELECT entity, sum(score10) / 10.0::DOUBLE AS x FROM s GROUP BY entity), p AS (SELECT entity, sum(score10) / 10.0::DOUBLE AS y FROM s JOIN lens USING (entity, kind) WHERE idx < n1 GROUP BY entity), j AS (SELECT * FROM a JOIN p USING (entity)), k AS (SELECT *, {_AVG_RANK.format('x')} AS rx, {_AVG_RANK.format('y')} AS ry, row_number() OVER (ORDER BY x DESC, entity) AS tx, row_number() OVER (ORDER BY y DESC, entity) AS ty FROM j) SELECT count(*) AS n, round(corr(x, y), 6) AS r, round(corr(rx, ry), 6) AS rank_rho, count(*) FILTER (tx <= 15 AND ty <= 15) AS top_overlap FROM k")
def snapshot_compare(spark, d):
    s = keep(S.item_scores(bullets(spark, d)).select("entity", "kind", "idx", "score10"), "scored")  # texts are read once
    total = lambda x: keep(x.groupBy("entity").agg((F.sum("score10") / 10.0).alias("score")), "totals")
    n1 = s.groupBy("entity", "kind").agg(F.floor(F.count("*") * 2 / 5).alias("n"))
    return r6(L.compare_scores(total(s), total(L.prefix(s, n1))), "r", "rank_rho")


@query("gate", "WITH s AS (SELECT vec_id, label, vec_id % 10 AS seed, label % 2 AS corpus, 8 + 2 * (label % 3) AS k, abs(embedding[1]) AS sil, 4 + vec_id % 5 AS best_m, abs(embedding[1]) + abs(embedding[2]) / 10 AS best_sil, abs(embedding[3]) * 4 AS jac FROM embeddings), m AS (SELECT corpus, k, best_m, count(*) AS n FROM s GROUP BY ALL), mode AS (SELECT corpus, k, first(best_m ORDER BY n DESC, best_m) AS mode_m FROM m GROUP BY ALL), g AS (SELECT corpus, k, median(sil) AS ms, median(jac) AS mj, median(best_sil) AS mb FROM s GROUP BY ALL), f AS (SELECT *, ms >= 0.08 AS g1, mj >= 0.35 AS g2, mode_m = 5 OR ms >= 0.9 * mb AS g3 FROM g JOIN mode USING (corpus, k)) SELECT corpus::INT AS corpus, k::INT AS k, round(ms::DOUBLE, 6) AS median_sil, round(mj::DOUBLE, 6) AS median_jaccard, mode_m::INT AS mode_m, g1, g2, g3, g1 AND g2 AND g3 AS passed FROM f")
def gate(spark, d):
    e = F.transform("embedding", lambda x: x)
    s = table(spark, d, "embeddings").select((F.col("label") % 2).alias("corpus"), (8 + 2 * (F.col("label") % 3)).alias("k"), (F.col("vec_id") % 10).alias("seed"), F.abs(e[0]).alias("sil"), (4 + F.col("vec_id") % 5).cast("int").alias("best_m"), (F.abs(e[0]) + F.abs(e[1]) / 10).alias("best_sil"), (F.abs(e[2]) * 4).alias("jaccard"))
    g = L.gate(s, 0.08)
    return g.select("corpus", "k", F.round(F.col("median_sil"), 6).alias("median_sil"), F.round(F.col("median_jaccard"), 6).alias("median_jaccard"), "mode_m", "g1", "g2", "g3", "passed")


# --- topics ---

_CENTRE = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL)"


def _centroids(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return v, v.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))


@query("centroid_cosine", f"WITH {_CENTRE} SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM v JOIN c USING (label, i) GROUP BY vec_id")
def centroid_cosine(spark, d):
    """Each vector's cosine with the mean of its label, the means gathered by dimension and joined as one array a label."""
    _, c = _centroids(spark, d)
    mean = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    j = table(spark, d, "embeddings").join(F.broadcast(mean), "label")  # a label a row
    return j.select("vec_id", F.round(TP.cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"))


@query("topic_distances", f"WITH {_CENTRE} SELECT p.label AS a, q.label AS b, round(greatest(1 - sum(p.m * q.m) / (sqrt(sum(p.m * p.m)) * sqrt(sum(q.m * q.m))), 0), 6) AS distance FROM c p JOIN c q USING (i) WHERE p.label < q.label GROUP BY ALL")
def topic_distances(spark, d):
    _, c = _centroids(spark, d)
    p, q = c.select(F.col("label").alias("a"), "i", F.col("m").alias("x")), c.select(F.col("label").alias("b"), "i", F.col("m").alias("y"))
    s = p.join(q, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return s.select("a", "b", F.round(F.greatest(1 - F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0)), 6).alias("distance"))


_DOCS = """dt AS (SELECT DISTINCT bullet_id AS doc, category, unnest(regexp_extract_all(""" + lower("t") + """, '[\\p{L}\\p{N}_]{3,}')) AS term FROM b WHERE category IS NOT NULL),
 tt AS (SELECT category AS topic, term, count(*) AS n FROM dt GROUP BY ALL), tp AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS rank FROM tt QUALIFY rank <= 8)"""


def _pseudo_topics(spark, d):
    """The commonest words of each category, as topics."""
    b = bullets(spark, d).where("category is not null")
    docs = b.select(F.col("bullet_id").alias("doc"), "category", T.find_all(F.lower("t"), "[\\p{L}\\p{N}_]{3,}").alias("words"))
    n = docs.select("doc", F.col("category").alias("topic"), F.explode(F.array_distinct("words")).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
    return docs, keep(R.top_each(n, ["topic"], 8, F.desc("n"), F.asc("term")).select("topic", "term", "rank"), "topics")


@query("umass_coherence", f"WITH {ITEMS}, {_DOCS}, oc AS (SELECT DISTINCT doc, term FROM dt WHERE term IN (SELECT term FROM tp)), df AS (SELECT term, count(*) AS df FROM oc GROUP BY term), pr AS (SELECT x.topic, x.term AS lo, y.term AS hi FROM tp x JOIN tp y ON x.topic = y.topic AND x.rank > y.rank), co AS (SELECT p.term AS lo, q.term AS hi, count(*) AS co FROM oc p JOIN oc q ON p.doc = q.doc AND p.term <> q.term GROUP BY ALL) SELECT topic, round(avg(ln((coalesce(co, 0) + 1) / df)), 6) AS coherence FROM pr LEFT JOIN co USING (lo, hi) JOIN df ON df.term = lo GROUP BY topic")
def umass_coherence(spark, d):
    docs, topics = _pseudo_topics(spark, d)
    return r6(TP.umass(docs, topics), "coherence")


@query("topic_diversity", f"WITH {ITEMS}, {_DOCS} SELECT round(count(DISTINCT term) / count(*), 6) AS diversity FROM tp")
def topic_diversity(spark, d):
    return r6(TP.topic_diversity(_pseudo_topics(spark, d)[1]), "diversity")


@query("rank_sum", "WITH g AS (SELECT n_regionkey AS k, count(*)::DOUBLE AS perplexity, avg(n_nationkey) AS coherence, max(n_nationkey)::DOUBLE AS diversity, min(n_nationkey)::DOUBLE AS stability FROM nation GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY round_even(perplexity, 1), k) AS r1, row_number() OVER (ORDER BY round_even(coherence, 3) DESC, k) AS r2, row_number() OVER (ORDER BY round_even(diversity, 3) DESC, k) AS r3, row_number() OVER (ORDER BY round_even(stability, 3) DESC, k) AS r4 FROM g), s AS (SELECT k, (r1 + r2 + r3 + r4)::INT AS rank_sum FROM r) SELECT k::BIGINT AS k, rank_sum, row_number() OVER (ORDER BY rank_sum, k) = 1 AS selected FROM s")
def rank_sum(spark, d):
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("k")).agg(F.count("*").cast("double").alias("perplexity"), F.avg("n_nationkey").alias("coherence"), F.max("n_nationkey").cast("double").alias("diversity"), F.min("n_nationkey").cast("double").alias("stability"))
    out = TP.rank_sum(g, {"perplexity": False, "coherence": True, "diversity": True, "stability": True}, {"perplexity": 1, "coherence": 3, "diversity": 3, "stability": 3})
    return out.select("k", F.col("rank_sum").cast("int").alias("rank_sum"), "selected")


def _fitted(spark, d, k, seed, rounds):
    docs, _ = TP.words_of(bullets(spark, d))
    counted, vec = TP.vectorize(docs.persist())
    counted = counted.persist()  # read once a round
    return TP.fit_topics(counted, k, seed, rounds), counted, vec.vocabulary


@query("lda_topics")
def lda_topics(spark, d):
    model, _, words = _fitted(spark, d, 8, 0, 50)
    return TP.phi_long(model, words, spark, 10)


@query("lda_entity_factors")
def lda_entity_factors(spark, d):
    """Topics, clustered by the cosine of their words into factors, and each entity's share of these."""
    model, counted, _ = _fitted(spark, d, 8, 0, 50)
    phi = model.topicsMatrix().toArray().T
    dist = TP.cosine_distances(phi / phi.sum(1, keepdims=True))
    m, _ = TP.choose_m(dist, range(3, 7))
    labels = TP.cut(TP.linkage(dist), len(dist), m)
    factors = spark.createDataFrame([(t, f"F{c + 1}") for t, c in enumerate(labels)], "topic int, factor string")
    weights = TP.theta(model, counted).join(bullets(spark, d).select(F.col("bullet_id").alias("doc"), "entity"), "doc")
    return TP.factor_share(weights, factors)


@query("lda_grid")
def lda_grid(spark, d):
    """Numbers of topics by four measures, on the grid, seeds and iterations of the method."""
    docs, _ = TP.words_of(bullets(spark, d))
    docs = docs.persist()
    counted, vec = TP.vectorize(docs)
    counted = counted.persist()
    rows, words, tops = [], vec.vocabulary, []
    for k, model in TP.fits(counted, [(k, seed) for k in (8, 10, 12, 15, 20, 25, 30) for seed in (1, 2, 3)], len(words)):
        tops.append(TP.top_words(model, words))
        if len(tops) == 1:
            perplexity = TP.perplexity(model, counted)
        del model  # its topics make room for the next
        if len(tops) < 3:
            continue
        topics = spark.createDataFrame([(t, r + 1, w) for t, ws in enumerate(tops[0]) for r, w in enumerate(ws)], "topic int, rank int, term string")
        coherence = TP.umass(docs, topics).agg(F.avg("coherence")).first()[0]
        rows.append((k, perplexity, coherence, len({w for ws in tops[0] for w in ws}) / (k * 10), TP.stability(tops)))
        tops = []
    counted.unpersist()
    grid = spark.createDataFrame(rows, "k long, perplexity double, coherence double, diversity double, stability double")
    return TP.rank_sum(grid, {"perplexity": False, "coherence": True, "diversity": True, "stability": True}, {"perplexity": 1, "coherence": 3, "diversity": 3, "stability": 3})


@query("meta_clusters")
def meta_clusters(spark, d):
    """Labels of the vectors clustered by the cosine of their means: (label, cluster, height at which it joins)."""
    _, c = _centroids(spark, d)
    rows = ST.bounded(c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("m")).orderBy("label"), 5_000)
    names, x = rows["label"].tolist(), np.array(rows["m"].tolist())
    dist = TP.cosine_distances(x)
    m, _ = TP.choose_m(dist, range(2, 6))
    merges = TP.linkage(dist)
    first = {}
    for new, i, j, h, _ in merges:
        for leaf in (i, j):
            first.setdefault(leaf, h)
    return spark.createDataFrame([(int(n), int(c), float(first[i])) for i, (n, c) in enumerate(zip(names, TP.cut(merges, len(dist), m)))], "label int, cluster int, height double")


@query("profile_map")
def profile_map(spark, d):
    """Two principal components of the entities' factor shares."""
    wide = shares(spark, d).groupBy("entity").pivot("factor", list(FACTORS.values())).agg(F.first("share")).na.fill(0.0)
    wide = ST.bounded(wide.orderBy("entity"))
    xy = TP.pca2(wide[list(FACTORS.values())].to_numpy())["xy"]
    return spark.createDataFrame([(e, float(a), float(b)) for e, (a, b) in zip(wide["entity"], xy)], "entity string, x double, y double")


@query("robust_slopes")
def robust_slopes(spark, d):
    """Slopes of spillover on loyalty and activity by least squares, Huber, medians, and without influential entities; whether all agree in sign."""
    n = scores(spark, d)
    trimmed = n.join(ST.cooks(n, "entity", "spillover_score", "loyalty_score").where("influential").select("entity"), "entity", "left_anti")
    y, x = ST.design(n, "spillover_score", ["loyalty_score", "activity"])
    yt, xt = ST.design(trimmed, "spillover_score", ["loyalty_score", "activity"])
    fits = {"ols": ST.ols(y, x)["coef"], "huber": ST.huber(y, x), "median": ST.median_regression(y, x), "trimmed": ST.ols(yt, xt)["coef"]}
    same = len({np.sign(b[1]) for b in fits.values()}) == 1
    return spark.createDataFrame([(k, float(b[1]), float(b[2]), same) for k, b in fits.items()], "method string, loyalty double, activity double, same_sign boolean")


# --- resampling ---

# draws by MD5, as hash_place() makes them
_DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
_BOOT = f"""o AS (SELECT *, row_number() OVER (ORDER BY entity) - 1 AS pos FROM n), k AS (SELECT count(*) AS k FROM n), dr AS (SELECT id // k AS rep, {_DRAW.format("id::VARCHAR || '|0'")} % k AS pos FROM k, (SELECT unnest(range(2000 * (SELECT k FROM k))) AS id)),
 bs AS (SELECT rep, o.* EXCLUDE (pos) FROM dr JOIN o USING (pos))"""


@query("bootstrap_r", f"{SCORES}, {_BOOT}, r AS (SELECT corr(loyalty_score, spillover_score) AS r FROM bs GROUP BY rep) SELECT round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi FROM r")
def bootstrap_r(spark, d):
    return r6(RS.bootstrap_r(spark, scores(spark, d).select("entity", "loyalty_score", "spillover_score"), "loyalty_score", "spillover_score"), "mean_r", "lo", "hi")


@query("bootstrap_difference", f"{SCORES}, {_BOOT}, r AS (SELECT corr(loyalty_score, spillover_score) - corr(loyalty_raw, activity) AS d FROM bs GROUP BY rep) SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM r")
def bootstrap_difference(spark, d):
    n = scores(spark, d).select("entity", "loyalty_score", "spillover_score", "loyalty_raw", F.col("activity").cast("double").alias("activity"))
    return r6(RS.paired_difference(spark, n, ("loyalty_score", "spillover_score"), ("loyalty_raw", "activity")), "mean", "lo", "hi")


_MET = {"r": "abs(r) < 0.5", "chi2_p": "chi2 > 3.841458820694124", "z_loyalty": "z_loyalty < 0", "z_spillover": "z_spillover > 0"}
_STATS = f"""{SCORES}, {SHARES}, dv AS (SELECT entity, -sum(share * ln(share)) / ln(5) AS dv FROM sh GROUP BY entity), n2 AS (SELECT entity, loyalty_score AS l, spillover_score AS s, activity::DOUBLE AS a, coalesce(dv, 0) AS d FROM n LEFT JOIN dv USING (entity)),
 {_BOOT.replace("FROM n)", "FROM n2)").replace("FROM n),", "FROM n2),")}, al AS (SELECT * FROM bs UNION ALL SELECT -1, * FROM n2),
 rk AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY l) + (count(*) OVER (PARTITION BY rep, l) - 1) / 2.0 AS rl, rank() OVER (PARTITION BY rep ORDER BY s) + (count(*) OVER (PARTITION BY rep, s) - 1) / 2.0 AS rs FROM al),
 cv AS (SELECT rep, corr(l, s) AS r, corr(rl, rs) AS rho, {', '.join(f'covar_pop({x}, {y}) AS {x}{y}' for x, y in ('ll', 'ls', 'la', 'ss', 'sa', 'aa', 'dl', 'ds', 'dd'))}, count(*) FILTER (l >= 0.5 AND s >= 0.5) AS p, count(*) FILTER (l >= 0.5 AND s < 0.5) AS q, count(*) FILTER (l < 0.5 AND s >= 0.5) AS u, count(*) FILTER (l < 0.5 AND s < 0.5) AS v FROM rk GROUP BY rep),
 st AS (SELECT rep, r, rho, (ls * aa - sa * la) / nullif(ll * aa - la * la, 0) AS mr_loyalty, (sa * ll - ls * la) / nullif(ll * aa - la * la, 0) AS mr_activity, (dl * ss - ds * ls) / nullif(ll * ss - ls * ls, 0) AS z_loyalty, (ds * ll - dl * ls) / nullif(ll * ss - ls * ls, 0) AS z_spillover, dl, ds, dd,
  (p + q + u + v)::DOUBLE * greatest(abs(p * v - q * u)::DOUBLE - (p + q + u + v) / 2, 0) ** 2 / nullif(((p + q) * (u + v) * (p + u) * (q + v))::DOUBLE, 0) AS chi2 FROM cv), sx AS (SELECT *, (z_loyalty * dl + z_spillover * ds) / nullif(dd, 0) AS z_r2 FROM st)"""
_SHOWN = ("r", "rho", "mr_loyalty", "mr_activity", "z_loyalty", "z_spillover", "z_r2")


@query("bootstrap_all", f"{_STATS} " + " UNION ALL ".join(f"SELECT '{c}' AS statistic, round(any_value({c}) FILTER (rep = -1), 5) AS point, round(quantile_cont({c}, 0.025) FILTER (rep >= 0), 5) AS lo, round(quantile_cont({c}, 0.975) FILTER (rep >= 0), 5) AS hi, " + (f"round(count(*) FILTER (rep >= 0 AND {_MET[c]}) / 2000, 6)" if c in _MET else "NULL::DOUBLE") + " AS share FROM sx" for c in _SHOWN) + f" UNION ALL SELECT 'chi2_p', NULL, NULL, NULL, round(count(*) FILTER (rep >= 0 AND {_MET['chi2_p']}) / 2000, 6) FROM sx")
def bootstrap_all(spark, d):
    """All statistics over 2000 draws of entities; p of the chi-square is left out where SQL has no such function."""
    w = keep(S.tag_hits(bullets(spark, d), THEMES).groupBy("entity", "tag").agg(F.count("*").alias("n")), "tags")
    diverse = S.entropy(w, "entity", "n", len(THEMES)).withColumnRenamed("entropy", "diversity")
    n = scores(spark, d).select("entity", F.col("loyalty_score").alias("loyalty"), F.col("spillover_score").alias("spillover"), F.col("activity").cast("double").alias("activity"))
    out = RS.bootstrap_all(spark, keep(n.join(diverse, "entity", "left").na.fill(0.0, ["diversity"]), "entities"))
    shown = F.col("statistic") != "chi2_p"
    return out.select("statistic", *[F.round(F.when(shown, F.col(c)), 5).alias(c) for c in ("point", "lo", "hi")], F.round("share", 6).alias("share"))


@query("reduced_r")
def reduced_r(spark, d):
    """The correlation of both scores over 1000 random reductions of every list to half."""
    s = keep(S.item_scores(bullets(spark, d)).groupBy("entity", "kind", "score10").agg(F.count("*").alias("k")), "by_score")
    n = s.groupBy("entity", "kind").agg(F.sum("k").alias("n"))
    return RS.reduced_r(s, RS.target_counts(n, n.limit(0), 0.5))


@query("reduced_scores", f"WITH {ITEMS}, {SCORED}, w AS (SELECT entity, kind, greatest(1, round_even(count(*) * 0.5, 0))::BIGINT AS n FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity, kind ORDER BY {_DRAW.format("bullet_id::VARCHAR || '|0|0'")}, bullet_id) AS k FROM s) SELECT entity, coalesce(sum(score10) FILTER (kind = 'loyalty'), 0) / 10.0::DOUBLE AS loyalty_raw, coalesce(sum(score10) FILTER (kind = 'spillover'), 0) / 10.0::DOUBLE AS spillover_raw, count(*) FILTER (kind = 'loyalty') AS n_loyalty, count(*) FILTER (kind = 'spillover') AS n_spillover, count(*) AS activity FROM r JOIN w USING (entity, kind) WHERE k <= n GROUP BY entity")
def reduced_scores(spark, d):
    """Entity scores over half of every list, drawn without replacement."""
    b = bullets(spark, d)
    n = b.groupBy("entity", "kind").agg(F.count("*").alias("n"))
    wanted = RS.target_counts(n, n.limit(0), 0.5)
    return S.entity_scores(RS.reduce_to(b, wanted, 0))


@query("audit_sample", f"WITH {ITEMS} SELECT bullet_id, t FROM b WHERE NOT {any_word('t', [w for ws in THEMES.values() for w in ws])} ORDER BY {_DRAW.format("bullet_id::VARCHAR || '|7'")}, bullet_id LIMIT 200")
def audit_sample(spark, d):
    """200 items without any tag, drawn by hash, for review."""
    b = bullets(spark, d)
    none = b.where(~T.any_of(F.col("t"), [w for ws in THEMES.values() for w in ws])).select("bullet_id", "t")
    return RS.seeded_sample(none, "bullet_id", 200, 7)


@query("unmatched_hints", f"WITH {ITEMS} SELECT h AS hint, count(*) AS n FROM b, (SELECT unnest(['도서관', 'library', '레코', '숲']) AS h) WHERE NOT {any_word('t', [w for ws in THEMES.values() for w in ws])} AND contains(t, h) AND h <> '레코' GROUP BY h")
def unmatched_hints(spark, d):
    """Items without a tag that hold a hint word which is near no dictionary word."""
    known = [w for ws in THEMES.values() for w in ws]
    hints = I.near_miss(["도서관", "library", "레코", "숲"], known)
    return bullets(spark, d).where(~T.any_of(F.col("t"), known)).select(F.explode(T.hits(F.col("t"), hints)).alias("hint")).groupBy("hint").agg(F.count("*").alias("n"))


# --- checks, charts, streams ---


@query(
    "integrity_report",
    f"""{SCORES}, {SHARES} SELECT 'items have ids' AS label, count(*) = count(DISTINCT bullet_id) AS ok FROM b UNION ALL SELECT 'places are unique', count(*) = count(DISTINCT (entity, kind, idx)) FROM b UNION ALL SELECT 'kinds add up', bool_and(n_loyalty + n_spillover = activity) FROM n
  UNION ALL SELECT 'shares add up', bool_and(abs(t - 1) <= 0.001) FROM (SELECT sum(share) AS t FROM sh GROUP BY entity) UNION ALL SELECT 'scores are scaled', bool_and(loyalty_score BETWEEN 0 AND 1) FROM n UNION ALL SELECT 'corpus is on the roster', (SELECT count(*) FROM (SELECT entity FROM fandoms_v3_100 EXCEPT SELECT entity FROM roster_history)) = 0
  UNION ALL SELECT 'rounds follow each other', (SELECT count(*) FROM (SELECT before_total, lag(after_total) OVER (ORDER BY nullif(regexp_extract(stage, 'r([0-9]+)', 1), '')::INT) AS p FROM growth_history) WHERE p <> before_total) = 0""",
)
def integrity_report(spark, d):
    b, n = bullets(spark, d), scores(spark, d)
    return C.report(
        C.unique(b, "items have ids", "bullet_id"),
        C.unique(b, "places are unique", "entity", "kind", "idx"),
        C.sums_to(n, "kinds add up", F.col("n_loyalty") + F.col("n_spillover"), F.col("activity")),
        C.shares_sum_to_one(shares(spark, d), "shares add up", "entity", "share"),
        C.no_rows(n.where(~F.col("loyalty_score").between(0, 1)), "scores are scaled"),
        C.no_rows(R.only(b.select("entity").distinct(), table(spark, d, "roster_history"), "entity"), "corpus is on the roster"),
        C.no_rows(L.growth(table(spark, d, "growth_history")).where("gap is not null"), "rounds follow each other"),
    ).select("label", "ok")


@query("inclusion", "WITH e AS (SELECT DISTINCT entity FROM roster_history) SELECT count(*) AS n, count(*) FILTER (entity IN (SELECT entity FROM documents WHERE entity IS NOT NULL)) AS inside, round(count(*) FILTER (entity IN (SELECT entity FROM documents WHERE entity IS NOT NULL)) / count(*), 6) AS share FROM e")
def inclusion(spark, d):
    return r6(C.inclusion(table(spark, d, "roster_history").select("entity").distinct(), table(spark, d, "documents").where("entity is not null"), ["entity"]), "share")


@query("tag_panels", f"WITH {ITEMS}, {THEME_HITS}, h AS (SELECT entity, {', '.join(f'''count(*) FILTER (tag = '{x}') AS {x}''' for x in THEMES)} FROM hits GROUP BY entity), e AS (SELECT DISTINCT entity FROM b), j AS (SELECT entity, {', '.join(f'coalesce({x}, 0) AS {x}' for x in THEMES)} FROM e LEFT JOIN h USING (entity)), r AS (SELECT *, row_number() OVER (ORDER BY {' + '.join(THEMES)} DESC, entity)::INT AS place FROM j) SELECT *, ceil(place / 50.0)::INT AS panel FROM r")
def tag_panels(spark, d):
    b = bullets(spark, d)
    wide = I.tags_as_columns(b, S.tag_hits(b, THEMES), list(THEMES))
    return R.two_panels(wide, (F.col("pledge") + F.col("tree") + F.col("travel") + F.col("music") + F.col("food")).desc(), F.asc("entity"))


@query("tag_ranking", f"WITH {ITEMS}, {THEME_HITS} SELECT tag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM hits GROUP BY tag")
def tag_ranking(spark, d):
    n = S.tag_hits(bullets(spark, d), THEMES).groupBy("tag").agg(F.count("*").alias("n"))
    return r6(n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("tag", "n", (F.col("n") / F.col("all")).alias("share")), "share")


@query("score_outliers", f"{SCORES}, m AS (SELECT avg(loyalty_score) AS mx, avg(spillover_score) AS my FROM n) SELECT entity, round((loyalty_score - mx) ** 2 + (spillover_score - my) ** 2, 6) AS dist2 FROM n, m ORDER BY (loyalty_score - mx) ** 2 + (spillover_score - my) ** 2 DESC, entity LIMIT 4")
def score_outliers(spark, d):
    return r6(R.farthest(scores(spark, d), "loyalty_score", "spillover_score").select("entity", "dist2"), "dist2")


@query("radar_points", f"{SCORES}, p AS (SELECT entity, unnest([{{'axis': 'loyalty_score', 'r': loyalty_score, 'i': 0}}, {{'axis': 'spillover_score', 'r': spillover_score, 'i': 1}}, {{'axis': 'activity', 'r': activity::DOUBLE, 'i': 2}}]) AS p FROM n) SELECT entity, p.axis AS axis, round(greatest(0, least(1, p.r)) * cos(-1.5707963267948966 + p.i * (6.283185307179586 / 3)), 6) + 0.0 AS x, round(greatest(0, least(1, p.r)) * sin(-1.5707963267948966 + p.i * (6.283185307179586 / 3)), 6) + 0.0 AS y FROM p")
def radar_points(spark, d):
    r = R.radar(scores(spark, d).withColumn("activity", F.col("activity").cast("double")), ["loyalty_score", "spillover_score", "activity"], 1.0)
    return r.select("entity", "axis", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


_HOURS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query("event_windows", _HOURS)
def event_windows(spark, d):
    return rounds.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("event_stream", f"SELECT * FROM ({_HOURS}) WHERE start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 10 minutes")
def event_stream(spark, d):
    """The same windows as a stream with a watermark, run over what there is and written in append mode to the shared folder; the last windows stay open."""
    import uuid

    from ..runtime import shared_dir

    at = f"{shared_dir(spark)}/brindle-stream-{uuid.uuid4().hex[:10]}"
    src = rounds.read_events(spark, d, table(spark, d, "events").schema)
    rounds.windowed(src.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("total", F.round("total", 4))
