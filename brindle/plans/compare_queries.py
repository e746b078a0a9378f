"""Queries that compare definitions, rounds, dictionaries and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import text as T
from ..functions import urls as U
from ..functions import values as V
from ..operators import compare as CP
from ..operators import indices as I
from ..operators import lineage as L
from ..operators import scoring as S
from ..operators import stats as ST
from ..operators import tables as R
from ..runtime import keep, table
from ..sources.corpus import bullets
from .base import CODE, FACTORS, ITEMS, SCORED, SCORES, THEME_HITS, THEMES, lower, strings
from .entity_queries import r6, scores
from .text_queries import _BODY, _COUNTED, _WORDS, _tokens

_N = "nullif(regexp_extract({0}, 'r([0-9]+)', 1), '')::INT"
_SFX = "CASE regexp_extract({0}, 'r[0-9]+_(p2|2ch)', 1) WHEN 'p2' THEN 1 WHEN '2ch' THEN 2 ELSE 0 END"


@query("round_join", f"WITH e AS (SELECT entered_round AS round, count(*) AS entered FROM roster_history WHERE entered_round <> 'initial' GROUP BY 1) SELECT e.round AS round_a, g.stage AS round_b, entered, net_new_bullets FROM e JOIN growth_history g ON {_N.format('e.round')} = {_N.format('g.stage')} AND {_SFX.format('e.round')} = {_SFX.format('g.stage')}")
def round_join(spark, d):
    e = table(spark, d, "roster_history").where("entered_round <> 'initial'").groupBy(F.col("entered_round").alias("round")).agg(F.count("*").alias("entered"))
    return CP.by_round(e, table(spark, d, "growth_history").select(F.col("stage").alias("round"), "net_new_bullets"))


_CW = f"SELECT cloud_id, entity, unnest(list_distinct(list_filter(list_transform(coalesce(top_30, []), lambda x: trim({lower('x.word')})), lambda w: w IS NOT NULL AND w <> ''))) AS w FROM wordcloud_by_language_v7"


def _cloud(spark, d):
    words = F.array_distinct(F.filter(F.transform(F.coalesce("top_30", F.array().cast("array<struct<word:string,n:bigint>>")), lambda x: F.trim(F.lower(x["word"]))), lambda w: w.isNotNull() & (w != "")))
    return table(spark, d, "wordcloud_by_language_v7").select("cloud_id", "entity", "bucket", words.alias("words"))


@query("cloud_best_match", f"WITH c AS ({_CW}), a AS (SELECT * FROM c WHERE cloud_id % 2 = 0), o AS (SELECT * FROM c WHERE cloud_id % 2 = 1), n AS (SELECT a.cloud_id, o.cloud_id AS m, count(*) AS common FROM a JOIN o USING (entity, w) GROUP BY ALL) SELECT cloud_id, first(m ORDER BY common DESC, m) AS match, max(common) AS common FROM n GROUP BY cloud_id")
def cloud_best_match(spark, d):
    """Of the even-numbered clouds the odd-numbered one of the entity that shares most words."""
    c = _cloud(spark, d)
    return CP.best_overlap(c.where("cloud_id % 2 = 0"), c.where("cloud_id % 2 = 1"), "cloud_id", "entity")


@query("cloud_best_of_all", f"WITH c AS ({_CW}), n AS (SELECT a.cloud_id, o.cloud_id AS m, count(*) AS common FROM c a JOIN c o ON a.entity = o.entity AND a.w = o.w AND a.cloud_id <> o.cloud_id GROUP BY ALL) SELECT cloud_id, first(m ORDER BY common DESC, m) AS match, max(common) AS common FROM n GROUP BY cloud_id")
def cloud_best_of_all(spark, d):
    """Of every cloud the other one of the entity that shares most words."""
    c = _cloud(spark, d)
    return CP.best_overlap(c, c, "cloud_id", "entity", other=True)


@query("growth_correlation", "WITH g AS (SELECT *, nullif(regexp_extract(stage, 'r([0-9]+)', 1), '')::INT AS n FROM growth_history WHERE net_new_bullets IS NOT NULL) SELECT round(corr(after_total, net_new_bullets), 6) AS r, round(last(after_total ORDER BY n) / first(before_total ORDER BY n)::DOUBLE - 1, 6) AS growth FROM g")
def growth_correlation(spark, d):
    g = table(spark, d, "growth_history").where("net_new_bullets is not null").withColumn("n", T.round_key(F.col("stage"))["n"])
    return r6(g.agg(ST.corr("after_total", "net_new_bullets").alias("r"), (F.max_by("after_total", "n") / F.min_by("before_total", "n") - 1).alias("growth")), "r", "growth")


_CORR = [("n_loyalty", "n_spillover"), ("loyalty_score", "n_loyalty"), ("spillover_score", "n_spillover"), ("loyalty_score", "spillover_score")]


@query("count_diagnostics", f"{SCORES} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM n" for a, b in _CORR))
def count_diagnostics(spark, d):
    return r6(CP.correlations(scores(spark, d), *_CORR), "r")


def _kind_shares(spark, d, kind):
    m = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    w = S.tag_hits(bullets(spark, d).where(F.col("kind") == kind), THEMES).groupBy("entity", m[F.col("tag")].alias("factor")).agg(F.count("*").alias("w"))
    return w.select("entity", "factor", (F.col("w") / F.sum("w").over(Window.partitionBy("entity"))).alias("share"))


@query("factor_correlation", f"WITH {ITEMS}, {THEME_HITS}, f AS (SELECT entity, kind, CASE tag {' '.join(f'''WHEN '{t}' THEN '{x}' ''' for t, x in FACTORS.items())} END AS factor, count(*) AS w FROM hits GROUP BY ALL), s AS (SELECT entity, kind, factor, w / sum(w) OVER (PARTITION BY entity, kind) AS share FROM f), tw AS (SELECT entity FROM s GROUP BY entity HAVING count(DISTINCT kind) = 2), g AS (SELECT entity, factor, coalesce(a.share, 0) AS x, coalesce(o.share, 0) AS y FROM tw CROSS JOIN (SELECT DISTINCT factor FROM s) LEFT JOIN (SELECT * FROM s WHERE kind = 'loyalty') a USING (entity, factor) LEFT JOIN (SELECT * FROM s WHERE kind = 'spillover') o USING (entity, factor)) SELECT factor, count(*) AS n, round(corr(x, y), 6) AS r FROM g GROUP BY factor")
def factor_correlation(spark, d):
    return r6(CP.by_factor(_kind_shares(spark, d, "loyalty"), _kind_shares(spark, d, "spillover")), "r")


@query("definition_comparison", f"{SCORES}, q AS (SELECT entity, loyalty_score AS x, activity::DOUBLE AS n, loyalty_raw / nullif(n_loyalty, 0) AS density, spillover_score AS spill FROM n), k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS definition, corr(y, n) AS r_count, corr(rx, ry) AS rho, count(*) FILTER (tx <= 15 AND ty <= 15) AS top_overlap FROM (SELECT *, {c} AS y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS ry, row_number() OVER (ORDER BY x DESC, entity) AS tx, row_number() OVER (ORDER BY {c} DESC, entity) AS ty FROM q WHERE x IS NOT NULL AND {c} IS NOT NULL)" for c in ("density", "spill")) + ") SELECT definition, round(r_count, 6) AS r_count, round(rho, 6) AS rho, top_overlap FROM k")
def definition_comparison(spark, d):
    n = keep(scores(spark, d), "scores").withColumn("density", F.col("loyalty_raw") / F.nullif(F.col("n_loyalty"), F.lit(0))).withColumnRenamed("spillover_score", "spill")
    return r6(CP.definitions(n, "loyalty_score", "density", "spill", count="activity"), "r_count", "rho")


@query("pearson_without", f"{SCORES}, t AS (SELECT entity FROM n ORDER BY loyalty_raw + spillover_raw DESC, entity LIMIT 1), p AS (SELECT count(*) AS n, corr(loyalty_score, spillover_score) AS r FROM n WHERE entity NOT IN (SELECT entity FROM t)) SELECT n, round(r, 6) AS r, abs(r) < 0.5 AS distinct_enough FROM p")
def pearson_without(spark, d):
    """The correlation without the highest scored entity, and whether it leaves the two scores distinct."""
    n = scores(spark, d)
    first = R.top(n.select("entity", (F.col("loyalty_raw") + F.col("spillover_raw")).alias("s")), 1, F.desc("s"), F.asc("entity"))
    p = ST.pearson(R.only(n, first, "entity"), "loyalty_score", "spillover_score")
    return p.select("n", F.round("r", 6).alias("r"), (F.abs("r") < 0.5).alias("distinct_enough"))


@query("label_check", f"WITH c AS (SELECT cloud_id, list_distinct(list_filter(list_transform(coalesce(top_30, []), lambda x: trim({lower('x.word')})), lambda w: w IS NOT NULL AND w <> '')) AS ws FROM wordcloud_by_language_v7), l AS (SELECT *, ['fandom', 'fanclub', 'chart'] AS lw FROM c) SELECT cloud_id AS key, 3 AS n_words, len(list_intersect(lw, list_slice(list_transform(ws, lambda x: x), 1, 10)))::INT AS found, len(list_intersect(lw, list_slice(ws, 1, 10))) = 3 AS ok FROM l".replace("list_distinct(list_filter", "list_filter").replace(" <> '')) AS ws", " <> '') AS ws"))
def label_check(spark, d):
    words = F.filter(F.transform(F.coalesce("top_30", F.array().cast("array<struct<word:string,n:bigint>>")), lambda x: F.trim(F.lower(x["word"]))), lambda w: w.isNotNull() & (w != ""))
    c = table(spark, d, "wordcloud_by_language_v7").select(F.col("cloud_id").alias("key"), words.alias("words"))
    return CP.label_check(c.select("key", F.lit("결속(fandom·fanclub·chart)").alias("label")), c)


@query("corpus_check", f"WITH {ITEMS}, {SCORED}, e AS (SELECT entity, count(*) FILTER (kind = 'loyalty') AS l, count(*) FILTER (kind = 'spillover') AS p, sum(score10) AS s FROM s GROUP BY entity), c AS (SELECT entity, count(*) FILTER (kind = 'loyalty') AS l, count(*) FILTER (kind = 'spillover') AS p, sum(score10 + CASE WHEN bullet_id % 1000 = 1 THEN 1 ELSE 0 END) AS s FROM s WHERE bullet_id % 700 <> 3 GROUP BY entity) SELECT entity, CASE WHEN c.s IS NULL THEN 'missing' WHEN e.s IS NULL THEN 'new' WHEN c.l <> e.l OR c.p <> e.p THEN 'counts' WHEN c.s <> e.s THEN 'score' ELSE 'same' END AS verdict FROM c FULL JOIN e USING (entity)")
def corpus_check(spark, d):
    """A candidate corpus, with a few items missing and a few changed, against the expected one."""
    s = S.item_scores(bullets(spark, d))
    changed = s.where("bullet_id % 700 <> 3").withColumn("score10", F.col("score10") + F.when(F.col("bullet_id") % 1000 == 1, 1).otherwise(0))
    return CP.corpus_check(CP.corpus_fingerprint(changed, F.col("score10")), CP.corpus_fingerprint(s, F.col("score10")))


@query("homonym_audit", f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT '{w}' AS keyword, CASE WHEN regexp_matches(t, '{w}\\s*(집|배)') THEN 'common' WHEN regexp_matches(t, '{w}(에|에서|를|을) ') THEN 'place' ELSE 'uncertain' END AS class, count(*) AS n FROM b WHERE contains(t, '{w}') GROUP BY ALL" for w in ("나무", "역과", "골목")))
def homonym_audit(spark, d):
    t = F.col("t")
    words = F.array(*[F.when(F.contains(t, F.lit(w)), F.struct(F.lit(w).alias("keyword"), F.when(t.rlike(f"{w}\\s*(집|배)"), "common").when(t.rlike(f"{w}(에|에서|를|을) "), "place").otherwise("uncertain").alias("class"))) for w in ("나무", "역과", "골목")])
    return bullets(spark, d).select(F.explode(F.filter(words, lambda x: x.isNotNull())).alias("x")).groupBy("x.keyword", "x.class").agg(F.count("*").alias("n"))


@query("round_increments", f"WITH {ITEMS}, {SCORED}, i AS (SELECT entity, count(*) FILTER ({_N.format('added_round')} IN (2, 3)) AS added, sum(score10) AS score FROM s GROUP BY entity) SELECT round(corr(added, score), 6) AS r, (SELECT count(*) FROM (SELECT entity FROM i ORDER BY added DESC, entity LIMIT 10) JOIN (SELECT entity FROM i ORDER BY score DESC, entity LIMIT 10) USING (entity)) AS top_overlap FROM i")
def round_increments(spark, d):
    """Additions of two rounds against the scores they belong to."""
    s = S.item_scores(bullets(spark, d)).withColumn("n", T.round_key(F.col("added_round"))["n"])
    i = s.groupBy("entity").agg(F.count_if(F.col("n").isin(2, 3)).alias("added"), F.sum("score10").alias("score"))
    both = R.top(i, 10, F.desc("added"), F.asc("entity")).select("entity").join(R.top(i, 10, F.desc("score"), F.asc("entity")).select("entity"), "entity")
    return i.agg(F.round(ST.corr("added", "score"), 6).alias("r")).join(F.broadcast(both.agg(F.count("*").alias("top_overlap"))))


_FREQ = "fw AS (SELECT lang, word, count(*) AS n FROM (SELECT {c} AS lang, unnest(regexp_extract_all({l}, '[a-z\\x{{00c0}}-\\x{{024f}}\\x{{1e00}}-\\x{{1eff}}]{{2,}}')) AS word FROM b) WHERE lang IN ('en', 'es', 'fr', 'id', 'vi', 'tl', 'pt', 'tr') GROUP BY ALL HAVING count(*) >= 5), fz AS (SELECT word, lang, round(log10(n * 1e9 / sum(n) OVER (PARTITION BY lang)), 2) AS zipf FROM fw)".format(c=CODE, l=lower("t"))


_SCORED_WORDS = f"w AS (SELECT bullet_id, unnest(regexp_extract_all({lower('t')}, '[a-z\\x{{00c0}}-\\x{{024f}}\\x{{1e00}}-\\x{{1eff}}]{{2,}}')) AS word FROM b), c AS (SELECT bullet_id, count(*) AS n FROM w GROUP BY 1), s AS (SELECT bullet_id, lang, sum(zipf) / n AS score FROM w JOIN fz USING (word) JOIN c USING (bullet_id) GROUP BY bullet_id, lang, n), r AS (SELECT *, row_number() OVER (PARTITION BY bullet_id ORDER BY round(score, 6) DESC, lang) AS k FROM s)"


@query("frequency_language", f"WITH {ITEMS}, {_FREQ}, {_SCORED_WORDS} SELECT bullet_id, max(lang) FILTER (k = 1) AS lang, floor((max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), 0)) * 100 + 1e-6)::INT AS margin FROM r WHERE k <= 2 GROUP BY bullet_id")
def frequency_language(spark, d):
    """Latin words scored by a frequency table, here made from the labelled items themselves."""
    b = bullets(spark, d)
    return CP.frequency_language(b, _zipf(b)).withColumn("margin", F.floor(F.col("margin") * 100 + 1e-6).cast("int"))


def _zipf(b):
    code = F.when(F.lower("lang").rlike("^[a-z]{2}(-[a-z]+)?$"), F.lower(F.substring("lang", 1, 2)))
    w = b.select(code.alias("lang"), F.explode(T.find_all(F.lower("t"), "[a-z\\u00c0-\\u024f\\u1e00-\\u1eff]{2,}")).alias("word")).where(F.col("lang").isin("en", "es", "fr", "id", "vi", "tl", "pt", "tr"))
    n = w.groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 5")
    return n.join(n.groupBy("lang").agg(F.sum("n").alias("all")), "lang").select("word", "lang", F.round(F.log10(F.col("n") * 1e9 / F.col("all")), 2).alias("zipf"))


@query("body_words", f"WITH {ITEMS}, {_FREQ}, {_SCORED_WORDS}, {_COUNTED.replace('c AS (', 'cc AS (', 1).replace('FROM c)', 'FROM cc)')}, h AS (SELECT bullet_id, {_BODY} AS script FROM c3) SELECT bullet_id, CASE WHEN script <> 'latin' THEN script ELSE coalesce(lang, 'en') END AS body FROM h LEFT JOIN (SELECT bullet_id, lang FROM r WHERE k = 1) USING (bullet_id)")
def body_words(spark, d):
    """Languages of bodies, those of Latin text by word frequencies."""
    b = bullets(spark, d)
    return CP.body_languages(b, _zipf(b))


@query("term_documents", f"WITH {ITEMS}, {_WORDS} SELECT term, count(*) AS df, sum(n)::BIGINT AS tf FROM (SELECT bullet_id, term, count(*) AS n FROM (SELECT bullet_id, unnest(words) AS term FROM w WHERE len(words) >= 3) GROUP BY ALL) GROUP BY term HAVING count(*) >= 2")
def term_documents(spark, d):
    """Document and term frequencies of the vocabulary."""
    t = _tokens(spark, d).where(F.size("words") >= 3).select("bullet_id", F.explode("words").alias("term"))
    return t.groupBy("term", "bullet_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).where("df >= 2")


@query("cloud_recount", f"WITH {ITEMS}, {_WORDS}, v AS (SELECT DISTINCT {lower('x')} AS word FROM (SELECT unnest(words) AS x FROM w)), c AS (SELECT bucket, w FROM (SELECT bucket, entity, w FROM (SELECT cloud_id, bucket FROM wordcloud_by_language_v7) JOIN ({_CW}) USING (cloud_id))) SELECT bucket, count(*) AS n, count(*) FILTER (w IN (SELECT word FROM v)) AS present, round(count(*) FILTER (w IN (SELECT word FROM v)) / count(*), 6) AS share FROM c GROUP BY bucket")
def cloud_recount(spark, d):
    """Top words of the clouds that an independent tokenization of the items finds too, by bucket."""
    v = _tokens(spark, d).select(F.explode("words").alias("w")).select(F.lower("w").alias("w")).distinct().withColumn("hit", F.lit(1))
    c = _cloud(spark, d).select("bucket", F.explode("words").alias("w"))
    return c.join(v, "w", "left").groupBy("bucket").agg(F.count("*").alias("n"), F.count("hit").alias("present"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


_LISTS = (("particles", V.PARTICLES), ("ko", V.STOP_KO), ("ko more", V.STOP_KO_MORE), ("en", V.STOP_EN), ("ru", V.STOP_RU))


@query("stop_lists", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS list, unnest({strings(ws)}) AS word, {i} AS o" for i, (n, ws) in enumerate(_LISTS)) + ") SELECT word, first(list ORDER BY o) AS list FROM l GROUP BY word")
def stop_lists(spark, d):
    """The lists of words in one table, a word in the first list that has it."""
    rows = [(n, w, i * 1000 + j) for i, (n, ws) in enumerate(_LISTS) for j, w in enumerate(ws)]
    return I.first_of_each(spark.createDataFrame(rows, "list string, word string, ord int"), ["word"], "ord").select("word", "list")


@query("first_examples", f"WITH {ITEMS} SELECT entity, kind, bullet_id, t FROM b QUALIFY row_number() OVER (PARTITION BY entity, kind ORDER BY idx) = 1")
def first_examples(spark, d):
    b = bullets(spark, d)
    return b.groupBy("entity", "kind").agg(F.min_by(F.struct("bullet_id", "t"), "idx").alias("x")).select("entity", "kind", "x.bullet_id", "x.t")


@query("score_timeline", f"WITH {ITEMS}, {SCORED}, q AS (SELECT {_N.format('added_round')} AS n, count(*) AS items, sum(score10)::BIGINT AS score10 FROM s WHERE added_round IS NOT NULL GROUP BY 1) SELECT n, items, score10, sum(items) OVER (ORDER BY n)::BIGINT AS cum, round(sum(items) OVER (ORDER BY n) / sum(items) OVER (), 6) AS cum_share FROM q")
def score_timeline(spark, d):
    s = S.item_scores(bullets(spark, d)).where("added_round is not null").groupBy(T.round_key(F.col("added_round"))["n"].alias("n")).agg(F.count("*").alias("items"), F.sum("score10").alias("score10"))
    return r6(L.cumulative(s, [F.col("n")], "items"), "cum_share")


@query("language_variants", f"WITH {ITEMS}, d AS (SELECT entity, {CODE} AS lang, count(*) AS n FROM b GROUP BY entity, {CODE}), dd AS (SELECT entity, n / sum(n) OVER (PARTITION BY entity) AS p FROM d WHERE lang IS NOT NULL), de AS (SELECT entity, -sum(p * ln(p)) / ln(14) AS declared FROM dd GROUP BY 1), k AS (SELECT entity, CASE WHEN regexp_matches(t, '[가-힣]') THEN 'ko' WHEN regexp_matches(t, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'ja' WHEN regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' WHEN regexp_matches(t, '[\\x{{0e00}}-\\x{{0e7f}}]') THEN 'th' ELSE 'en' END AS lang, count(*) AS n FROM b GROUP BY ALL), kp AS (SELECT entity, n / sum(n) OVER (PARTITION BY entity) AS p FROM k), ke AS (SELECT entity, -sum(p * ln(p)) / ln(14) AS script FROM kp GROUP BY 1) SELECT round(corr(declared, script), 6) AS r, round(avg(declared), 6) AS mean_declared, round(avg(script), 6) AS mean_script FROM de JOIN ke USING (entity)".replace("d AS (SELECT entity, " + CODE + " AS lang, count(*) AS n FROM b GROUP BY entity, " + CODE + ")", "d0 AS (SELECT entity, " + CODE + " AS code FROM b), d AS (SELECT entity, code AS lang, count(*) AS n FROM d0 GROUP BY entity, code)"))
def language_variants(spark, d):
    """Diversity of languages by declared label and by script of the text, and their correlation."""
    b = bullets(spark, d)
    code = F.when(F.lower("lang").rlike("^[a-z]{2}(-[a-z]+)?$"), F.lower(F.substring("lang", 1, 2)))
    e = lambda c, name: S.entropy(b.withColumn("_l", c).where("_l is not null").groupBy("entity", "_l").agg(F.count("*").alias("n")), "entity", "n", 14).withColumnRenamed("entropy", name)
    j = e(code, "declared").join(e(U.text_fallback(F.col("t")), "script"), "entity")
    return r6(j.agg(ST.corr("declared", "script").alias("r"), F.avg("declared").alias("mean_declared"), F.avg("script").alias("mean_script")), "r", "mean_declared", "mean_script")
