"""The queries of the nine problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import spread
from ..runtime import table as _table
from . import increments, languages, leaks, lookalikes, mixing, multiset, neardup, sentences, terms

QUERIES = {}
SQL = {}


def table(spark, d, name):
    return spread(_table(spark, d, name))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("p2_found")
def p2_found(spark, d):
    return lookalikes.same_looking_pairs(table(spark, d, "fandoms_v3_100"))


@query("p2_canonical")
def p2_canonical(spark, d):
    return lookalikes.canonical(table(spark, d, "fandoms_v3_100"))


@query("p3_found")
def p3_found(spark, d):
    t = table(spark, d, "fandoms_v3_100")
    return multiset.copy_pairs(t.where(F.length("t") > 0))


@query("p3_copies")
def p3_copies(spark, d):
    return multiset.copies(table(spark, d, "fandoms_v3_100"))


@query("p4_found")
def p4_found(spark, d):
    return neardup.alike_pairs(table(spark, d, "fandoms_v3_100"))


@query("p4_classes")
def p4_classes(spark, d):
    return neardup.classes(table(spark, d, "fandoms_v3_100"))


@query("p5_found")
def p5_found(spark, d):
    return p5_verdicts(spark, d).where("verdict <> 'new'").select("cand_id")


@query("p5_verdicts")
def p5_verdicts(spark, d):
    return increments.verdicts(table(spark, d, "fandoms_v3_100"), table(spark, d, "merge_log_r71"))


_TERMS = """
SELECT {select} FROM (
  SELECT 't' AS field, term, count(*) AS uses, count(DISTINCT bullet_id) AS records, (SELECT count(*) FROM fandoms_v3_100) AS n
  FROM (SELECT bullet_id, unnest(regexp_extract_all(lower(replace(t, 'İ', 'i̇')), '[가-힣]{{2,}}|[a-zß-öø-ɏḀ-ỿ]{{2,}}')) AS term FROM fandoms_v3_100) GROUP BY term
  UNION ALL
  SELECT 'top_30.word', term, count(*), count(DISTINCT cloud_id), (SELECT count(*) FROM wordcloud_by_language_v7)
  FROM (SELECT cloud_id, lower(replace(trim(x.word), 'İ', 'i̇')) AS term FROM (SELECT cloud_id, unnest(top_30) AS x FROM wordcloud_by_language_v7)) WHERE term <> '' GROUP BY term
) {where}"""


@query("p6_found", _TERMS.format(select="field, term, CASE WHEN records = 1 THEN 'rare' ELSE 'common' END AS mark", where="WHERE records = 1 OR records > 0.08 * n"))
def p6_found(spark, d):
    return p6_terms(spark, d).where("mark is not null").select("field", "term", "mark")


@query("p6_terms", _TERMS.format(select="field, term, uses, records, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.08 * n THEN 'common' END AS mark", where=""))
def p6_terms(spark, d):
    t = terms.frequencies(table(spark, d, "fandoms_v3_100"), "t").select(F.lit("t").alias("field"), "*")
    w = terms.frequencies(table(spark, d, "wordcloud_by_language_v7"), "top_30", words=True).select(F.lit("top_30.word").alias("field"), "*")
    return t.unionByName(w)


@query("p7_found")
def p7_found(spark, d):
    return p7_leaks(spark, d).where("leaked").select("doc_id", "item_id")


@query("p7_leaks")
def p7_leaks(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p9_found")
def p9_found(spark, d):
    return p9_sentences(spark, d).select("doc_id", "start_pos", "end_pos").distinct()


@query("p9_sentences")
def p9_sentences(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"))


@query("p1_found")
def p1_found(spark, d):
    return p1_stretches(spark, d).where("n_segs > 1 or declared is null or declared <> lang").select("bullet_id", "seg_no", "lang").distinct()


@query("p1_stretches")
def p1_stretches(spark, d):
    return languages.stretches(table(spark, d, "fandoms_v3_100"))


@query("p8_mix")
def p8_mix(spark, d):
    return mixing.mixtures(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p8_shares")
def p8_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))
