"""Comparisons: of definitions, snapshots, models and dictionaries with each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from .stats import average_rank, corr
from .topics import match_best


def by_round(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables with a column `round` joined on the number and suffix that the names stand for, whatever stands around these."""
    k = lambda df, n: df.withColumn("_k", T.round_key(F.col("round"))).withColumnRenamed("round", n)
    x, y = k(a, "round_a").withColumnRenamed("_k", "_ka"), k(b, "round_b").withColumnRenamed("_k", "_kb")
    return x.join(y, (F.col("_ka.n") == F.col("_kb.n")) & (F.col("_ka.suffix") == F.col("_kb.suffix"))).drop("_ka", "_kb")


def best_overlap(a: DataFrame, b: DataFrame, key: str, group: str, other: bool = False) -> DataFrame:
    """(key, match, common): of the word lists of b in the same group the one that shares most words with a list of a, ties to the least key.

    Lists meet by their words, so lists without a common word never do. With `other` a list isn't matched with the one of its own key. Inputs: (key, group, words).
    """
    x = a.select(group, F.col(key), F.explode(F.array_distinct("words")).alias("w"))
    y = b.select(group, F.col(key).alias("match"), F.explode(F.array_distinct("words")).alias("w"))
    met = x.join(y, [group, "w"])
    n = (met.where(F.col(key) != F.col("match")) if other else met).groupBy(key, "match").agg(F.count("*").alias("common"))
    return n.groupBy(key).agg(F.min_by("match", F.struct(-F.col("common"), F.col("match"))).alias("match"), F.max("common").alias("common"))


def correlations(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(x, y, r) for pairs of columns, in one pass; null where a column doesn't vary."""
    one = df.agg(*[corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def by_factor(a: DataFrame, b: DataFrame) -> DataFrame:
    """(factor, n, r) of two share tables (entity, factor, share) over their common entities; absent shares count 0, r is null without variance."""
    both = a.select("entity").distinct().join(b.select("entity").distinct(), "entity")
    factors = a.select("factor").union(b.select("factor")).distinct()
    grid = both.join(F.broadcast(factors))  # a handful of factors
    j = grid.join(a.withColumnRenamed("share", "x"), ["entity", "factor"], "left").join(b.withColumnRenamed("share", "y"), ["entity", "factor"], "left").na.fill(0.0, ["x", "y"])
    return j.groupBy("factor").agg(F.count("*").alias("n"), corr("x", "y").alias("r"))


def definitions(df: DataFrame, original: str, *others: str, count: str, k: int = 15) -> DataFrame:
    """(definition, r_count, rho, top_overlap) of alternative scores of entities: their correlation with a count, and rank correlation and common top k with the original."""
    out = None
    for c in others:
        d = df.select("entity", F.col(original).alias("x"), F.col(c).alias("y"), F.col(count).cast("double").alias("n")).where("x is not null and y is not null")
        r = average_rank(average_rank(d, "x", "rx"), "y", "ry").agg(corr("y", "n").alias("r_count"), corr("rx", "ry").alias("rho"))
        top = lambda v: d.orderBy(F.desc(v), "entity").limit(k).select("entity")  # noqa: B023, E731
        row = r.join(F.broadcast(top("x").join(top("y"), "entity").agg(F.count("*").alias("top_overlap")))).select(F.lit(c).alias("definition"), "r_count", "rho", "top_overlap")
        out = row if out is None else out.unionByName(row)
    return out


def label_check(labels: DataFrame, words: DataFrame, n: int = 10) -> DataFrame:
    """(key, n_words, found, ok): how many of a label's bracketed words are among the key's first n words."""
    j = labels.join(words, "key").withColumn("_w", T.label_words(F.col("label")))
    found = F.size(F.array_intersect("_w", F.slice("words", 1, n)))
    return j.select("key", F.size("_w").alias("n_words"), found.alias("found"), (found == F.size("_w")).alias("ok"))


def frequency_language(items: DataFrame, frequencies: DataFrame, key: str = "bullet_id") -> DataFrame:
    """(key, lang, margin) of Latin text: the language of the greatest mean word frequency, unknown words counting 0, and its lead over the second; ties to the first code.

    frequencies has (word, lang, zipf). Words are joined, not looked up at the driver, so the table may be large.
    """
    w = items.select(key, F.explode(T.find_all(F.lower("t"), "[a-z\\u00c0-\\u024f\\u1e00-\\u1eff]{2,}")).alias("word"))
    n = w.groupBy(key).agg(F.count("*").alias("_n"))
    s = w.join(frequencies, "word").groupBy(key, "lang").agg(F.sum("zipf").alias("_s")).join(n, key).select(key, "lang", (F.col("_s") / F.col("_n")).alias("score"))
    r = s.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.round("score", 6).desc(), "lang")))  # a row a language
    return r.where("_r <= 2").groupBy(key).agg(F.min_by("lang", "_r").alias("lang"), (F.max("score") - F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("score"))), F.lit(0.0))).alias("margin"))


def body_languages(items: DataFrame, frequencies: DataFrame, key: str = "bullet_id") -> DataFrame:
    """(key, body): the language of every text by its script, of Latin text by letters of its own or else by word frequencies; en where no word is known."""
    b = items.select(key, "t", U.body_language(F.col("t")).alias("_script"))
    by_words = frequency_language(b.where("_script = 'latin'"), frequencies, key).select(key, F.col("lang").alias("_lang"))
    return b.join(by_words, key, "left").select(key, F.when(F.col("_script") != "latin", F.col("_script")).otherwise(F.coalesce("_lang", F.lit("en"))).alias("body"))


def corpus_fingerprint(items: DataFrame, score: Column) -> DataFrame:
    """(entity, n_loyalty, n_spillover, score10): what a candidate corpus is compared by."""
    one = lambda k: F.count_if(F.col("kind") == k)
    return items.groupBy("entity").agg(one("loyalty").alias("n_loyalty"), one("spillover").alias("n_spillover"), F.sum(score).alias("score10"))


def corpus_check(candidate: DataFrame, expected: DataFrame) -> DataFrame:
    """(entity, verdict) of two fingerprints: missing, new, counts, score, or same."""
    j = candidate.alias("c").join(expected.alias("e"), "entity", "full_outer")
    same = lambda k: F.col(f"c.{k}") == F.col(f"e.{k}")
    v = F.when(F.col("c.score10").isNull(), "missing").when(F.col("e.score10").isNull(), "new").when(~(same("n_loyalty") & same("n_spillover")), "counts").when(~same("score10"), "score").otherwise("same")
    return j.select("entity", v.alias("verdict"))


def align(words_a: list[list[str]], phi_a: dict[str, np.ndarray], words_b: list[list[str]], phi_b: dict[str, np.ndarray]) -> list[tuple[int, int, float, float, int, bool]]:
    """Topics of two models: (topic, nearest, jaccard, cosine, partner, mutual).

    jaccard is that of the top words of the nearest topic, cosine that of the weights over the common vocabulary, and
    partner the topic of the one-to-one matching with the greatest sum of cosines. phi maps words to weights by topic.
    """
    jac = np.array([[len(set(x) & set(y)) / max(1, len(set(x) | set(y))) for y in words_b] for x in words_a])
    common = sorted(phi_a.keys() & phi_b.keys())
    a, b = (np.array([p[w] for w in common]).T for p in (phi_a, phi_b))
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cos = norm(a) @ norm(b).T
    partner = dict(match_best(cos))
    out = []
    for i in range(len(words_a)):
        j = int(cos[i].argmax())
        out.append((i, j, float(jac[i, j]), float(cos[i, j]), partner.get(i, -1), int(cos[:, j].argmax()) == i))
    return out


def compare_fits(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, d_perplexity, d_coherence, d_diversity, d_stability) of two grids of model measures."""
    cols = ("perplexity", "coherence", "diversity", "stability")
    j = a.alias("a").join(b.alias("b"), "k")
    return j.select("k", *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"d_{c}") for c in cols])
