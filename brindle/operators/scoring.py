"""Evidence scores, min-max scores, quadrants, and the coverage index of entities."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..functions import values as V

def item_scores(items: DataFrame, bonus: dict[str, list[str]] | None = None) -> DataFrame:
    """Items with n_num, n_kw (distinct words present) and score10, the evidence score in tenths, an exact integer."""
    bonus = bonus or V.BONUS
    n_kw = F
    for kind, words in bonus.items():
        n_kw = n_kw.when(F.col("kind") == kind, reduce(lambda a, b: a + b, [T.has(F.col("t"), w).cast("int") for w in words]))
    w = V.SCORE_TENTHS
    out = items.withColumn("n_num", T.number_count(F.col("t"))).withColumn("n_kw", n_kw.otherwise(0))
    return out.withColumn("score10", w["item"] + w["number"] * F.col("n_num") + w["word"] * F.col("n_kw"))


def entity_scores(items: DataFrame) -> DataFrame:
    """(entity, loyalty_raw, spillover_raw, n_loyalty, n_spillover, activity): sums of the item scores by kind."""
    s = item_scores(items)
    one = lambda k: F.col("kind") == k
    return s.groupBy("entity").agg(
        *[(F.coalesce(F.sum(F.when(one(k), F.col("score10"))), F.lit(0)) / 10.0).alias(f"{k}_raw") for k in ("loyalty", "spillover")],
        *[F.count_if(one(k)).alias(f"n_{k}") for k in ("loyalty", "spillover")],
        F.count("*").alias("activity"),
    )


def with_minmax(df: DataFrame, **cols: str) -> DataFrame:
    """Columns scaled over the whole table, its extremes joined as one row rather than by a window without partition."""
    ends = df.agg(*[f(F.col(c)).alias(f"{n}_{e}") for n, c in cols.items() for e, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(ends))
    for n, c in cols.items():
        out = out.withColumn(n, (F.col(c) - F.col(f"{n}_lo")) / F.nullif(F.col(f"{n}_hi") - F.col(f"{n}_lo"), F.lit(0.0)))
    return out.drop(*[f"{n}_{e}" for n in cols for e in ("lo", "hi")])


def normalized(scores: DataFrame) -> DataFrame:
    return with_minmax(scores, loyalty_score="loyalty_raw", spillover_score="spillover_raw")


def quadrant(x: Column, y: Column, mx: Column, my: Column) -> Column:
    hi_x, hi_y = x >= mx, y >= my
    return F.when(hi_x & hi_y, "both").when(hi_x, "loyalty").when(hi_y, "spillover").otherwise("neither")


def quadrants(scores: DataFrame) -> DataFrame:
    """(entity, quadrant) by the means of both scores."""
    means = scores.agg(F.avg("loyalty_score").alias("ml"), F.avg("spillover_score").alias("ms"))
    return scores.join(F.broadcast(means)).select("entity", quadrant(F.col("loyalty_score"), F.col("spillover_score"), F.col("ml"), F.col("ms")).alias("quadrant"))


def entropy(counts: DataFrame, key: str, n: str, n_classes: int) -> DataFrame:
    """(key, entropy): Shannon entropy of counts over the logarithm of the declared number of classes; 0 for one class or none."""
    total = F.sum(n).over(Window.partitionBy(key))
    p = counts.where(F.col(n) > 0).withColumn("_p", F.col(n) / total)
    h = -F.sum(F.col("_p") * F.ln("_p"))
    e = p.groupBy(key).agg((h / F.lit(float(math.log(n_classes))) if n_classes > 1 else F.lit(0.0)).alias("entropy"))
    return counts.select(key).distinct().join(e, key, "left").select(key, F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def tag_hits(items: DataFrame, tags: dict[str, list[str]], mode: str = "literal") -> DataFrame:
    """One row for each item and tag with a word in its text: the item's columns and tag."""
    found = F.array(*[F.when(T.any_of(F.col("t"), ws, mode), F.lit(tag)) for tag, ws in tags.items()])
    return items.withColumn("tag", F.explode(F.filter(found, lambda x: x.isNotNull())))


COVERAGE_LANGS = ("ko", "en", "ja", "zh", "es", "fr")
SOURCES = ("community_social", "reference_wiki", "news_media")


def coverage(items: DataFrame, n_languages: int = len(COVERAGE_LANGS)) -> DataFrame:
    """(entity, language, market, source, time, entity_kinds, coverage) of every entity: breadths of its evidence and their weighted sum.

    One pass over the items and one exchange: languages are counted, and what is only asked for its presence (markets,
    kinds of source, years, kinds of organisation) is gathered as flags and as bits of years.
    """
    lo = V.YEARS[0]
    bits = F.aggregate(T.years(F.col("t")), F.lit(0), lambda m, y: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), y.cast("int") - lo)))
    d = items.withColumn("_d", U.domain(F.col("u"))).withColumn("_l", U.source_language(F.col("_d"), F.col("t"))).withColumn("_s", U.source_type(F.col("_d"))).withColumn("_y", bits).withColumn("_low", F.lower("t"))
    flag = lambda c: F.max(c.cast("int"))
    per = d.groupBy("entity").agg(
        F.count("*").cast("double").alias("_n"),
        *[F.count_if(F.col("_l") == x).alias(f"_l_{x}") for x in COVERAGE_LANGS],
        *[flag(T.any_of(F.col("_low"), [w.lower() for w in ws])).alias(f"_m_{i}") for i, ws in enumerate(V.MARKETS.values())],
        *[flag(F.col("_s") == x).alias(f"_s_{x}") for x in SOURCES],
        *[flag(T.any_of(F.col("t"), ws, "bounded")).alias(f"_o_{i}") for i, ws in enumerate(V.ORGANISATIONS.values())],
        F.bit_or("_y").alias("_y"),
    )
    total = lambda p, ks: reduce(lambda a, b: a + b, [F.col(f"{p}{k}") for k in ks])
    shares = [F.col(f"_l_{x}") / F.col("_n") for x in COVERAGE_LANGS]
    h = reduce(lambda a, b: a + b, [F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in shares])
    n_years = per.agg(F.greatest(F.bit_count(F.bit_or("_y")), F.lit(1)).alias("_ny"))
    out = per.join(F.broadcast(n_years)).select(
        "entity",
        (h / math.log(n_languages) if n_languages > 1 else F.lit(0.0)).alias("language"),
        (total("_m_", range(len(V.MARKETS))) / float(len(V.MARKETS))).alias("market"),
        (total("_s_", SOURCES) / float(len(SOURCES))).alias("source"),
        (F.bit_count("_y") / F.col("_ny")).alias("time"),
        (total("_o_", range(len(V.ORGANISATIONS))) / float(len(V.ORGANISATIONS))).alias("entity_kinds"),
    )
    w = V.COVERAGE_WEIGHTS
    return out.withColumn("coverage", w["language"] * F.col("language") + w["market"] * F.col("market") + w["source"] * F.col("source") + w["time"] * F.col("time") + w["entity"] * F.col("entity_kinds"))


def impact(shares: DataFrame, scores: DataFrame) -> DataFrame:
    """(entity, factor, loyalty, spillover): a factor's share of an entity's scores."""
    return shares.join(scores, "entity").select("entity", "factor", (F.col("share") * F.col("loyalty_score")).alias("loyalty"), (F.col("share") * F.col("spillover_score")).alias("spillover"))
