"""Resampling: draws by hash, the same however the data are partitioned."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .stats import chi2_p1, chi2_yates, corr


def hash_number(*key):
    """A number from 0 to 2^32-1 by the MD5 of the key columns, joined by bars, which other engines can draw alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])), 1, 8), 16, 10).cast("long")


def hash_place(n, *key):
    """A number from 0 to n-1 by a hash of the key columns."""
    return hash_number(*key) % n


def bootstrap(spark: SparkSession, entities: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """Draws with replacement: (rep, and the columns of the drawn entity). The entities are numbered and joined by number, so nothing is multiplied but the draws themselves."""
    numbered = entities.withColumn("_at", F.row_number().over(Window.orderBy("entity")) - 1)  # entities, not items: a bounded roster
    n = entities.count()
    draws = spark.range(reps * n).select(F.floor(F.col("id") / n).cast("int").alias("rep"), hash_place(F.lit(n), F.col("id"), F.lit(seed)).cast("int").alias("_at"))
    return draws.join(F.broadcast(numbered) if n <= 100_000 else numbered, "_at").drop("_at")


def bootstrap_r(spark: SparkSession, entities: DataFrame, x: str, y: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """One row (mean_r, lo, hi) of the correlation over bootstrap draws."""
    r = bootstrap(spark, entities, reps, seed).groupBy("rep").agg(corr(x, y).alias("r"))
    p = F.percentile("r", F.array(F.lit(0.025), F.lit(0.975)))
    return r.agg(F.avg("r").alias("mean_r"), F.get(p, F.lit(0)).alias("lo"), F.get(p, F.lit(1)).alias("hi"))


@pandas_udf(DoubleType())
def _chi2_p(x: pd.Series) -> pd.Series:
    return x.map(chi2_p1, na_action="ignore")


STATISTICS = ("r", "rho", "mr_loyalty", "mr_activity", "z_loyalty", "z_spillover", "z_r2", "chi2_p")


def statistics_of(draws: DataFrame, by: list[str], cut: float = 0.5) -> DataFrame:
    """STATISTICS of each group of draws of (loyalty, spillover, activity, diversity).

    Correlation and rank correlation of both scores; the coefficients of spillover on loyalty and activity, and of
    diversity on both scores, with the latter's R2; p of the chi-square, with continuity correction, of both scores
    reaching `cut`, null where a margin is empty. Ranks are by windows within a group, a roster of entities.
    """
    half = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0
    d = draws.withColumn("_rl", half("loyalty")).withColumn("_rs", half("spillover"))
    cov = {f"{a}{b}": F.covar_pop(x, y) for a, x in (("l", "loyalty"), ("s", "spillover"), ("a", "activity"), ("d", "diversity")) for b, y in (("l", "loyalty"), ("s", "spillover"), ("a", "activity"), ("d", "diversity")) if a <= b}
    hi, lo = F.col("loyalty") >= cut, F.col("spillover") >= cut
    cells = {"n11": hi & lo, "n10": hi & ~lo, "n01": ~hi & lo, "n00": ~hi & ~lo}
    s = d.groupBy(*by).agg(corr("loyalty", "spillover").alias("r"), corr("_rl", "_rs").alias("rho"), *[v.alias(k) for k, v in cov.items()], *[F.count_if(v).alias(k) for k, v in cells.items()])

    def two(xx: str, yy: str, xy: str, xt: str, yt: str) -> tuple:
        det = F.nullif(F.col(xx) * F.col(yy) - F.col(xy) * F.col(xy), F.lit(0.0))
        return (F.col(xt) * F.col(yy) - F.col(yt) * F.col(xy)) / det, (F.col(yt) * F.col(xx) - F.col(xt) * F.col(xy)) / det

    m1, m2 = two("ll", "aa", "al", "ls", "as")
    z1, z2 = two("ll", "ss", "ls", "dl", "ds")
    s = s.withColumn("mr_loyalty", m1).withColumn("mr_activity", m2).withColumn("z_loyalty", z1).withColumn("z_spillover", z2)
    s = s.withColumn("z_r2", (F.col("z_loyalty") * F.col("dl") + F.col("z_spillover") * F.col("ds")) / F.nullif(F.col("dd"), F.lit(0.0)))
    chi2 = chi2_yates(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00"))
    return s.withColumn("chi2_p", _chi2_p(chi2)).select(*by, *STATISTICS)


def bootstrap_all(spark: SparkSession, entities: DataFrame, reps: int = 2000, seed: int = 0, cut: float = 0.5) -> DataFrame:
    """(statistic, point, lo, hi, share): each of STATISTICS on all entities, its percentile interval over draws, and the share of draws that meet its criterion.

    The criteria: |r| below `cut`, p below 0.05, the coefficient of diversity on loyalty negative, that on spillover
    positive; null for the others. entities has (entity, loyalty, spillover, activity, diversity).
    """
    per = statistics_of(bootstrap(spark, entities, reps, seed), ["rep"], cut)
    point = statistics_of(entities.withColumn("rep", F.lit(-1)), ["rep"], cut)
    meets = {"r": F.abs("r") < cut, "chi2_p": F.col("chi2_p") < 0.05, "z_loyalty": F.col("z_loyalty") < 0, "z_spillover": F.col("z_spillover") > 0}
    ends = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    one = per.agg(*[ends(c).alias(f"{c}_ci") for c in STATISTICS], *[(F.count_if(m) / F.count("*")).alias(f"{c}_share") for c, m in meets.items()])
    rows = [F.struct(F.lit(c).alias("statistic"), F.col(c).alias("point"), F.get(f"{c}_ci", F.lit(0)).alias("lo"), F.get(f"{c}_ci", F.lit(1)).alias("hi"), (F.col(f"{c}_share") if c in meets else F.lit(None).cast("double")).alias("share")) for c in STATISTICS]
    return point.join(F.broadcast(one)).select(F.inline(F.array(*rows)))


def paired_difference(spark: SparkSession, both: DataFrame, a: tuple[str, str], b: tuple[str, str], reps: int = 2000, seed: int = 0) -> DataFrame:
    """One row (mean, lo, hi) of the difference of two correlations over the same draws of common entities."""
    r = bootstrap(spark, both, reps, seed).groupBy("rep").agg((corr(*a) - corr(*b)).alias("d"))
    p = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return r.agg(F.avg("d").alias("mean"), F.get(p, F.lit(0)).alias("lo"), F.get(p, F.lit(1)).alias("hi"))


def target_counts(counts: DataFrame, targets: DataFrame, ratio: float) -> DataFrame:
    """(entity, kind, n): the wanted number of each group, or the share `ratio` of its own, at least 1, where none is given."""
    j = counts.join(targets.withColumnRenamed("n", "_want"), ["entity", "kind"], "left")
    return j.select("entity", "kind", F.coalesce("_want", F.greatest(F.lit(1), F.bround(F.col("n") * ratio, 0).cast("long"))).alias("n"))


def reduce_to(items: DataFrame, wanted: DataFrame, rep: int, seed: int = 0, salts: int = 16) -> DataFrame:
    """n items of each (entity, kind) without replacement, those of the least hashes; a group is thinned in parts before it is ordered, so that a hot one doesn't sort in one task alone."""
    h = items.join(wanted, ["entity", "kind"]).withColumn("_h", hash_number("bullet_id", F.lit(rep), F.lit(seed)))
    part = Window.partitionBy("entity", "kind", F.pmod("_h", F.lit(salts))).orderBy("_h", "bullet_id")
    thin = h.withColumn("_r", F.row_number().over(part)).where("_r <= n")
    return thin.withColumn("_r", F.row_number().over(Window.partitionBy("entity", "kind").orderBy("_h", "bullet_id"))).where("_r <= n").drop("_r", "_h", "n")


def reductions(scored: DataFrame, wanted: DataFrame, reps: int = 1000, seed: int = 0) -> DataFrame:
    """(rep, entity, kind, raw): the summed score of n items drawn without replacement from each (entity, kind), `reps` times over.

    What is drawn is how many items of each score there are, from the numbers of items by score, which has the same
    distribution as drawing the items and costs the same whatever their number. scored: (entity, kind, score10).
    """
    counts = scored.groupBy("entity", "kind", "score10").agg(F.count("*").alias("k")).join(wanted, ["entity", "kind"])

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("score10")
        entity, kind = part["entity"].iloc[0], part["kind"].iloc[0]
        rng = np.random.default_rng([seed, *hashlib.md5(f"{entity}|{kind}".encode()).digest()])
        n = min(int(part["n"].iloc[0]), int(part["k"].sum()))
        drawn = rng.multivariate_hypergeometric(part["k"].to_numpy(), n, size=reps, method="marginals")
        return pd.DataFrame({"rep": np.arange(reps), "entity": entity, "kind": kind, "raw": drawn @ part["score10"].to_numpy() / 10.0})

    return counts.groupBy("entity", "kind").applyInPandas(draw, "rep int, entity string, kind string, raw double")


def reduced_r(scored: DataFrame, wanted: DataFrame, reps: int = 1000, seed: int = 0, cut: float = 0.5) -> DataFrame:
    """One row (reps, mean_r, sd, lo, hi, least, most, share_at_cut) of the correlation of both summed scores over random reductions."""
    sums = reductions(scored, wanted, reps, seed).groupBy("rep", "entity").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("raw"))), F.lit(0.0)).alias(k) for k in ("loyalty", "spillover")])
    r = sums.groupBy("rep").agg(corr("loyalty", "spillover").alias("r"))  # scaling both scores within a draw changes no correlation
    p = F.percentile("r", F.array(F.lit(0.025), F.lit(0.975)))
    return r.agg(F.count("*").alias("reps"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd"), F.get(p, F.lit(0)).alias("lo"), F.get(p, F.lit(1)).alias("hi"), F.min("r").alias("least"), F.max("r").alias("most"), (F.count_if(F.col("r") >= cut) / F.count("*")).alias("share_at_cut"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int, notes: DataFrame | None = None) -> DataFrame:
    """n rows by the least hashes of their keys, with earlier annotations (key, note) kept."""
    s = rows.withColumn("_h", hash_number(key, F.lit(seed))).orderBy("_h", key).limit(n).drop("_h")
    return s.join(notes, key, "left") if notes is not None else s
