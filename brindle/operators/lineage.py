"""Rounds, snapshots and rosters: continuity, provenance, reconciliation, comparison; gaps, segments and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import round_key, short_hash
from .stats import average_rank, corr


def growth(log: DataFrame) -> DataFrame:
    """Rounds (stage, ord, before_total, after_total, net_new, gap): gap tells a start that isn't the end before it. One row a round, so one ordered window does."""
    w = Window.orderBy("ord")
    prev = F.lag("after_total").over(w)
    out = log.withColumn("ord", round_key(F.col("stage"))).withColumn("_prev", prev)
    gap = F.when(F.col("_prev") != F.col("before_total"), F.concat_ws(" -> ", F.col("_prev").cast("string"), F.col("before_total").cast("string")))
    return out.select("stage", F.col("ord.n").alias("n"), F.col("ord.suffix").alias("suffix"), "before_total", "after_total", F.coalesce("net_new_bullets", F.col("after_total") - F.col("before_total")).alias("net_new"), gap.alias("gap"))


def cumulative(df: DataFrame, order: list[Column], n: str) -> DataFrame:
    """Running sum and share of a column in an order; for tables that fit one ordered window, as counts by term."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum", F.sum(n).over(w)).withColumn("cum_share", F.col("cum") / F.sum(n).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def segments(df: DataFrame, order: str, most: float, by: list[str] | None = None) -> DataFrame:
    """Rows numbered by segment, a new one beginning where the order leaps by more than `most`."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    leap = (F.col(order) - F.lag(order).over(w) > most).cast("int")
    return df.withColumn("_leap", F.coalesce(leap, F.lit(0))).withColumn("segment", F.sum("_leap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_leap")


def interpolate(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Nulls between measured values filled on the line between them; measured tells which is which."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).cast("double").alias("y")))
    d = df.withColumn("_a", F.last(known, True).over(past)).withColumn("_b", F.first(known, True).over(ahead))
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(order) - F.col("_a.x")) / F.nullif((F.col("_b.x") - F.col("_a.x")).cast("double"), F.lit(0.0))
    return d.withColumn("measured", F.col(value).isNotNull()).withColumn(value, F.coalesce(F.col(value).cast("double"), line)).drop("_a", "_b")


def prefix(items: DataFrame, lengths: DataFrame) -> DataFrame:
    """The first n items of each (entity, kind), n from a table of snapshot lengths."""
    return items.join(lengths, ["entity", "kind"]).where("idx < n").drop("n")


def provenance(items: DataFrame, snapshots: DataFrame, last: str) -> DataFrame:
    """Items with the first snapshot that holds them: (bullet_id, entity, kind, idx, hash, bin). snapshots: (entity, kind, snapshot, n), n being how many leading items it has.

    The snapshots of an (entity, kind) are few, so they are joined as one array and the smallest sufficient one is taken.
    """
    per = snapshots.groupBy("entity", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "snapshot"))).alias("_s"))
    hit = F.get(F.filter("_s", lambda s: s["n"] > F.col("idx")), F.lit(0))["snapshot"]
    return items.join(per, ["entity", "kind"], "left").select("bullet_id", "entity", "kind", "idx", short_hash(F.coalesce("t", F.lit(""))).alias("hash"), F.coalesce(hit, F.lit(last)).alias("bin"))


def prefix_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items of an older snapshot that the newer one holds differently at their place, or not at all."""
    j = old.select("entity", "kind", "idx", F.col("t").alias("was")).join(new.select("entity", "kind", "idx", F.col("t").alias("is")), ["entity", "kind", "idx"], "left")
    return j.where(~F.col("was").eqNullSafe(F.col("is")))


def roster(live: DataFrame, swaps: DataFrame) -> DataFrame:
    """(entity, status, entered_round, replaces, removed_round, replaced_by) from live entities and swaps (round, removed, added)."""
    came = swaps.select(F.col("added").alias("entity"), F.col("round").alias("entered_round"), F.col("removed").alias("replaces"))
    went = swaps.select(F.col("removed").alias("entity"), F.col("round").alias("removed_round"), F.col("added").alias("replaced_by"))
    j = live.select("entity", F.lit(True).alias("_live")).join(came, "entity", "full_outer").join(went, "entity", "full_outer")
    return j.select("entity", F.when(F.col("_live"), "live").otherwise("removed").alias("status"), F.coalesce("entered_round", F.lit("initial")).alias("entered_round"), "replaces", "removed_round", "replaced_by")


def compare_scores(a: DataFrame, b: DataFrame, k: int = 15) -> DataFrame:
    """One row (n, r, rank_rho, top_overlap) of two tables (entity, score) over their common entities."""
    j = a.select("entity", F.col("score").alias("x")).join(b.select("entity", F.col("score").alias("y")), "entity")
    r = average_rank(average_rank(j, "x", "rx"), "y", "ry").agg(F.count("*").alias("n"), corr("x", "y").alias("r"), corr("rx", "ry").alias("rank_rho"))
    top = lambda c: j.orderBy(F.desc(c), "entity").limit(k).select("entity")
    both = top("x").join(top("y"), "entity").agg(F.count("*").alias("top_overlap"))
    return r.join(F.broadcast(both))


def gate(study: DataFrame, incumbent: float, jaccard: float = 0.35, ratio: float = 0.9, m: int = 5) -> DataFrame:
    """(corpus, k, median_sil, median_jaccard, mode_m, g1, g2, g3, passed) from seeds (corpus, k, seed, sil, best_m, best_sil, jaccard), sil being that at m."""
    per = study.groupBy("corpus", "k", "best_m").agg(F.count("*").alias("n"))
    mode = per.groupBy("corpus", "k").agg(F.min_by("best_m", F.struct(-F.col("n"), F.col("best_m"))).alias("mode_m"))
    out = study.groupBy("corpus", "k").agg(F.median("sil").alias("median_sil"), F.median("jaccard").alias("median_jaccard"), F.median("best_sil").alias("_best")).join(mode, ["corpus", "k"])
    out = out.withColumn("g1", F.col("median_sil") >= incumbent).withColumn("g2", F.col("median_jaccard") >= jaccard).withColumn("g3", (F.col("mode_m") == m) | (F.col("median_sil") >= ratio * F.col("_best")))
    return out.drop("_best").withColumn("passed", F.col("g1") & F.col("g2") & F.col("g3"))


def rejected_in_a_row(timeline: DataFrame, order: str, value: str, least: float) -> DataFrame:
    """One row (measured, below, in_a_row): values under a bound, in all and at the end of the order."""
    d = timeline.where(F.col(value).isNotNull())
    last_ok = d.agg(F.max(F.when(F.col(value) >= least, F.col(order))).alias("_ok"))
    return d.join(F.broadcast(last_ok)).agg(F.count("*").alias("measured"), F.count_if(F.col(value) < least).alias("below"), F.count_if(F.col("_ok").isNull() | (F.col(order) > F.col("_ok"))).alias("in_a_row"))
