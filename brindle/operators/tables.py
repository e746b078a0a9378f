"""Relational operators on entity tables: filters, joins by role, rankings, pivots, maps, and frames for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interactive_filter(df: DataFrame, column: str, values: list[str], name: str = "entity", query: str = "") -> DataFrame:
    """Rows with one of the values and a name that holds the query, in either case."""
    return df.where(F.col(column).isin(*values) & F.contains(F.lower(name), F.lit(query.lower())))


def split_measured(df: DataFrame, note: str, mark: str = "[추정") -> DataFrame:
    """Rows with measured, false where the note holds the mark, and the note without it."""
    return df.withColumn("measured", ~F.contains(F.coalesce(note, F.lit("")), F.lit(mark))).withColumn(note, F.trim(F.regexp_replace(note, "\\[추정[^\\]]*\\]", "")))


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi")


def only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def grid(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Full outer join of two tables of values by key."""
    return a.select(key, x).join(b.select(key, y), key, "full_outer")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order."""
    return df.orderBy(*order).limit(k)


def top_each(df: DataFrame, by: list[str], k: int, *order: Column, salt: Column | None = None, salts: int = 16) -> DataFrame:
    """The first k rows of each group; with a salt, a large group is cut down in parts before it is put in order."""
    if salt is not None:
        part = Window.partitionBy(*by, F.pmod(salt, F.lit(salts))).orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_r")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def pivot_counts(df: DataFrame, key: str, tag: str, tags: list[str]) -> DataFrame:
    return df.groupBy(key).pivot(tag, tags).agg(F.count(F.lit(1))).na.fill(0)


def rest_beyond(df: DataFrame, by: str, of: str, k: int) -> DataFrame:
    """(by, of, n, rank) of the k most frequent values of each group, and a row with a null value for all others."""
    n = df.groupBy(by, of).agg(F.count("*").alias("n"))
    r = n.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), of)))
    head = r.where(F.col("rank") <= k)
    tail = r.where(F.col("rank") > k).groupBy(by).agg(F.sum("n").alias("n")).select(by, F.lit(None).cast(df.schema[of].dataType).alias(of), "n", F.lit(k + 1).alias("rank"))
    return head.unionByName(tail)


def two_panels(df: DataFrame, *order: Column, size: int = 50) -> DataFrame:
    """Rows with their place in an order and the panel of `size` rows that they are shown in; for a ranking of entities."""
    r = df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return r.withColumn("panel", F.ceil(F.col("place") / float(size)).cast("int"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, n, agree_share) by the first of two labels."""
    return df.groupBy(a).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agree_share"))


def farthest(df: DataFrame, x: str, y: str, k: int = 4) -> DataFrame:
    """The k rows farthest from the centre."""
    c = df.agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    d = F.pow(F.col(x) - F.col("_cx"), 2) + F.pow(F.col(y) - F.col("_cy"), 2)
    return df.join(F.broadcast(c)).withColumn("dist2", d).orderBy(F.desc("dist2"), "entity").limit(k).drop("_cx", "_cy")


def radar(df: DataFrame, values: list[str], most: float) -> DataFrame:
    """(entity, axis, x, y): corner points of values as shares of `most`, the first axis upward."""
    n = len(values)
    pts = F.array(*[F.struct(F.lit(v).alias("axis"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(v) / most)).alias("r"), F.lit(i).alias("i")) for i, v in enumerate(values)])
    angle = F.lit(-1.5707963267948966) + F.col("p.i") * (6.283185307179586 / n)
    return df.select("entity", F.explode(pts).alias("p")).select("entity", F.col("p.axis").alias("axis"), (F.col("p.r") * F.cos(angle)).alias("x"), (F.col("p.r") * F.sin(angle)).alias("y"))


def map_lookup(m: Column, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v.cast("double"))


def positive_values(m: Column) -> Column:
    return F.size(F.filter(F.map_values(m), lambda v: v > 0))


def mismatches(a: Column, b: Column) -> Column:
    """The places, from 0, at which two arrays differ, within the shorter one."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: ~x.eqNullSafe(y))
    return F.filter(F.transform(pairs, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
