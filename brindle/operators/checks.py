"""Integrity checks as tables: (label, ok, detail), one row a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, label: str, ok: Column, detail: Column) -> DataFrame:
    """One check from aggregates of a table."""
    return df.agg(ok.alias("ok"), detail.cast("string").alias("detail")).select(F.lit(label).alias("label"), F.coalesce("ok", F.lit(False)).alias("ok"), "detail")


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def row_count(df: DataFrame, label: str, expected: int) -> DataFrame:
    return check(df, label, F.count("*") == expected, F.count("*"))


def no_rows(df: DataFrame, label: str) -> DataFrame:
    """Passes if there are no rows, as after an anti-join."""
    return check(df, label, F.count("*") == 0, F.count("*"))


def unique(df: DataFrame, label: str, *key: str) -> DataFrame:
    return no_rows(df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), label)


def sums_to(df: DataFrame, label: str, parts: Column, total: Column) -> DataFrame:
    """Whether in every row the parts add up to the total."""
    return no_rows(df.where(~(parts.eqNullSafe(total))), label)


def within(df: DataFrame, label: str, a: Column, b: Column, tolerance: float) -> DataFrame:
    return no_rows(df.where((F.abs(a - b) > tolerance) | (a.isNull() != b.isNull())), label)


def top_is_max(df: DataFrame, label: str, top: Column, counts: dict[str, Column]) -> DataFrame:
    """Whether the named top tag is one of the largest; ties are allowed."""
    best = F.greatest(*counts.values())
    named = F
    for tag, n in counts.items():
        named = named.when(top == tag, n)
    return no_rows(df.where(top.isNotNull() & (named.otherwise(None) < best)), label)


def shares_sum_to_one(df: DataFrame, label: str, key: str, share: str, tolerance: float = 0.001) -> DataFrame:
    s = df.groupBy(key).agg(F.sum(share).alias("s"))
    return no_rows(s.where(F.abs(F.col("s") - 1) > tolerance), label)


def rounded_like(got: float, literal: str) -> bool:
    """Whether a number equals a literal at the literal's own precision."""
    places = len(literal.partition(".")[2])
    return abs(got - float(literal)) <= 0.5 * 10**-places + 1e-12


def inclusion(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row (n, inside, share): rows of a whose keys b has."""
    hit = b.select(*on).distinct().withColumn("_in", F.lit(1))
    return a.join(hit, on, "left").agg(F.count("*").alias("n"), F.count("_in").alias("inside"), (F.count("_in") / F.nullif(F.count("*"), F.lit(0))).alias("share"))
