"""Writers: JSON and CSV results, model bundles with a manifest, and appended checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, bom: bool = False, single: bool = False) -> None:
    """A CSV with header; sorted and in one file, with a byte order mark before the header, where a small result asks for it."""
    out = df.orderBy(*order) if order else df
    if bom:
        first, *rest = out.columns
        out = out.withColumnRenamed(first, "﻿" + first)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_wide(df: DataFrame, path: str, key: str, name: str, value: str, names: list[str]) -> None:
    """Rows (key, name, value) as a CSV with a column for each of `names`, zero where there is no row."""
    write_csv(df.groupBy(key).pivot(name, names).agg(F.sum(value)).na.fill(0), path, [key], single=True)


def write_checked(df: DataFrame, path: str, expected: int) -> int:
    """Write parquet and compare the number of rows written with the expected one."""
    df.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if n != expected:
        raise ValueError(f"{n} rows written, {expected} expected")
    return n


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_once(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at `path` doesn't have yet: a checkpoint that a repeated run takes up."""
    spark = df.sparkSession
    try:
        df = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)


def markdown(df: DataFrame, most: int = 200, places: int = 4) -> str:
    """A small table as Markdown; more than `most` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; a report takes a summary")
    cell = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
