"""Readers: nested corpus, lookup tables, logs, archives and embedded literals, and the flat item table made from them."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import round_key
from ..runtime import spread, table

ITEM = "array<struct<t:string,u:string>>"
CORPUS = f"entity string, fanclub string, category string, loyalty {ITEM}, spillover {ITEM}"
KINDS = ("loyalty", "spillover")


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """A nested corpus: a JSON array of entities, or one entity a line."""
    lines = spark.read.schema(schema).option("multiLine", True).json(path)
    return lines.where("entity is not null")


def read_records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A JSON array of records as a lookup by key; the last record of a key holds."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_at", F.monotonically_increasing_id())
    cols = [c for c in rows.columns if c != "_at"]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*cols), "_at").alias("r"))
    return last.select("r.*")


def read_keyed_records(spark: SparkSession, path: str, value: str, key: str = "entity") -> DataFrame:
    """A JSON object of records, {key: record}, as rows with the key as a column; `value` is the record's DDL."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias(key, "r")).select(key, "r.*")


def read_csv(spark: SparkSession, path: str, schema: dict[str, str] | None = None) -> DataFrame:
    """A CSV with header, a byte order mark or none, read as strings and then cast."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.col(f"`{c}`").try_cast((schema or {}).get(c, "string")).alias(c) for c in df.columns])


def read_wide(spark: SparkSession, path: str, index: str, name: str = "name", value: str = "value") -> DataFrame:
    """A CSV matrix with an index column as rows (index, name, value)."""
    df = read_csv(spark, path)
    first, *rest = df.columns
    return df.withColumnRenamed(first, index).unpivot(index, rest, name, value).withColumn(value, F.col(value).cast("double"))


def read_logs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Logs of rounds of either key spelling, in the order of their names: (round, ord, before_total, after_total, ...)."""
    df = spark.read.schema(schema).option("multiLine", True).json(glob)
    name = F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.json)?$", 1)
    return df.withColumn("file", name).withColumn("ord", round_key(F.col("file")))


def either(df: DataFrame, *names: str) -> Column:
    """The first of several spellings of a column that holds a value."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def read_zipped_json(spark: SparkSession, path: str, member: str, schema: str = CORPUS) -> DataFrame:
    """A JSON array inside ZIP archives; one archive a task at a time."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b in pdf["content"]:
                with zipfile.ZipFile(BytesIO(b)) as z:
                    data = json.loads(z.read(member))
                    out.extend(json.dumps(r, ensure_ascii=False) for r in (data if isinstance(data, list) else [data]))
            yield pd.DataFrame({"value": out})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "value string")
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")


def embedded_object(text: str, anchor: str) -> str | None:
    """The first {...} after an anchor, by balanced braces outside of strings; None if there is none or it doesn't close."""
    at = text.find(anchor)
    at = text.find("{", at + len(anchor)) if at >= 0 else -1
    if at < 0:
        return None
    depth, quote, skip = 0, "", False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quote:
            if c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[at : i + 1]
    return None


def read_embedded(spark: SparkSession, path: str, anchor: str, schema: str) -> DataFrame:
    """JSON literals embedded in HTML or script files, one row a file."""

    @F.pandas_udf("string")
    def pull(s: pd.Series) -> pd.Series:
        return s.map(lambda t: embedded_object(t, anchor))

    return spark.read.text(path, wholetext=True).select(F.from_json(pull("value"), schema).alias("r")).select("r.*")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, else the first."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        x = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if x.getFileSystem(conf).exists(x):
            return p
    return paths[0]


def flatten(corpus: DataFrame) -> DataFrame:
    """Items of a nested corpus as rows (entity, category, kind, kind_ord, idx, t, u): loyalty first, null as empty, places kept."""
    parts = []
    for n, kind in enumerate(KINDS):
        items = corpus.select("entity", "category", F.posexplode(F.coalesce(F.col(kind), F.array().cast(ITEM))).alias("idx", "x"))
        parts.append(items.select("entity", "category", F.lit(kind).alias("kind"), F.lit(n).alias("kind_ord"), "idx", F.coalesce("x.t", F.lit("")).alias("t"), F.coalesce("x.u", F.lit("")).alias("u")))
    return parts[0].unionByName(parts[1])


def bullets(spark: SparkSession, d: str) -> DataFrame:
    """The item table at hand, with null text and address as empty."""
    b = spread(table(spark, d, "fandoms_v3_100"))
    return b.select("bullet_id", "entity", "category", "kind", "idx", F.coalesce("t", F.lit("")).alias("t"), F.coalesce("u", F.lit("")).alias("u"), "lang", "added_round", "added_at")
