"""Growth in rounds as a stream: new items appended to the lists of their entities, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_rounds(source: DataFrame, path: str, checkpoint: str, key: str = "bullet_id", parts: int = 64) -> StreamingQuery:
    """Append each micro-batch's items that the table at `path` doesn't have, so that a repeated batch adds nothing.

    A batch has a folder of its own, which a retry replaces, so one that died half-way leaves nothing. Rows lie by a
    part of their key's hash, and only the parts that a batch has keys of are read to find what is known. A null key
    is known to nothing and appended once a batch. The table has the columns batch and part beside the source's.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("part", part)
        own = [r[0] for r in new.select("part").distinct().collect()]  # `parts` at most
        try:
            seen = spark.read.option("basePath", path).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            seen = seen.where((F.col("batch") != number) & F.col("part").isin(own)).select(key, "part")
            new = new.join(seen, [key, "part"], "left_anti").select(*new.columns)
        new.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by tumbling window, as a stream with a watermark or as a batch."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def read_events(spark: SparkSession, folder: str, schema: str, glob: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
