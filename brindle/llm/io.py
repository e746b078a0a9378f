"""Arrow helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many characters, so that very long ones don't multiply memory.
SLICE_CHARS = 2_000_000


def hash128(s: str | bytes) -> tuple[int, int]:
    """A 128-bit hash as two signed 64-bit numbers."""
    d = xxhash.xxh3_128_digest(s)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "t", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none has many more than `most` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column(b.schema.get_field_index(text)).nbytes
        n = max(1, min(b.num_rows, b.num_rows * most // max(size, 1)))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def plain(df: DataFrame, **cols: str) -> DataFrame:
    """The named columns under fixed names of ours, so that other columns of the input, whatever their names, are out of the way."""
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in cols.items()))


def bounded_sample(rows: DataFrame, n: int, *order: str) -> list:
    """About the `n` rows of the least hashes of the columns `order`, at most `n`.

    Rows are counted and thinned by their hash first, so that what the tasks hand to the driver doesn't grow with the table.
    """
    total = rows.count()
    if not total:
        return []
    h = F.xxhash64(*order)
    part = min(1.0, 1.2 * n / total + 50.0 / total)
    return rows.where(F.pmod(h, F.lit(1 << 30)) < int(part * (1 << 30))).orderBy(h, *order).limit(n).collect()


#: Bits of the fixed-size filter by which only rows that are needed get sent; with more keys it lets more through, never less.
FILTER_BITS = 25


def filter_bits(keys: DataFrame, col: str) -> np.ndarray:
    """A one-hash filter of 2^FILTER_BITS bits over a column of hashes, whatever its length: 4 MB at most."""
    word = F.shiftright(F.col(col).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6)
    bit = F.expr(f"shiftleft(1L, cast({col} & 63 as int))")
    rows = keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()  # at most 2^(FILTER_BITS - 6) rows
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def passing(df: DataFrame, col: str, bits: np.ndarray) -> DataFrame:
    """The rows whose hash the filter lets through; nulls don't pass."""
    at = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(at).is_valid())
            low = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << FILTER_BITS) - 1)
            yield b.filter(pa.array((bits[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) == 1))

    return df.mapInArrow(run, df.schema)
