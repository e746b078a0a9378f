"""Problem 3: records that are the same but for formatting and field order.

Every normalized (field name, value) pair is hashed, and the hashes of a record are added up, which makes the
fingerprint independent of the order of the fields. Only fingerprints are sent to be counted. The fields of records
whose fingerprint occurs more than once are then compared with each other, by grouping them within their fingerprint;
records with a fingerprint of their own are never sent. Nothing is sorted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import keep
from .forms import Bare
from .io import arrow_map, filter_bits, hash128, passing, plain, slices

_SPACE = re.compile(r"\s+")


def address_key(u: str | None) -> str | None:
    """Addresses without case, white space, final slash, and order of parameters and of addresses; None for null."""
    if u is None:
        return None
    out = []
    for a in _SPACE.sub("", u).lower().split(";"):
        if a:
            rest, _, frag = a.partition("#")
            path, _, params = rest.partition("?")
            out.append(path.rstrip("/") + ("?" + "&".join(sorted(params.rstrip("/").split("&"))) if params else "") + ("#" + frag.rstrip("/") if frag else ""))
    return ";".join(sorted(out))


def bare_keys(texts: list[str | None]) -> list[str | None]:
    """Bare texts; None for a null, empty or bare-less text."""
    return [x or None for x in Bare(texts).texts()]


def address_keys(us: list[str | None]) -> list[str | None]:
    return [address_key(u) for u in us]


#: How each kind of field is normalized; None from it means that the record equals no other.
KINDS: dict[str, Callable[[list], list]] = {"text": bare_keys, "address": address_keys}
_MASK = (1 << 64) - 1


def fingerprint(pairs: list[tuple[str, str]]) -> tuple[int, int]:
    """The multiset hash of (name, value) pairs: two 64-bit sums."""
    a = b = 0
    for name, value in pairs:
        x, y = hash128(f"{name}\0{value}")
        a, b = a + x, b + y
    return tuple(((v & _MASK) ^ (1 << 63)) - (1 << 63) for v in (a, b))  # as signed numbers


def _rows(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(id, f1, f2, n0..): the records with their fingerprint and normalized fields, all null for those that equal no other."""
    names = sorted(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "n0"):
            cols = [KINDS[fields[n]](b.column(i + 1).to_pylist()) for i, n in enumerate(names)]
            none = (None,) * (2 + len(names))
            rows = [none if None in v else (*fingerprint(list(zip(names, v))), *v) for v in zip(*cols)]
            types = [pa.int64()] * 2 + [pa.string()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], names=["id", "f1", "f2", *(f"n{i}" for i in range(len(names)))])

    src = plain(df, k=key, **{f"n{i}": n for i, n in enumerate(names)})
    return keep(arrow_map(src, run, "id long, f1 long, f2 long, " + ", ".join(f"n{i} string" for i in range(len(names)))), "records")


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(f1, f2, keep_id, n) by fingerprint; the records of the fingerprints that occur more than once; these by fingerprint and fields.

    The last has (f1, f2, v, keep_id, n), v being a hash of the fields, so equal fingerprints with different fields stay apart.
    """
    fields = [c for c in rows.columns if c.startswith("n")]
    prints = keep(rows.where("f1 is not null").groupBy("f1", "f2").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")), "prints")
    several = prints.where("n > 1")
    some = passing(rows, "f1", filter_bits(several, "f1"))
    check = F.xxhash64(*fields).alias("v")
    verified = some.groupBy("f1", "f2", *fields).agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).select("f1", "f2", check, "keep_id", "n")
    return prints, some.select("id", "f1", "f2", check), verified


def copies(df: DataFrame, key: str = "bullet_id", fields: dict[str, str] | None = None) -> DataFrame:
    """One row for each distinct record: (keep_id, n_copies), keep_id being the smallest key of its copies.

    `fields` maps the compared columns to their kind, text or address. Records with a null in a compared column, or
    with a text of nothing but blanks and marks, equal no other: each of them is a row with n_copies 1. A repeated row
    counts as a copy. Other columns are ignored whatever their names; an empty table gives an empty one.
    """
    rows = _rows(df, key, fields or {"t": "text", "u": "address"})
    prints, _, verified = _groups(rows)
    # the filter lets through some records whose fingerprint is their own; these are in `prints` already
    again = verified.hint("shuffle_hash").join(prints.where("n > 1").select("f1", "f2"), ["f1", "f2"], "left_semi")
    parts = (prints.where("n = 1"), again, rows.where("f1 is null").select(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
    a, b, c = (p.select("keep_id", F.col("n").alias("n_copies")) for p in parts)
    return a.unionByName(b).unionByName(c)


def copy_pairs(df: DataFrame, key: str = "bullet_id", fields: dict[str, str] | None = None) -> DataFrame:
    """(keep_id, `key`): for records with copies, the smallest key and each other one. Nulls and blanks as in copies()."""
    rows = _rows(df, key, fields or {"t": "text", "u": "address"})
    _, some, verified = _groups(rows)
    several = verified.where("n > 1").select("f1", "f2", "v", "keep_id").hint("shuffle_hash")
    return some.join(several, ["f1", "f2", "v"]).where("id <> keep_id").select("keep_id", F.col("id").alias(key)).distinct()
