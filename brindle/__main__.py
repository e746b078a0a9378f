"""python -m brindle QUERY --data FOLDER [--out FOLDER]: runs a registered query and shows or writes its rows; without a query, lists them."""

from __future__ import annotations

import argparse
import sys
from importlib import import_module
from pathlib import Path

from . import catalog, plans  # noqa: F401  (plans registers the queries)
from .runtime import kept_within, session


def find_root(start: Path, mark: str = "region.parquet") -> Path | None:
    """The nearest folder, from `start` upwards, that holds `mark`."""
    return next((p for p in (start, *start.parents) if (p / mark).exists()), None)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="brindle", description=__doc__)
    p.add_argument("query", nargs="?")
    p.add_argument("--also", help="a module with QUERIES of its own, as an optional subpackage has them")
    p.add_argument("--data", help="folder of the tables; by default the nearest one upwards that has them")
    p.add_argument("--out", help="folder to write parquet to; by default twenty rows are shown")
    p.add_argument("--expected", type=int, help="fail unless there are so many rows")
    a = p.parse_args(argv)
    queries = dict(catalog.QUERIES)
    if a.also:
        queries |= import_module(a.also).QUERIES
    if a.query is None:
        print("\n".join(sorted(queries)))
        return 0
    data = a.data or find_root(Path.cwd())
    if a.query not in queries or data is None:
        print("unknown query" if data else "no tables found; name their folder by --data", file=sys.stderr)
        return 2
    spark = session()
    with kept_within():
        rows = queries[a.query](spark, str(data))
        if a.out:
            rows.write.mode("errorifexists").parquet(a.out)
            rows = spark.read.parquet(a.out)
        else:
            rows.show(20, truncate=60)
        if a.expected is not None and rows.count() != a.expected:
            print("another number of rows than expected", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
