"""Problem 6: how often every distinct term occurs, in how many records, and which are too rare or too common.

Each task counts into a burst trie: terms are routed by their first characters to compact containers, and a container
that grows too large bursts into one for each next character, so that prefixes are as long as the terms need. Every
container is packed and sent by its prefix. Tasks burst at different depths, so the prefixes that all of them are merged
by are chosen from how much was packed under each; containers that lie above a chosen prefix are divided, and matching
subtrees of different tasks merged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import keep
from .io import arrow_map, plain, slices

#: Terms of a text in lower case.
TERM = re.compile("[가-힣]{2,}|[a-zß-öø-ɏḀ-ỿ]{2,}")
#: Terms in a container before it bursts, and in a whole trie before it is handed on.
CONTAINER, TRIE = 2048, 400_000
#: Packed terms under a prefix, over all tasks, that make it heavy, so that it is divided by the next character; the most heavy prefixes of a length.
ROUTE, HEAVY = 100_000, 50_000
#: Characters of the longest prefix that subtrees are merged by.
DEEPEST = 6


class BurstTrie:
    """Terms with two counters each, occurrences and records, in containers by adaptive prefix.

    A node is a dict from the next character to a container or a node below; a container is a dict from the rest of a
    term to [occurrences, records, last record]. The rest of a term that ends at a node is under the character "".
    """

    __slots__ = ("root", "size", "container")

    def __init__(self, container: int = CONTAINER):
        self.root: dict[str, tuple[dict, bool]] = {}  # next character -> (container or node, whether it is a node)
        self.size, self.container = 0, container

    def add(self, terms: list[str], record: int) -> None:
        """The terms of a record, which counts once for each."""
        for term in terms:
            node, at = self.root, 0
            while True:
                c = term[at : at + 1]
                child = node.get(c)
                if child is None:
                    child = node[c] = ({}, False)
                at += 1
                if not child[1]:
                    break
                node = child[0]
            rest, tail = child[0], term[at:]
            x = rest.get(tail)
            if x is None:
                rest[tail] = [1, 1, record]
                self.size += 1
                if len(rest) > self.container and c:
                    below: dict = {}
                    for r, y in rest.items():
                        below.setdefault(r[:1], ({}, False))[0][r[1:]] = y
                    node[c] = (below, True)
            else:
                x[0] += 1
                if x[2] != record:
                    x[1] += 1
                    x[2] = record

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, container) of all containers."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            for c, (below, is_node) in node.items():
                if is_node:
                    todo.append((prefix + c, below))
                else:
                    yield prefix + c, below

    def items(self) -> Iterator[tuple[str, int, int]]:
        for prefix, rest in self.containers():
            for r, x in rest.items():
                yield prefix + r, x[0], x[1]


def pack(terms: list[str], uses: np.ndarray, records: np.ndarray) -> bytes:
    """Terms below a prefix and their counters as bytes."""
    lens = np.array([len(t) for t in terms], np.int64)
    cols = b"".join(c.astype(np.int64).tobytes() for c in (np.array([len(terms)]), lens, uses, records))
    return zstandard.ZstdCompressor(level=1).compress(cols + "".join(terms).encode("utf-8", "surrogatepass"))


def unpack(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    lens, uses, records = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    text, ends = raw[8 + 24 * n :].decode("utf-8", "surrogatepass"), np.cumsum(lens).tolist()
    return [text[i:j] for i, j in zip([0, *ends], ends)], uses, records


def route(term: str, heavy: set[str], whole: bool = True) -> str | None:
    """The prefix by which a term's subtree is merged: the shortest that isn't heavy, DEEPEST characters at most.

    With `whole` false `term` is itself the prefix of a container; None if that is too short to tell.
    """
    for k in range(1, min(len(term), DEEPEST) + 1):
        if term[:k] not in heavy or k == DEEPEST:
            return term[:k]
    return term if whole else None


def _text_terms(t: str | None) -> list[str]:
    return TERM.findall(t.lower()) if t else []


def _word_terms(words: list | None) -> list[str]:
    return [w for x in words or () if x and x["word"] is not None and (w := x["word"].strip().lower())]


def _packed(src: DataFrame, terms: Callable[[object], list[str]], sized: str | None) -> DataFrame:
    """(prefix, n, data): the containers of every task's tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, record = BurstTrie(), 0

        def out() -> pa.RecordBatch:
            rows = []
            for prefix, rest in trie.containers():
                names = sorted(rest)
                rows.append((prefix, len(names), pack(names, np.array([rest[r][0] for r in names]), np.array([rest[r][1] for r in names]))))
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["prefix", "n", "data"])

        for b in slices(batches, sized):
            for x in b.column(0).to_pylist():
                record += 1
                if ts := terms(x):
                    trie.add(ts, record)
            if trie.size > TRIE:
                yield out()
                trie = BurstTrie()
        yield out()

    return keep(arrow_map(src, run, "prefix string, n long, data binary"), "containers")


def _merged(packed: DataFrame, most: int = ROUTE) -> DataFrame:
    """(term, uses, records): matching subtrees of all tasks merged."""
    levels = F.transform(F.sequence(F.lit(1), F.least(F.length("prefix"), F.lit(DEEPEST))), lambda k: F.substring(F.col("prefix"), F.lit(1), k))
    level = packed.where("length(prefix) > 0").select(F.explode(levels).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    total = packed.agg(F.sum("n")).first()[0] or 0
    most = max(most, total // HEAVY)  # so that no more than HEAVY prefixes of a length can be heavy
    heavy = {r["p"] for r in level.where(F.col("n") > most).select("p").collect()}

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for prefix, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (to := route(prefix, heavy, False)) is not None:
                    rows.append((to, prefix, data))
                    continue
                names, uses, records = unpack(data)  # above the prefixes that are merged by
                parts: dict[str, list[int]] = defaultdict(list)
                for i, r in enumerate(names):
                    parts[route(prefix + r, heavy)].append(i)
                for to, at in parts.items():
                    rows.append((to, prefix, pack([names[i] for i in at], uses[at], records[at])))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["route", "prefix", "data"])

    def merge(subtrees: pa.Table) -> pa.Table:
        total: dict[str, list[int]] = {}
        for prefix, data in zip(subtrees.column("prefix").to_pylist(), subtrees.column("data").to_pylist()):
            names, uses, records = unpack(data)
            for r, n, m in zip(names, uses.tolist(), records.tolist()):
                t = prefix + r
                if (x := total.get(t)) is None:
                    total[t] = [n, m]
                else:
                    x[0] += n
                    x[1] += m
        return pa.table({"term": pa.array(list(total), pa.string()), "uses": pa.array([x[0] for x in total.values()], pa.int64()), "records": pa.array([x[1] for x in total.values()], pa.int64())})

    divided = arrow_map(packed.select("prefix", "data"), divide, "route string, prefix string, data binary")
    return divided.groupBy("route").applyInArrow(merge, "term string, uses long, records long")


def frequencies(df: DataFrame, column: str, words: bool = False, common_share: float = 0.08) -> DataFrame:
    """(term, uses, records, mark) of every term of a column.

    Terms of a text column are the matches of TERM in it in lower case, those of a list of structs with `word` the
    words themselves, trimmed and in lower case. mark is rare for terms of exactly one record, common for those in more
    than `common_share` of all rows, else null. A record counts once for a term it repeats. Nulls, empty texts and
    lists and blank words hold no terms but count as rows; repeated rows count each. Other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    src = plain(df, t=column)
    if words:  # only the words are read, not their stored counts
        src = src.select(F.transform("t", lambda x: F.struct(x["word"].alias("word"))).alias("t"))
    n = df.count()
    counted = _merged(_packed(src, _word_terms if words else _text_terms, "t"))
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > common_share * n, "common")
    return counted.withColumn("mark", mark)
