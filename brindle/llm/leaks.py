"""Problem 7: evaluation passages in training text, whole, in part or edited.

Of every item, runs of SEED characters are chosen as seeds, of each stretch of STRETCH characters the one that is rarest
in the corpus. The seeds are so short that some survive between edits ten characters apart, and the stretches so short that
a run as long as the shortest leak holds a chain of them. Where a chain is met, the shared run is measured; where a document
shares enough of the item's runs in a band, or a leak, the two are aligned by Smith-Waterman along the diagonals on which they
lie, which also scores copies that were edited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import Bare, grams
from .io import arrow_map, plain, slices

#: The shortest shared run that is a leak, in bare characters, and that for languages without blanks between words.
RUN, RUN_DENSE, DENSE = 60, 30, ("ja", "zh")
SEED, SEED_DENSE = 8, 5
#: The stretches that have a seed each; a shortest leak holds two without overlap.
STRETCH, STRETCH_DENSE = 24, 12
#: Characters of the items that are sent to the tasks at once, some 40,000 items; more are scanned for in blocks.
BLOCK_SEEDS = 8_000_000
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -2
#: How far an alignment may drift from the places at which seeds were met.
BAND = 48
#: The least share of the best possible score at which an alignment without a long shared run is reported.
EDITED = 0.5
#: The share of an item's runs of seed length, and the number of them, that a document must share for an alignment. Of a
#: copy with an edit every ten characters about a fifth survive.
EVIDENCE, LEAST_RUNS = 0.12, 6
#: Pairs that are aligned at a time.
TOGETHER = 128
#: Bytes of text that are compared with the items at once.
SLICE = 500_000


@dataclass
class Seeds:
    """Sorted seed hashes with item and place in it, for one seed length."""

    width: int
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @property
    def shift(self) -> np.uint64:
        """By how much a hash is cut for the bitmap, which has a bit in sixteen set at most, up to 2^27 bits."""
        return np.uint64(64 - int(np.clip(np.ceil(np.log2(16 * max(len(self.hashes), 1))), 16, 27)))

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << (64 - int(self.shift)), bool)
        out[(self.hashes >> self.shift).astype(np.int64)] = True
        return out

    def hits(self, g: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into g, and into the seeds, of every match."""
        cand = np.flatnonzero(bitmap[(g >> self.shift).astype(np.int64)])
        lo, hi = (np.searchsorted(self.hashes, g[cand], s) for s in ("left", "right"))
        n = hi - lo
        who = np.repeat(cand, n)
        first = np.repeat(np.cumsum(n) - n, n)
        return who, np.repeat(lo, n) + np.arange(len(who)) - first


def item_grams(texts: list[np.ndarray], dense: list[bool]) -> list[Seeds]:
    """All runs of seed length of all items, by seed length."""
    out = []
    for width, want in ((SEED, False), (SEED_DENSE, True)):
        use = [i for i, d in enumerate(dense) if d == want and len(texts[i]) >= width]
        if use:
            lens = np.array([len(texts[i]) for i in use], np.int64)
            starts = np.cumsum(lens) - lens
            g, row, at = grams(np.concatenate([texts[i] for i in use]), starts, lens, width)
            order = np.argsort(g, kind="stable")
            out.append(Seeds(width, g[order], np.array(use)[row[order]], (at - starts[row])[order]))
    return out


def choose(seeds: Seeds, count: np.ndarray, run: int) -> np.ndarray:
    """Which runs are seeds: the rarest, of those that do occur, of every stretch of `run` characters of each item (of the whole item if it is shorter), however common it is."""
    keep = np.zeros(len(seeds.hashes), bool)
    never = np.iinfo(np.int64).max
    count = np.where(count > 0, count, never)
    order = np.lexsort((seeds.at, seeds.item))
    for part in np.split(order, np.flatnonzero(np.diff(seeds.item[order])) + 1):
        w = max(1, min(run - seeds.width + 1, len(part)))
        c = count[part]
        view = np.lib.stride_tricks.sliding_window_view(c, w)
        best = view.argmin(1) + np.arange(len(view))
        keep[part[np.unique(best[c[best] < never])]] = True
    return keep


def longest_equal(a: np.ndarray, b: np.ndarray, diagonal: int) -> int:
    """The length of the longest equal run of a and b, places in a being by `diagonal` greater than those in b."""
    lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
    differ = np.flatnonzero(a[lo + diagonal : hi + diagonal] != b[lo:hi])
    return int(np.diff(differ, prepend=-1, append=hi - lo).max()) - 1


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]], bands: list[tuple[int, int]] | None = None) -> np.ndarray:
    """The best local alignment score of each pair (a, b), with linear gaps; many pairs at a time.

    A band (lo, hi) holds the alignment to places j in b and i in a with lo <= j - i <= hi; without bands all are free.
    """
    best = np.zeros(len(pairs), np.int64)
    bands = bands or [(1 - len(a), len(b) - 1) for a, b in pairs]
    order = sorted(range(len(pairs)), key=lambda i: (bands[i][1] - bands[i][0]) * len(pairs[i][0]))
    for at in range(0, len(order), TOGETHER):
        part = order[at : at + TOGETHER]
        n, w = max(len(pairs[i][0]) for i in part), max(bands[i][1] - bands[i][0] + 1 for i in part)
        a = np.full((len(part), n), 0x7FFFFFFF, np.uint32)
        b = np.full((len(part), n + w), 0x7FFFFFFE, np.uint32)
        for r, i in enumerate(part):
            x, y = pairs[i]
            lo, hi = bands[i]
            a[r, : len(x)] = x
            first, last = max(lo, 0), min(len(x) + hi, len(y))
            if last > first:
                b[r, first - lo : last - lo] = y[first:last]
        step = np.arange(w, dtype=np.int32) * GAP
        h = np.zeros((len(part), w + 1), np.int32)  # by j - i - lo: the diagonal stays in place, the row above is one to the right
        top = np.zeros(len(part), np.int32)
        for c in range(n):
            d = h[:, :-1] + np.where(b[:, c : c + w] == a[:, c : c + 1], np.int32(MATCH), np.int32(MISMATCH))
            np.maximum(d, h[:, 1:] + GAP, out=d)
            np.maximum(d, 0, out=d)
            d -= step
            np.maximum.accumulate(d, axis=1, out=d)  # gaps along b
            d += step
            np.maximum(top, d.max(1), out=top)
            h[:, :-1] = d
        best[part] = top
    return best


#: More than any two places in a text can be apart.
_WIDE = 1 << 32


def _scan(docs: DataFrame, runs_of: list[Seeds], seeds: list[np.ndarray], ids: list[int], texts: list[np.ndarray], runs: list[int]) -> DataFrame:
    n_runs = sum((np.bincount(s.item, minlength=len(ids)) for s in runs_of), np.zeros(len(ids), np.int64))
    need = np.maximum(LEAST_RUNS, np.ceil(EVIDENCE * n_runs)).astype(np.int64)
    thick = np.array([r == RUN_DENSE for r in runs], bool)
    # how far seeds of neighbouring stretches are apart at most, and between the first and the last of a shortest leak at least
    gap = np.where(thick, STRETCH_DENSE - SEED_DENSE + 1, STRETCH - SEED + 1)
    span = np.where(thick, RUN_DENSE - SEED_DENSE, RUN - SEED) - 2 * (gap - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [s.bitmap() for s in runs_of]
        # pairs wait for their alignment until there are enough for many to be done at a time
        todo: list[tuple[list[int], int, int]] = []  # documents of one text, item, longest run
        pairs, bands, owner = [], [], []

        def aligned() -> pa.RecordBatch:
            score = np.zeros(len(todo), np.int64)
            np.maximum.at(score, np.array(owner, np.int64), smith_waterman(pairs, bands))
            share = [float(x) / (MATCH * len(texts[i])) for x, (_, i, _) in zip(score, todo)]
            ok = [(k, ids[i], n, n >= runs[i], x) for x, (docs_of, i, n) in zip(share, todo) if n >= runs[i] or x >= EDITED for k in docs_of]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.float64())
            for x in (todo, pairs, bands, owner):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in ok], t) for j, t in enumerate(types)], names=["doc", "item", "run", "leaked", "share"])

        for b in slices(batches, most=SLICE):
            keys = b.column(0).to_pylist()
            bare = Bare(b.column(1).to_pylist())
            ends = bare.ends
            same: dict[bytes, list[int]] = {}  # rows of equal bare text are looked at once
            for r in range(len(keys)):
                same.setdefault(bare.arr[int(bare.starts[r]) : int(ends[r])].tobytes(), []).append(r)
            rows = {x[0]: x for x in same.values()}
            first = np.zeros(len(keys), bool)
            first[list(rows)] = True
            met, every = [], []
            for s, some, bits in zip(runs_of, seeds, maps):
                g, row, at = grams(bare.arr, bare.starts, bare.lens, s.width)
                own = first[row]
                g, row, at = g[own], row[own], at[own]
                where, which = s.hits(g, bits)
                line = row[where] * len(ids) + s.item[which], at[where] - bare.starts[row[where]] - s.at[which], s.at[which]
                every.append(line)
                rare = some[which]
                met.append(tuple(x[rare] for x in line))
            pair, diagonal, at = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64),) * 3
            line = pair * _WIDE + diagonal + _WIDE // 2  # pair and diagonal in one number
            order = np.lexsort((at, line))
            line, at = line[order], at[order]
            item = line // _WIDE % len(ids)
            # chains of neighbouring seeds on a diagonal; those within a shared run are whole but for less than a stretch at either end
            begin = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (np.diff(at) > gap[item[1:]])])) if len(line) else np.zeros(0, np.int64)
            end = np.append(begin[1:], len(line))[: len(begin)] - 1
            long = at[end] - at[begin] >= span[item[begin]]
            longest: dict[int, int] = {}
            for x in np.unique(line[begin[long]]).tolist():
                k, d = x // _WIDE, x % _WIDE - _WIDE // 2
                r = k // len(ids)
                doc = bare.arr[int(bare.starts[r]) : int(ends[r])]
                longest[k] = max(longest.get(k, 0), longest_equal(doc, texts[k % len(ids)], d))
            # pairs that share enough of the item's runs, and that do so within a band of diagonals
            every_pair = np.concatenate([x[0] for x in every]) if every else np.zeros(0, np.int64)
            known = np.array([k for k, n in longest.items() if n >= runs[k % len(ids)]], np.int64)
            line = np.sort(every_pair)
            at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else line
            tally = np.diff(at, append=len(line))
            wanted = np.union1d(line[at][tally >= need[line[at] % len(ids)]], known)
            use = np.flatnonzero(np.isin(every_pair, wanted))
            line = np.sort(every_pair[use] * _WIDE + np.concatenate([x[1] for x in every])[use] + _WIDE // 2) if every else every_pair
            within = np.searchsorted(line, line + BAND, "right") - np.arange(len(line))
            item = line // _WIDE % len(ids)
            close = within >= need[item]
            use = np.flatnonzero(np.isin(line // _WIDE, np.union1d(line[close] // _WIDE, known)))
            for part in np.split(use, np.flatnonzero(np.diff(line[use] // _WIDE)) + 1) if len(use) else ():
                k = int(line[part[0]] // _WIDE)
                r, i = divmod(k, len(ids))
                doc = bare.arr[int(bare.starts[r]) : int(ends[r])].copy()
                leaked = longest.get(k, 0) >= runs[i]
                if not leaked and len(doc) < EDITED * len(texts[i]):
                    continue  # an alignment scores MATCH for each character of the document at most
                d, n = np.unique(line[part] % _WIDE - _WIDE // 2, return_counts=True)
                strong = np.isin(d, line[part][close[part]] % _WIDE - _WIDE // 2) | (leaked & (n == n.max()))
                last = None
                for x, good in zip(d.tolist(), strong.tolist()):  # one band for diagonals that an alignment can join
                    if last is not None and x - last <= BAND:
                        bands[-1] = (bands[-1][0], x + BAND)
                    elif good:
                        pairs.append((texts[i], doc))
                        bands.append((x - BAND, x + BAND))
                        owner.append(len(todo))
                    else:
                        continue
                    last = x
                todo.append(([keys[x] for x in rows[r]], i, longest.get(k, 0)))
            if len(pairs) >= 2 * TOGETHER:
                yield aligned()
        if todo:
            yield aligned()

    return arrow_map(docs, run, "doc long, item long, run int, leaked boolean, share double")


def _count(docs: DataFrame, seeds: list[Seeds]) -> list[np.ndarray]:
    """How often each of the items' runs occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [s.bitmap() for s in seeds]
        total = [np.zeros(len(s.hashes), np.int64) for s in seeds]
        for b in slices(batches):
            bare = Bare(b.column(1).to_pylist())
            for s, bits, n in zip(seeds, maps, total):
                g, _, _ = grams(bare.arr, bare.starts, bare.lens, s.width)
                n += np.bincount(s.hits(g, bits)[1], minlength=len(n))
        for k, n in enumerate(total):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], names=["k", "at", "n"])

    sums = arrow_map(docs, run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each run of the items in this block
    out = []
    for k, s in enumerate(seeds):
        n = np.zeros(len(s.hashes), np.int64)
        part = sums[sums["k"] == k]
        n[part["at"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
        out.append(n)
    return out


def leaks(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", lang: str = "lang") -> DataFrame:
    """(`doc`, `item`, longest_run, leaked, aligned) for each document and item that share text.

    longest_run is the longest run of characters that the bare forms share (0 where it is too short to hold two seeds),
    leaked tells that it reaches RUN (RUN_DENSE for the items in the languages DENSE), aligned is the alignment's share of the best score. Pairs that don't reach
    it are listed if they are aligned by EDITED or more. Null and empty texts and passages, and items shorter than a
    seed, share nothing. Repeated rows count once, other columns are ignored whatever their names, and with no
    documents or no items the result is empty.
    """
    src = plain(docs, k=doc, t=text)
    out = None
    block: list = []
    size = 0

    def scan() -> DataFrame:
        ids, langs = [r[0] for r in block], [r[2] in DENSE for r in block]
        texts = [Bare([r[1]]).arr for r in block]
        every = item_grams(texts, langs)
        runs = [RUN_DENSE if d else RUN for d in langs]
        chosen = [choose(s, n, STRETCH if s.width == SEED else STRETCH_DENSE) for s, n in zip(every, _count(src, every))]
        return _scan(src, every, chosen, ids, texts, runs)

    for r in plain(items, i=item, p=passage, l=lang).distinct().toLocalIterator():  # the items pass the driver block by block
        if r["i"] is None or not r["p"]:
            continue
        if block and size + len(r["p"]) > BLOCK_SEEDS:
            out = scan() if out is None else out.unionByName(scan())
            block, size = [], 0
        block.append((r["i"], r["p"], r["l"]))
        size += len(r["p"])
    last = scan() if block or out is None else None
    out = last if out is None else out if last is None else out.unionByName(last)
    return out.groupBy(F.col("doc").alias(doc), F.col("item").alias(item)).agg(F.max("run").alias("longest_run"), F.max("leaked").alias("leaked"), F.max("share").alias("aligned"))
