"""Problem 5: each new batch against everything accepted before, without reprocessing the history.

The history lives in a :class:`SegmentIndex` in a folder: the segments of every text (its runs of three characters),
stored once, by fandom and by length, in blocks of a bounded number of texts, and the keys of its texts and pages. A batch
reads the parts of its own fandoms and the blocks of possible lengths, is probed with its own segments, and what it
adds is appended as a generation of its own; nothing stored is normalized, cut or counted again. Two texts are alike
exactly if they share a guaranteed minimum of segments, so the tally in a block decides, without further
verification and without leaving any segment out. What candidates of one batch mean to each other is settled over keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import keep, release, shared_path
from .forms import Bare, mix
from .io import arrow_map, plain, slices

#: Texts in a block of the index, and the probes that one task handles with a block at a time.
BLOCK, PROBES = 4096, 5_000
#: Parts of the index by fandom, and parts of its keys.
PARTS = 16
#: Texts are alike from this share of their segments on; lengths are classed by a ratio a little wider than it allows.
THRESHOLD, RATIO = 0.6, 1.7
#: Tenths of a probe's segments that are tallied at first, more than the 4 that may be missing.
FIRST = 6
#: Tables of so many rows at most are broadcast; open questions of so many rows at most are settled in one task.
SMALL, SETTLED = 200_000, 500_000
#: Bits of a segment's hash; the other 16 of a word number texts in a block.
_BITS = np.uint64(16)

_SPACE = re.compile(r"\s+")
_SCHEME = re.compile(r"^[a-z][a-z0-9+.\-]*://")
_HOST = re.compile(r"^(?:www\.|m\.)+")
# The parameters that choose the page.
PAGE_PARAMS = ("aid", "no", "board")


def pages(u: str | None) -> set[str]:
    """The pages that the addresses of `u` name."""
    out = set()
    for a in _SPACE.sub("", u or "").lower().split(";"):
        a = _HOST.sub("", _SCHEME.sub("", a)).partition("#")[0]
        path, _, params = a.partition("?")
        if path := path.rstrip("/"):
            out.add(path + "?" + "&".join(sorted(p for p in params.rstrip("/").split("&") if p.partition("=")[0] in PAGE_PARAMS)))
    return out


def _h(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


def _both(fandom: int, x: int) -> int:
    """A signed hash of a fandom and a text or page."""
    return (xxhash.xxh3_64_intdigest(fandom.to_bytes(8, "little") + x.to_bytes(8, "little")) ^ (1 << 63)) - (1 << 63)


def _fandoms(names: list[str | None]) -> list[int | None]:
    """The hash of each fandom's bare text, None without one; each name is looked at once."""
    own = list(set(names))
    known = {n: _h(x) if x else None for n, x in zip(own, Bare(own).texts())} if own else {}
    return [known[n] for n in names]


def segments(arr: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct segments of each text as 48-bit hashes, and the text of each; up to 65,536 texts, in their order."""
    n = max(len(arr) - 2, 0)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = arr.astype(np.uint64)
    g = mix((c[:n] << np.uint64(42)) | (c[1 : n + 1] << np.uint64(21)) | c[2 : n + 2]) >> _BITS
    row = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)[:n]
    whole = np.ones(len(arr), bool)  # but for the last two of each text
    ends = starts + lens
    whole[ends[lens > 0] - 1] = False
    whole[ends[lens > 1] - 2] = False
    whole = whole[:n]
    x = np.sort(g[whole] | (row[whole] << np.uint64(48)))
    if len(x):
        x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    return x & np.uint64((1 << 48) - 1), (x >> np.uint64(48)).astype(np.int64)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lens) - lens, lens


def size_class(n: np.ndarray) -> np.ndarray:
    """The length class of texts of n segments; texts that can be alike are at most one class apart."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(RATIO)).astype(np.int32)


class Block:
    """An inverted index of up to BLOCK texts: for each segment the texts that hold it."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, segs: np.ndarray, first: np.ndarray, posts: np.ndarray):
        self.keys, self.sizes, self.segs, self.first, self.posts = keys, sizes, segs, first, posts

    @classmethod
    def of(cls, keys: list[int], texts: list[str]) -> Block:
        seg, row = segments(*flat(texts))
        return cls.of_pairs(np.array(keys, np.int64), seg, row)

    @classmethod
    def of_pairs(cls, keys: np.ndarray, seg: np.ndarray, row: np.ndarray) -> Block:
        x = np.sort((seg << _BITS) | row.astype(np.uint64))
        seg = x >> _BITS
        new = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(x) else np.zeros(0, np.int64)
        return cls(keys, np.bincount(row, minlength=len(keys)), seg[new], np.append(new, len(x)), (x & np.uint64(0xFFFF)).astype(np.int64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(self.segs, np.diff(self.first)), self.posts

    def pack(self) -> bytes:
        head = np.array([len(self.keys), len(self.segs), len(self.posts)], np.int64)
        cols = (head, self.keys, self.sizes.astype(np.int32), np.diff(self.segs, prepend=np.uint64(0)), np.diff(self.first).astype(np.uint16), self.posts.astype(np.uint16))
        return zstandard.ZstdCompressor(level=3).compress(b"".join(c.tobytes() for c in cols))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        raw, at = zstandard.ZstdDecompressor().decompress(data), 24
        n, m, p = np.frombuffer(raw, np.int64, 3)
        out = []
        for kind, k in ((np.int64, n), (np.int32, n), (np.uint64, m), (np.uint16, m), (np.uint16, p)):
            out.append(np.frombuffer(raw, kind, k, at))
            at += out[-1].nbytes
        return cls(out[0], out[1].astype(np.int64), np.cumsum(out[2], dtype=np.uint64), np.concatenate([[0], np.cumsum(out[3], dtype=np.int64)]), out[4].astype(np.int64))

    def alike(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the probe, number of the text here) of all that are alike.

        The rarer FIRST of a probe's segments are tallied; two texts that are alike share at least 0.6 of the segments of
        each, so all but 0.4 of the probe's must be met among them less those not looked at. Of the pairs that reach
        this minimum the other segments are looked up, which makes the tally complete.
        """
        seg, row = segments(*flat(texts))
        size = np.bincount(row, minlength=len(texts))
        n = len(self.keys)
        if not len(self.segs) or not len(seg):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.segs, seg), len(self.segs) - 1)
        n_posts = np.where(self.segs[at] == seg, self.first[at + 1] - self.first[at], 0)
        order = np.argsort((row << 17) | n_posts)  # by row, rarest first
        at, n_posts = at[order], n_posts[order]
        start = np.cumsum(size) - size
        early = (np.arange(len(row)) - start[row]) * 10 < size[row] * FIRST
        n_early = np.bincount(row[early], minlength=len(texts))
        need = np.maximum(n_early - (4 * size) // 10, 1)
        use = np.flatnonzero(early & (n_posts > 0))
        # slices of probes whose tallies and cells stay small
        load = np.bincount(row[use], n_posts[use], len(texts))
        cut = np.floor(np.maximum(np.cumsum(load) / 2_000_000, np.arange(len(texts)) * n / 1_000_000)).astype(np.int64)
        ends = np.flatnonzero(np.append(np.diff(cut) > 0, True)) + 1
        bounds = np.searchsorted(row[use], np.concatenate([[0], ends]))
        member = np.repeat(np.arange(len(self.segs)), np.diff(self.first)) * n + self.posts  # sorted: (segment, text)
        found_a, found_b, lo = [], [], 0
        for hi, a, b in zip(ends, bounds[:-1], bounds[1:]):
            some = use[a:b]
            k = n_posts[some]
            where = np.repeat(self.first[at[some]] - (np.cumsum(k) - k), k)
            where += np.arange(len(where))
            where = self.posts[where]
            where += np.repeat((row[some] - lo) * n, k)
            both = np.bincount(where, minlength=(hi - lo) * n).reshape(hi - lo, n)
            x, y = np.nonzero(both >= need[lo:hi, None])
            shared = both[x, y]
            x += lo
            # the segments that weren't tallied
            k = size[x] - n_early[x]
            where = np.repeat(start[x] + n_early[x] - (np.cumsum(k) - k), k)
            where += np.arange(len(where))
            where = where if len(where) else np.zeros(0, np.int64)
            want = at[where] * n + np.repeat(y, k)
            hit = (member[np.minimum(np.searchsorted(member, want), len(member) - 1)] == want) & (n_posts[where] > 0)
            shared = shared + np.bincount(np.repeat(np.arange(len(x)), k)[hit], minlength=len(x))
            ok = 8 * shared >= 3 * (size[x] + self.sizes[y])  # shared >= 0.6 of all, all being the sum of both less the shared
            found_a.append(x[ok])
            found_b.append(y[ok])
            lo = hi
        return np.concatenate(found_a), np.concatenate(found_b)


def _normal(df: DataFrame, fandom: str, text: str, u: str, key: str | None = None, reason: str | None = None) -> DataFrame:
    """([id,] fk, k, class, bare, pages[, open]) of every row: k names fandom and bare text together (null without them), pages fandom and page."""
    batch = key is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in slices(batches):
            for b in (big.slice(i, 1 << 16) for i in range(0, big.num_rows, 1 << 16)):
                fs = _fandoms(b.column(0).to_pylist())
                bare = Bare(b.column(1).to_pylist())
                _, row = segments(bare.arr, bare.starts, bare.lens)
                classes = size_class(np.bincount(row, minlength=b.num_rows)).tolist()
                some = (np.bincount(row, minlength=b.num_rows) > 0).tolist()
                rows = []
                for f, t, a, c, s in zip(fs, bare.texts(), b.column(2).to_pylist(), classes, some):
                    k = _both(f, _h(t)) if f is not None and t else None
                    rows.append((None if f is None else (f ^ (1 << 63)) - (1 << 63), k, c if k is not None and s else None, t if k is not None else None, [_both(f, _h(p)) for p in sorted(pages(a))] if f is not None else []))
                cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays((b.columns[3:4] if batch else []) + cols + b.columns[4:], names=["id"] * batch + ["fk", "k", "class", "bare", "pages"] + ["open"] * batch)

    src = plain(df, f=fandom, t=text, u=u, **({"id": key, "open": reason} if batch else {}))
    if batch:
        src = src.withColumn("open", F.col("open").isNull())
    return arrow_map(src, run, ("id long, " if batch else "") + "fk long, k long, class int, bare string, pages array<long>" + (", open boolean" if batch else ""))


def _keys_of(rows: DataFrame) -> DataFrame:
    """(k): the keys that rows are known by, of their text and of each page."""
    return rows.select(F.explode(F.concat(F.when(F.col("k").isNull(), F.array().cast("array<long>")).otherwise(F.array("k")), "pages")).alias("k"))


def _small(df: DataFrame) -> DataFrame:
    """A kept table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _part(c: str):
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


BLOCKS = "fk long, class int, block long, n int, data binary, part int"


def _blocks(texts: DataFrame, name: str) -> DataFrame:
    """The blocks (BLOCKS) of texts (fk, k, class, bare): each fandom and length is split into as many as it needs; copies count once."""
    counts = keep(texts.groupBy("fk", "class").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("splits")), "counts")
    rows = texts.join(_small(counts), ["fk", "class"])
    rows = rows.select("fk", "class", F.xxhash64("fk", "class", F.pmod(F.col("k"), F.col("splits")), F.lit(name)).alias("block"), "k", "bare")
    rows = rows.repartition("block").sortWithinPartitions("block", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):  # a block holds some more texts than planned at times
                block = Block.of(keys[i : i + (1 << 16)], texts_of[i : i + (1 << 16)])
                cols = [[head[0]], [head[1]], [head[2]], [len(block.keys)], [block.pack()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["fk", "class", "block", "n", "data"])

        head, keys, texts_of = None, [], []
        for b in batches:
            for f, c, block, k, t in zip(*(x.to_pylist() for x in b.columns)):
                if head is None or block != head[2]:
                    if head is not None:
                        yield from out()
                    head, keys, texts_of = (f, c, block), [], []
                if not keys or keys[-1] != k:
                    keys.append(k)
                    texts_of.append(t)
        if head is not None:
            yield from out()

    return arrow_map(rows, run, "fk long, class int, block long, n int, data binary").withColumn("part", _part("fk"))


def _alike(blocks: DataFrame, probes: DataFrame, pairs: bool) -> DataFrame:
    """The probes (fk, k, class, bare) that are alike to a text of the blocks: (a), or with `pairs` (a, b), b being the other text and not a."""
    probes = keep(probes.where("class is not null").dropDuplicates(["k"]), "probes")
    chunks = keep(probes.groupBy("fk").agg(F.ceil(F.count("*") / F.lit(PROBES)).cast("int").alias("chunks")), "chunks")
    chunks = _small(chunks)
    cat = _small(keep(blocks.select("fk", "class", "block").distinct(), "catalog"))
    each = probes.join(chunks, "fk").select("k", "bare", "fk", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)).alias("class"), F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int").alias("chunk"))
    each = each.join(cat, ["fk", "class"]).select("block", "chunk", "k", "bare")
    stored = blocks.join(chunks, "fk").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "data")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            keys, texts = right.column("k").to_numpy(), right.column("bare").to_pylist()
            for data in left.column("data").to_pylist():
                block = Block.unpack(data)
                for i in range(0, len(texts), 1 << 12):
                    x, y = block.alike(texts[i : i + (1 << 12)])
                    if pairs:
                        a.append(keys[i + x])
                        b.append(block.keys[y])
                    else:
                        a.append(keys[i + np.unique(x)])
        if not pairs:
            return pa.table({"a": np.unique(np.concatenate(a))})
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": a[a != b], "b": b[a != b]})

    met = stored.groupBy("block", "chunk").cogroup(each.groupBy("block", "chunk")).applyInArrow(run, "a long" + ", b long" * pairs)
    return met.distinct()


def settle(looking: DataFrame, entered: DataFrame) -> DataFrame:
    """(id) of the candidates that repeat an accepted earlier one.

    looking is (id, k), the keys under which a candidate looks for earlier ones, entered is (id, k), those under which
    it can be found if it repeats nothing itself. Candidates whose earlier ones are all decided are decided in rounds,
    until few enough rows are left for one task, which walks through them by id; what is left is counted first.
    """
    first = entered.groupBy("k").agg(F.min("id").alias("first"))
    looking = keep(looking.join(first, "k").where("first < id").select("id", "k").distinct(), "looking")  # a key without an earlier candidate decides nothing
    entered = keep(entered.join(looking.select("k").distinct(), "k", "left_semi").distinct(), "entered")
    decided = None  # (id, case): the candidates that look somewhere, as far as settled
    while True:
        undecided = looking if decided is None else looking.join(decided.select("id"), "id", "left_anti")
        n = undecided.count()
        if n <= SETTLED:
            break
        waiting = undecided.select("id").distinct().withColumn("u", F.lit(True))
        known = entered if decided is None else entered.join(decided.where("case").select("id"), "id", "left_anti")
        by_key = known.join(waiting, "id", "left").groupBy("k").agg(F.min(F.when(F.col("u").isNull(), F.col("id"))).alias("accepted"), F.min(F.when(F.col("u"), F.col("id"))).alias("waiting"))
        seen = undecided.join(by_key, "k").groupBy("id").agg(F.min("accepted").alias("accepted"), F.min("waiting").alias("waiting"))
        now = seen.select("id", F.when(F.col("accepted") < F.col("id"), True).when(F.col("waiting").isNull() | (F.col("waiting") >= F.col("id")), False).alias("case")).where("case is not null")
        was, decided = decided, keep(now if decided is None else decided.unionByName(now), "decided")
        if was is not None:
            release(was)
    cases = None if decided is None else decided.where("case").select("id")
    if n:
        # the rest: where its rows look, and what can be found there, entered by itself or by decided candidates
        keys = undecided.select("k").distinct()
        there = entered.join(keys, "k", "left_semi")
        if decided is not None:
            there = there.join(cases, "id", "left_anti")
        # of what is found under a key by candidates that are decided or look nowhere, the first is enough, so the rest stays small
        mine = undecided.select("id").distinct().withColumn("u", F.lit(True))
        there = there.join(mine, "id", "left")
        there = there.where("u").select("id", "k").unionByName(there.where("u is null").groupBy("k").agg(F.min("id").alias("id")).select("id", "k"))
        both = undecided.select("id", "k", F.lit(0).alias("enters")).unionByName(there.select("id", "k", F.lit(1).alias("enters")))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            taken: set[int] = set()
            out: list[int] = []
            now, looks, enters = None, [], []

            def close() -> None:
                if any(k in taken for k in looks):
                    out.append(now)
                else:
                    taken.update(enters)

            for b in batches:
                for i, k, e in zip(*(c.to_pylist() for c in b.columns)):
                    if i != now:
                        close()
                        now, looks, enters = i, [], []
                    (enters if e else looks).append(k)
            close()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])

        rest = arrow_map(both.repartition(1).sortWithinPartitions("id"), walk, "id long")
        cases = rest if cases is None else cases.unionByName(rest)
    return cases if cases is not None else looking.select("id").limit(0)


class SegmentIndex:
    """What was accepted so far, in a folder that all executors share; see the module's docstring.

    Each append is a generation that counts once it is marked complete, so that an append that failed can be repeated
    under the same name and leaves nothing behind. A mark is a file of a name; batches are appended one at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def generations(self) -> list[str]:
        """The complete generations, by name."""
        fs, p = self._fs(f"{self.path}/complete")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{what}/generation={g}" for g in self.generations()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema + ", generation string").option("basePath", f"{self.path}/{what}").parquet(*paths).drop("generation")

    def blocks(self) -> DataFrame:
        return self._read("blocks", BLOCKS)

    def keys(self) -> DataFrame:
        return self._read("keys", "k long, part int")

    def _write(self, name: str, blocks: DataFrame, keys: DataFrame) -> None:
        blocks.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/blocks/generation={name}")
        keys.withColumn("part", _part("k")).repartition("part").sortWithinPartitions("part", "k").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/keys/generation={name}")
        fs, p = self._fs(f"{self.path}/complete/{name}")
        fs.create(p, True).close()

    def _add(self, rows: DataFrame, name: str) -> None:
        self._write(name, _blocks(rows.where("class is not null").select("fk", "k", "class", "bare"), name), _keys_of(rows).distinct())

    def build(self, history: DataFrame, name: str = "g000000", *, entity: str = "entity", text: str = "t", u: str = "u") -> SegmentIndex:
        """Adds a history that needn't be checked."""
        rows = keep(_normal(history, entity, text, u), "history")
        self._add(rows, name)
        release(rows)
        return self

    def check(self, batch: DataFrame, *, fandom: str = "fandom", cand: str = "cand_id", text: str = "t", u: str = "u", reason: str = "reason") -> DataFrame:
        """(`cand`, verdict) of every candidate, as verdicts() gives them, against what the index holds."""
        new = keep(_normal(batch, fandom, text, u, cand, reason), "batch")
        parts = [r[0] for r in new.where("fk is not null").select(_part("fk")).distinct().collect()]  # PARTS at most
        looks = new.select("id", F.explode(F.concat(F.when(F.col("k").isNull(), F.array().cast("array<long>")).otherwise(F.array("k")), "pages")).alias("k"))
        key_parts = [r[0] for r in looks.select(_part("k")).distinct().collect()]  # PARTS at most
        known = self.keys().where(F.col("part").isin(key_parts)).select("k")
        same = looks.join(known, "k", "left_semi").select("id")
        near = _alike(self.blocks().where(F.col("part").isin(parts)).drop("part"), new, False)
        near = new.select("id", F.col("k").alias("a")).join(near, "a").select("id")
        in_history = keep(same.unionByName(near).distinct(), "known")

        rest = keep(new.join(in_history, "id", "left_anti"), "rest")
        entered = rest.where("open")
        links = keep(_alike(_blocks(entered.where("class is not null").select("fk", "k", "class", "bare"), "batch").drop("part"), rest, True), "links")
        looking = looks.join(in_history, "id", "left_anti").unionByName(rest.select("id", F.col("k").alias("a")).join(links, "a").select("id", F.col("b").alias("k")))
        entered = entered.select("id", F.explode(F.concat(F.when(F.col("k").isNull(), F.array().cast("array<long>")).otherwise(F.array("k")), "pages")).alias("k"))
        repeats = settle(looking, entered)
        said = new.select("id").join(in_history.withColumn("h", F.lit(True)), "id", "left").join(repeats.withColumn("r", F.lit(True)), "id", "left")
        return said.select(F.col("id").alias(cand), F.when(F.col("h"), "history").when(F.col("r"), "batch").otherwise("new").alias("verdict"))

    def append(self, batch: DataFrame, verdicts: DataFrame, name: str, *, fandom: str = "fandom", cand: str = "cand_id", text: str = "t", u: str = "u", reason: str = "reason") -> None:
        """Adds the accepted candidates of a checked batch: those without `reason` whose verdict is new. Other generations aren't touched."""
        rows = keep(_normal(batch, fandom, text, u, cand, reason).where("open").join(verdicts.where("verdict = 'new'").select(F.col(cand).alias("id")), "id", "left_semi"), "accepted")
        self._add(rows, name)
        release(rows)

    def compact(self, name: str) -> None:
        """Merges all generations into one; the segments are merged as they are stored, block by block, not made again."""
        old = self.generations()
        blocks = self.blocks()
        counts = keep(blocks.groupBy("fk", "class").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("splits")), "counts")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> pa.RecordBatch:
                at = np.cumsum([0] + [len(x.keys) for x in got])
                seg, row = (np.concatenate(v) for v in zip(*((s, r + o) for x, o in zip(got, at) for s, r in [x.pairs()])))
                block = Block.of_pairs(np.concatenate([x.keys for x in got]), seg, row)
                cols = [[head[0]], [head[1]], [head[2]], [len(block.keys)], [block.pack()]]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["fk", "class", "block", "n", "data"])

            head, got = None, []
            for b in batches:
                for f, c, block, data in zip(*(x.to_pylist() for x in b.columns)):
                    x = Block.unpack(data)
                    if head is not None and (block != head[2] or sum(len(y.keys) for y in got) + len(x.keys) > 2 * BLOCK):
                        yield out()
                        got = []
                    head = (f, c, block)
                    got.append(x)
            if got:
                yield out()

        to = F.xxhash64("fk", "class", F.pmod(F.col("block"), F.col("splits")), F.lit(name))
        merged = blocks.join(_small(counts), ["fk", "class"]).select("fk", "class", to.alias("block"), "data").repartition("block").sortWithinPartitions("block")
        merged = arrow_map(merged, run, "fk long, class int, block long, n int, data binary").withColumn("part", _part("fk"))
        self._write(name, merged, self.keys().select("k").distinct())
        for what in ("complete/", "blocks/generation=", "keys/generation="):  # what isn't complete any more isn't read
            for g in old:
                fs, p = self._fs(f"{self.path}/{what}{g}")
                fs.delete(p, True)


def verdicts(history: DataFrame, batch: DataFrame, *, entity: str = "entity", fandom: str = "fandom", cand: str = "cand_id", text: str = "t", u: str = "u", reason: str = "reason") -> DataFrame:
    """What each candidate brings: (`cand`, verdict), the verdict being history (found there), batch (repeats an accepted earlier candidate) or new.

    A candidate repeats what names the same page, or has an equal or alike bare text, for the same fandom (by bare
    text). Earlier is a smaller `cand`; accepted is a candidate without `reason` that repeats nothing itself. A null,
    empty or bare-less fandom equals none, such a text is alike to none, such an address names no page. Repeated rows
    of the history count once; `cand` is unique. Extra columns are ignored, whatever their names. With an empty
    history candidates are compared with each other only; an empty batch gives an empty table.

    The index of the history is built for the occasion; who has batch after batch keeps a :class:`SegmentIndex`.
    """
    index = SegmentIndex(history.sparkSession, shared_path(history.sparkSession, "index")).build(history, entity=entity, text=text, u=u)
    return index.check(batch, fandom=fandom, cand=cand, text=text, u=u, reason=reason)
