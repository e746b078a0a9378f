"""Problem 8: sources mixed to target shares of the total size in tokens.

The tokens of each cell of source, language and topic are raked: iterative proportional fitting scales the cells to the
target shares of the sources and to the corpus's own shares of languages and topics, round after round, no cell beyond
what its source may be repeated. Documents are then drawn so that each is used as often as its cell's weight says on
average, by systematic sampling over size classes, which keeps the sizes drawn close to the sizes wanted.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import keep
from .io import arrow_map, plain, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cells that fitting is done on at the driver, and that are sent to the tasks, at most.
MAX_CELLS = 200_000
#: Classes that a source is drawn in at least, beside those by size, and documents that one of them holds about.
SPLITS, SPLIT_DOCS = 16, 50_000


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, by: dict[str, str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, n_tokens, *by) of the rows with a text of at least one token; whole texts are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for b in slices(batches):
            n = [len(enc.encode_ordinary(t)) if t and not t.isspace() else 0 for t in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *b.columns[2:]], names=["doc", "n_tokens", *by])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    return arrow_map(plain(df, k=key, t=text, **by), run, "doc long, n_tokens long, " + ", ".join(f"{c} string" for c in by))


def rake(tokens: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], cap: np.ndarray, rounds: int = 200, close: float = 1e-9) -> np.ndarray:
    """Weights of cells by iterative proportional fitting.

    `margins` are (group of each cell, wanted size of each group), fitted in turn; the last is met exactly as far as
    the caps allow: a group that can't reach its size within them is filled up.
    """
    w = np.ones(len(tokens))
    for _ in range(rounds):
        was = w.copy()
        for k, (group, want) in enumerate(margins):
            last = k == len(margins) - 1
            for _ in range(30 if last else 1):  # what capped cells can't take goes to the others of the group
                free = (w < cap * (1 - 1e-12)) if last else np.ones(len(w), bool)
                have = np.bincount(group, tokens * w, len(want))
                part = np.bincount(group, tokens * w * free, len(want))
                with np.errstate(divide="ignore", invalid="ignore"):
                    f = np.where(part > 0, (want - (have - part)) / part, 1.0)
                over = have > want * (1 + 1e-12)
                f = np.where(over, np.where(have > 0, want / np.maximum(have, 1e-300), 1.0), np.maximum(f, 1.0)) if last else f
                w = np.where(free | over[group], np.minimum(w * f[group], cap), w)
                if not last or np.all(np.abs(np.bincount(group, tokens * w, len(want)) - want) <= 1e-9 * np.maximum(want, 1)):
                    break
        if np.max(np.abs(w - was)) < close:
            break
    return w


def plan(spark: SparkSession, counts: DataFrame, targets: DataFrame, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """How often documents are used, and what the mixtures come to.

    First (mix_name, source, lang, topic, weight, max_repeats, splits): how often a document of the cell is used on
    average, a row for each mixture and cell. Second (mix_name, asked_total, feasible_total): the tokens asked for, and
    the most tokens at which every share can be met within the caps. A mixture has `total` tokens, by default as many
    as the documents of its sources, with "feasible" as many as its caps allow at the shares asked for. counts has
    (source, lang, topic, n_tokens), with nulls as the value ''. More than MAX_CELLS cells or targets are refused.
    """
    cells = counts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    rows = cells.limit(MAX_CELLS + 1).collect()
    given = targets.where("mix_name is not null and source is not null").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS or len(given) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic, or targets; group the rare values first")
    wanted: dict[str, dict[str, tuple[float, int]]] = defaultdict(dict)
    for r in given:
        if r["source"] in wanted[r["mix_name"]]:
            continue  # a target given twice counts once
        wanted[r["mix_name"]][r["source"]] = (float(r["target_share"] or 0), int(r["max_repeats"] or 0))
    by_source: dict[str, list] = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    out, sizes = [], []
    for mix, sources in sorted(wanted.items()):
        own = [r for s in sorted(sources) for r in by_source[s]]
        if len(out) + len(own) > MAX_CELLS:
            raise ValueError(f"more than {MAX_CELLS} cells in all mixtures; plan fewer at a time")
        has = {s: float(sum(r["tokens"] for r in by_source[s])) for s in sources}
        feasible = min((sources[s][1] * has[s] / sources[s][0] for s in sources if sources[s][0] > 0), default=0.0)
        size = float(sum(has.values())) if total is None else feasible if total == "feasible" else float(total)
        sizes.append((mix, size, feasible))
        if not own:
            continue
        tokens = np.array([r["tokens"] for r in own], float)

        def groups(col: str) -> tuple[list[str], np.ndarray]:
            names = sorted({r[col] for r in own})
            number = {x: i for i, x in enumerate(names)}
            return names, np.array([number[r[col]] for r in own])

        margins = []
        for col in ("lang", "topic"):
            names, group = groups(col)
            margins.append((group, np.bincount(group, tokens, len(names)) / tokens.sum() * size))
        names, group = groups("source")
        cap = np.array([sources[r["source"]][1] for r in own], float)
        margins.append((group, np.array([sources[s][0] for s in names]) * size))
        w = rake(tokens, margins, cap)
        docs = np.bincount(group, [r["n"] for r in own], len(names))
        out.extend((mix, r["source"], r["lang"], r["topic"], float(x), sources[r["source"]][1], max(SPLITS, int(docs[g]) // SPLIT_DOCS)) for r, x, g in zip(own, w, group))
    weights = spark.createDataFrame(out, "mix_name string, source string, lang string, topic string, weight double, max_repeats int, splits int")
    return weights, spark.createDataFrame(sizes, "mix_name string, asked_total double, feasible_total double")


def _drawn(docs: DataFrame, targets: DataFrame, total: float | str | None, seed: int, cols: dict[str, str], tokenizer: str) -> tuple[DataFrame, DataFrame]:
    counts = token_counts(docs, cols["doc"], cols["text"], {k: cols[k] for k in ("source", "lang", "topic")}, tokenizer)
    counts = keep(counts.where("source is not null").fillna("", ["lang", "topic"]), "tokens")
    weights, sizes = plan(docs.sparkSession, counts, targets, total)  # of a size that plan() checks
    rows = counts.join(F.broadcast(weights), ["source", "lang", "topic"])
    part = F.col("weight") - F.floor("weight")
    rows = rows.select("mix_name", "source", "doc", "n_tokens", "max_repeats", "splits", F.floor("weight").cast("int").alias("times"), part.alias("part"), F.xxhash64("mix_name", "doc", F.lit(seed)).alias("h"))
    size_class = F.floor(F.log2(F.col("n_tokens").cast("double")) * 4).cast("int")
    rows = rows.withColumn("class", size_class).withColumn("split", F.pmod("h", "splits").cast("int"))
    # running sums over the classes of a source: within a class by window, across classes by their totals
    totals = rows.groupBy("mix_name", "source", "class", "split").agg(F.sum("part").alias("all"))
    ahead = Window.partitionBy("mix_name", "source").orderBy("class", "split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("mix_name", "source", "class", "split", F.coalesce(F.sum("all").over(ahead), F.lit(0.0)).alias("ahead"))
    inside = Window.partitionBy("mix_name", "source", "class", "split").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("part").over(inside)).join(totals, ["mix_name", "source", "class", "split"])
    start = F.pmod(F.xxhash64("mix_name", "source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    at = F.col("ahead") + F.col("upto") + start
    extra = (F.floor(at + 1e-9) - F.floor(at - F.col("part") + 1e-9)).cast("int")
    return rows.select("mix_name", "source", "doc", "n_tokens", F.least(F.col("times") + extra, "max_repeats").alias("repeats")), sizes


COLUMNS = {"doc": "doc_id", "text": "text", "source": "source", "lang": "lang", "topic": "doc_type"}


def mixtures(docs: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 1, columns: dict[str, str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents drawn for each mixture: (mix_name, doc_id, source, n_tokens, repeats), repeats from 1 to max_repeats.

    Documents without text or source, or of a source without a target in the mixture, are not drawn; a null language
    or topic is a value of its own. Repeated rows are documents of their own, ties in the draw go by key. Other columns
    are ignored, whatever their names; with no documents or no targets the result is empty.
    """
    cols = COLUMNS | (columns or {})
    return _drawn(docs, targets, total, seed, cols, tokenizer)[0].where("repeats > 0").select("mix_name", F.col("doc").alias(cols["doc"]), "source", "n_tokens", "repeats")


def shares(docs: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 1, columns: dict[str, str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """What each mixture reaches: (mix_name, source, target_share, reached_share, n_docs, n_tokens, at_cap, asked_tokens, short_tokens, feasible_total).

    reached_share is the source's part of all tokens drawn; at_cap tells that every document of the source is used as
    often as allowed. asked_tokens is the target's part of the mixture's size, short_tokens what is missing of it, and
    feasible_total the largest size of the mixture at which all its shares can be met within the caps (`total`
    "feasible" asks for that). Every target has a row, with zeros where nothing could be drawn.
    """
    drawn, sizes = _drawn(docs, targets, total, seed, COLUMNS | (columns or {}), tokenizer)
    by = drawn.groupBy("mix_name", "source").agg(F.count(F.when(F.col("repeats") > 0, 1)).alias("n_docs"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("n_tokens"), F.min("repeats").alias("least"))
    t = targets.where("mix_name is not null and source is not null").select("mix_name", "source", "target_share", "max_repeats").dropDuplicates(["mix_name", "source"])
    all_tokens = Window.partitionBy("mix_name")
    rows = t.join(by, ["mix_name", "source"], "left").fillna(0, ["n_docs", "n_tokens"]).join(sizes, "mix_name")
    asked = F.coalesce("target_share", F.lit(0.0)) * F.col("asked_total")
    whole = F.sum("n_tokens").over(all_tokens)
    return rows.select("mix_name", "source", "target_share", F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0).alias("reached_share"), "n_docs", "n_tokens", F.coalesce(F.col("least") >= F.col("max_repeats"), F.lit(False)).alias("at_cap"), asked.alias("asked_tokens"), F.greatest(asked - F.col("n_tokens"), F.lit(0.0)).alias("short_tokens"), "feasible_total")
