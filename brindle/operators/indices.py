"""Dictionary indices: signals with guards, gated and two-stage tags, regions, mentions, members, languages, concentration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import values as V
from .scoring import tag_hits


def dictionary(spark, tags: dict[str, list[str]], name: str = "") -> DataFrame:
    """(dict, tag, tag_ord, keyword, ord) of a dictionary; an empty keyword is refused."""
    rows = [(name, tag, i, w, j) for i, (tag, ws) in enumerate(tags.items()) for j, w in enumerate(ws)]
    if any(not r[3] for r in rows):
        raise ValueError("an empty keyword would match everything")
    return spark.createDataFrame(rows, "dict string, tag string, tag_ord int, keyword string, ord int")


def guarded_signal(t: Column, signals: list[str], guarded: str, negations: list[str]) -> Column:
    """Whether a text has a signal word, but not if the only one is the guarded one and a negation of it is there too."""
    others = [w for w in signals if w != guarded]
    return T.any_of(t, others) | (T.any_of(t, [guarded] if guarded in signals else []) & ~T.any_of(t, negations))


def two_stage(items: DataFrame, signal: Column, tags: dict[str, list[str]], gates: dict[str, list[str]] | None = None) -> DataFrame:
    """Tag hits of the items that pass the signal; a tag with a gate needs a word of the gate in the same text as well."""
    hit = tag_hits(items.where(signal), tags)
    for tag, words in (gates or {}).items():
        hit = hit.where((F.col("tag") != tag) | T.any_of(F.col("t"), words))
    return hit


def counts_by_tag(items: DataFrame, hits: DataFrame, tags: list[str]) -> DataFrame:
    """(entity, n_total, n_hit, share, top_tag, and a count of each tag): entities without hits keep their row; ties for the top go to the first tag."""
    n = hits.groupBy("entity").pivot("tag", tags).agg(F.count(F.lit(1)))
    per = hits.groupBy("entity", "tag").agg(F.count("*").alias("n"))
    order = F.create_map(*[F.lit(x) for i, t in enumerate(tags) for x in (t, i)])
    top = per.groupBy("entity").agg(F.min_by("tag", F.struct(-F.col("n"), order[F.col("tag")])).alias("top_tag"))
    n_hit = hits.groupBy("entity").agg(F.countDistinct("bullet_id").alias("n_hit"))
    out = items.groupBy("entity").agg(F.count("*").alias("n_total")).join(n_hit, "entity", "left").join(n, "entity", "left").na.fill(0).join(top, "entity", "left")
    return out.withColumn("share", F.col("n_hit") / F.col("n_total"))


def tag_counts(items: DataFrame, tags: dict[str, list[str]], mode: str = "literal") -> DataFrame:
    """The same columns as counts_by_tag(), for tags that depend on the text alone: one pass over the items, one exchange."""
    names = list(tags)
    flagged = items.select("entity", *[T.any_of(F.col("t"), ws, mode).alias(f"_{i}") for i, ws in enumerate(tags.values())])
    n = flagged.groupBy("entity").agg(F.count("*").alias("n_total"), F.count_if(F.greatest(*[F.col(f"_{i}") for i in range(len(names))])).alias("n_hit"), *[F.count_if(F.col(f"_{i}")).alias(x) for i, x in enumerate(names)])
    top = F.greatest(*names)
    first = F.when(top == 0, None)
    for x in names:
        first = first.when(F.col(x) == top, x)
    return n.withColumn("top_tag", first).withColumn("share", F.col("n_hit") / F.col("n_total"))


def region_hits(items: DataFrame, regions: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each item and region named in it."""
    return tag_hits(items, regions or V.REGIONS).withColumnRenamed("tag", "region")


def diversity(hits: DataFrame, tag: str, n_tags: int, order: list[str]) -> DataFrame:
    """(entity, mentions, n_tags_hit, diversity, primary, primary_share) from one row a hit; ties go to the earlier tag."""
    per = hits.groupBy("entity", tag).agg(F.count("*").alias("n"))
    place = F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i)])
    out = per.groupBy("entity").agg(F.sum("n").alias("mentions"), F.count("*").alias("n_tags_hit"), F.min_by(tag, F.struct(-F.col("n"), place[F.col(tag)])).alias("primary"), F.max("n").alias("_top"))
    return out.select("entity", "mentions", "n_tags_hit", (F.col("n_tags_hit") / float(n_tags)).alias("diversity"), "primary", (F.col("_top") / F.col("mentions")).alias("primary_share"))


def match_class(t: Column, at: Column, word: str, exclude: str | None, context: str, before: int = 6, after: int = 6) -> Column:
    """common for a text that matches `exclude`, place if a context pattern is near the hit, else uncertain."""
    near = T.around(t, at, before, len(word) + after)
    out = F.when(near.rlike(context), "place").otherwise("uncertain")
    return F.when(t.rlike(exclude), "common").otherwise(out) if exclude else out


def reassigned(t: Column, at: Column, region: str, rules: list[tuple[str, str, str | None]], before: int = 6, after: int = 8) -> Column:
    """The region that a hit on a name shared by several stands for: the first of the rules (other region, pattern, unless) whose pattern is in the window around the hit and whose `unless` isn't, else its own."""
    near = T.around(t, at, before, after)
    out = F
    for other, pattern, unless in rules:
        out = out.when(near.rlike(pattern) & (~near.rlike(unless) if unless else F.lit(True)), other)
    return out.otherwise(region) if rules else F.lit(region)


def _classed(t: Column, word: str, exclude: str | None, context: str) -> Column:
    """The hits of a word with their class."""
    return F.transform(T.positions(t, word), lambda p: F.struct(p.alias("at"), match_class(t, p, word, exclude, context).alias("class")))


def region_mentions(items: DataFrame, regions: dict[str, list[str]], context: str, exclude: dict[str, str] | None = None, rules: dict[str, list[tuple[str, str, str | None]]] | None = None) -> DataFrame:
    """(bullet_id, entity, region, class, strict_region) of every item and region named in it.

    The class is the best of all hits, place before uncertain before common. The strict region is null for a common
    word, else the region, or the one that the first hit, by the order of the keywords, is reassigned to.
    """
    t, out = F.col("t"), None
    for region, words in regions.items():
        hits = F.concat(*[_classed(t, w, (exclude or {}).get(w), context) for w in words])
        seen = items.where(T.any_of(t, words)).withColumn("_h", hits)
        has = lambda c: F.exists("_h", lambda h: h["class"] == c)
        best = F.when(has("place"), "place").when(has("uncertain"), "uncertain").otherwise("common")
        to = reassigned(t, F.get("_h", F.lit(0))["at"], region, (rules or {}).get(region, []))
        part = seen.select("bullet_id", "entity", F.lit(region).alias("region"), best.alias("class"), F.when(best != "common", to).alias("strict_region"))
        out = part if out is None else out.unionByName(part)
    return out


def strict_index(mentions: DataFrame, order: list[str]) -> DataFrame:
    """(entity, strict_total, strict_regions_hit, strict_diversity, strict_primary) over mentions that aren't common words, by strict region."""
    d = diversity(mentions.where("strict_region is not null").select("entity", F.col("strict_region").alias("region")), "region", len(order), order)
    return d.select("entity", F.col("mentions").alias("strict_total"), F.col("n_tags_hit").alias("strict_regions_hit"), F.col("diversity").alias("strict_diversity"), F.col("primary").alias("strict_primary"))


def mention_type(t: Column, first: str, second: str) -> Column:
    return F.when(t.rlike(first), "hometown").when(t.rlike(second), "activity").otherwise("other")


def member_mentions(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity, member, n): items of an entity that hold an alias of a member, each item once a member. aliases: (entity, member, alias)."""
    a = aliases.select("entity", "member", F.trim("alias").alias("alias")).where("alias <> ''")
    hit = items.join(a, "entity").where(F.contains("t", "alias")).select("entity", "member", "bullet_id").distinct()
    return hit.groupBy("entity", "member").agg(F.count("*").alias("n"))


def concentration(counts: DataFrame, key: str, n: str, places: int | None = None) -> DataFrame:
    """(key, n_parts, total, mci, floor, excess, normalized): Herfindahl of the shares and what is above its floor; normalized is null for one part."""
    w = Window.partitionBy(key)
    share = F.col(n) / F.nullif(F.sum(n).over(w), F.lit(0))
    share = F.bround(share, places) if places is not None else share
    p = counts.withColumn("_s", share)
    out = p.groupBy(key).agg(F.count("*").alias("n_parts"), F.sum(n).alias("total"), F.coalesce(F.sum(F.col("_s") * F.col("_s")), F.lit(0.0)).alias("mci"))
    floor = 1.0 / F.col("n_parts")
    return out.withColumn("floor", floor).withColumn("excess", F.col("mci") - floor).withColumn("normalized", (F.col("mci") - floor) / F.nullif(1.0 - floor, F.lit(0.0)))


def concentration_band(m: Column, lo: float = 0.30, hi: float = 0.45) -> Column:
    return F.when(m < lo, "low").when(m < hi, "middle").otherwise("high")


def foreign(counts: DataFrame, home: str = "ko", n_classes: int = 14) -> DataFrame:
    """(entity, total, n_langs, foreign, foreign_ratio, n_foreign, foreign_diversity, primary_foreign) from (entity, lang, n)."""
    other = F.col("lang") != home
    out = counts.groupBy("entity").agg(
        F.sum("n").alias("total"), F.count("*").alias("n_langs"), F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("foreign"), F.count_if(other).alias("n_foreign"),
        F.min_by(F.when(other, F.col("lang")), F.when(other, F.struct(-F.col("n"), F.col("lang")))).alias("primary_foreign"),
    )
    return out.withColumn("foreign_ratio", F.col("foreign") / F.col("total")).withColumn("foreign_diversity", F.col("n_foreign") / float(n_classes - 1))


def near_miss(hints: list[str], known: list[str]) -> list[str]:
    """Hint words that neither hold a dictionary word nor are held by one."""
    return [h for h in hints if not any(h in k or k in h for k in known)]


def alias_audit(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity, alias, n_contained, n_after_break, short, differs): mentions as substrings and only after a break, and flags."""
    a = aliases.select("entity", F.trim("alias").alias("alias")).where("alias <> ''").distinct()
    j = items.join(a, "entity").where(F.contains("t", "alias"))
    broken = F.expr("rlike(t, concat('(^|[^가-힣])', regexp_replace(alias, '([.^$*+?()\\\\[\\\\]{}|\\\\\\\\])', '\\\\\\\\$1')))")
    out = j.groupBy("entity", "alias").agg(F.count("*").alias("n_contained"), F.count_if(broken).alias("n_after_break"))
    return out.withColumn("short", F.length("alias") <= 1).withColumn("differs", F.col("n_contained") != F.col("n_after_break"))


def label_of(words: DataFrame, labels: list[tuple[str, list[str]]], default: str) -> DataFrame:
    """(key, label): the bucket that shares most words with a key's words; ties go to the earlier bucket, none to the default. words: (key, words)."""
    n = [F.size(F.array_intersect(F.col("words"), T.array(ws))) for _, ws in labels]
    top = F.greatest(*n)
    out = F.when(top == 0, default)
    for (name, _), k in zip(labels, n):
        out = out.when(k == top, name)
    return words.select("key", out.alias("label"))


def unique_labels(labels: list[str], words: list[list[str]], used: set[str], end: str = "형") -> list[str]:
    """Labels that occur several times get their first word that is no bucket word and no number, then a number."""
    out: list[str] = []
    for label, ws in zip(labels, words):
        name = label
        if labels.count(label) > 1:
            own = next((w for w in ws if w not in used and not w.isdigit()), None)
            name = f"{label}·{own}{end}" if own else label
        k, base = 2, name
        while name in out:
            name, k = f"{base}({k})", k + 1
        out.append(name)
    return out


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with the side that has them."""
    cols = a.columns
    return a.exceptAll(b.select(cols)).withColumn("only_in", F.lit("a")).unionByName(b.select(cols).exceptAll(a).withColumn("only_in", F.lit("b")))


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows deduplicated by key, the first in order staying."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def tags_as_columns(items: DataFrame, hits: DataFrame, tags: list[str]) -> DataFrame:
    n = reduce(lambda a, t: a + [F.count_if(F.col("tag") == t).alias(t)], tags, [])
    return items.select("entity").distinct().join(hits.groupBy("entity").agg(*n), "entity", "left").na.fill(0)
