"""Model bundles: a fit with all that is needed to check and reuse it, and studies of many fits that can be taken up again."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import topics as TP
from ..sources import sinks


def write_bundle(spark: SparkSession, docs: DataFrame, path: str, k: int, seed: int, rounds: int = 50, m_range: range = range(4, 9)) -> dict:
    """Fit topics on documents (doc, entity, words) and write below `path` the model, its vectorizer, the vocabulary with
    both frequencies, the documents' topics, the words' weights, distances, merges, silhouettes, and a manifest with hashes."""
    docs = docs.persist()
    counted, vec = TP.vectorize(docs)
    counted = counted.persist()
    model = TP.fit_topics(counted, k, seed, rounds)
    vec.write().overwrite().save(f"{path}/vectorizer")
    model.write().overwrite().save(f"{path}/model")
    words = docs.select("doc", F.explode("words").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    words.write.mode("overwrite").parquet(f"{path}/vocabulary")
    TP.theta(model, counted).write.mode("overwrite").parquet(f"{path}/theta")
    TP.phi_long(model, vec.vocabulary, spark).write.mode("overwrite").parquet(f"{path}/phi_top")
    phi = model.topicsMatrix().toArray().T
    dist = TP.cosine_distances(phi / phi.sum(1, keepdims=True))
    merges = TP.linkage(dist)
    m, sil = TP.choose_m(dist, m_range)
    spark.createDataFrame([(i, j, float(dist[i, j])) for i in range(k) for j in range(k)], "a int, b int, distance double").write.mode("overwrite").parquet(f"{path}/distances")
    spark.createDataFrame([(int(n), int(i), int(j), float(h), int(s)) for n, i, j, h, s in merges], "id int, left int, right int, height double, size int").write.mode("overwrite").parquet(f"{path}/linkage")
    spark.createDataFrame([(int(x), float(s), x == m) for x, s in sil.items()] or [(m, None, True)], "m int, silhouette double, selected boolean").write.mode("overwrite").parquet(f"{path}/m_grid")
    sinks.manifest(spark, path).where(~F.col("path").contains("/manifest/")).write.mode("overwrite").parquet(f"{path}/manifest")
    out = {"perplexity": TP.perplexity(model, counted), "m": m, "top_words": TP.top_words(model, vec.vocabulary)}
    counted.unpersist()
    docs.unpersist()
    return out


def reload_equals(spark: SparkSession, path: str, docs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Checks (label, ok) of a bundle: files as in the manifest, and topics of the documents as stored when the model is read again."""
    now = sinks.manifest(spark, path).where(~F.col("path").contains("/manifest/")).select("path", "sha256")
    kept = spark.read.parquet(f"{path}/manifest").select("path", "sha256")
    files = kept.exceptAll(now).unionByName(now.exceptAll(kept)).agg((F.count("*") == 0).alias("ok")).select(F.lit("files").alias("label"), "ok")
    vec = CountVectorizerModel.load(f"{path}/vectorizer")
    theta = TP.theta(LocalLDAModel.load(f"{path}/model"), vec.transform(docs)).withColumnRenamed("weight", "again")
    j = spark.read.parquet(f"{path}/theta").join(theta, ["doc", "topic"], "full_outer")
    same = j.agg(F.coalesce(F.max(F.abs(F.coalesce("weight", F.lit(9.0)) - F.coalesce("again", F.lit(-9.0)))) <= tolerance, F.lit(True)).alias("ok")).select(F.lit("topics").alias("label"), "ok")
    return files.unionByName(same)


def seed_study(spark: SparkSession, corpora: dict[str, DataFrame], ks: list[int], seeds: list[int], path: str, rounds: int = 50, m_range: range = range(4, 9)) -> DataFrame:
    """Fits by corpus, number of topics and seed, each written as it is done, so that a study that was cut off goes on where it was.

    (corpus, k, seed, m, silhouette, top_words) with a row for each m; :func:`study_summary` reads it.
    """
    try:
        done = {(r["corpus"], r["k"], r["seed"]) for r in spark.read.parquet(path).select("corpus", "k", "seed").distinct().collect()}  # a row a fit
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    for name, docs in corpora.items():
        counted, vec = TP.vectorize(docs)
        counted = counted.persist()
        for k in ks:
            for seed in seeds:
                if (name, k, seed) in done:
                    continue
                model = TP.fit_topics(counted, k, seed, rounds)
                phi = model.topicsMatrix().toArray().T
                sil = TP.choose_m(TP.cosine_distances(phi / phi.sum(1, keepdims=True)), m_range)[1]
                tops = ["|".join(w) for w in TP.top_words(model, vec.vocabulary)]
                spark.createDataFrame([(name, k, seed, int(m), float(s), tops) for m, s in sil.items()], "corpus string, k int, seed int, m int, silhouette double, top_words array<string>").coalesce(1).write.mode("append").parquet(path)
        counted.unpersist()
    return spark.read.parquet(path)


def study_summary(study: DataFrame, m: int = 5) -> DataFrame:
    """(corpus, k, seed, sil, best_m, best_sil, jaccard) for the gate: each seed's silhouette at m, its best one, and the mean overlap of its topics with those of the other seeds, matched one to one."""
    best = study.groupBy("corpus", "k", "seed").agg(F.min_by("m", F.struct(-F.col("silhouette"), F.col("m"))).alias("best_m"), F.max("silhouette").alias("best_sil"), F.max(F.when(F.col("m") == m, F.col("silhouette"))).alias("sil"), F.first("top_words").alias("top_words"))
    rows = best.collect()  # a row a fit
    out = []
    for r in rows:
        mine = [set(w.split("|")) for w in r["top_words"]]
        shares = []
        for o in rows:
            if (o["corpus"], o["k"]) == (r["corpus"], r["k"]) and o["seed"] != r["seed"]:
                theirs = [set(w.split("|")) for w in o["top_words"]]
                jac = np.array([[len(x & y) / len(x | y) for y in theirs] for x in mine])
                shares.append(float(np.mean([jac[p] for p in TP.match_best(jac)])))
        out.append((r["corpus"], r["k"], r["seed"], r["sil"], r["best_m"], r["best_sil"], float(np.mean(shares)) if shares else None))
    return study.sparkSession.createDataFrame(out, "corpus string, k int, seed int, sil double, best_m int, best_sil double, jaccard double")
