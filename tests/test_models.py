"""Model bundles, studies of many fits, and comparisons of models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.catalog import QUERIES
from brindle.operators import compare, lineage, topics, variational
from brindle.plans import bundle, compare_queries, entity_queries
from brindle.sources import sinks


@pytest.fixture(scope="module")
def docs(spark):
    groups = (["fan", "club", "gift", "badge"], ["tour", "hall", "seat", "stage"], ["album", "chart", "song", "sales"])
    return spark.createDataFrame([(i, f"e{i % 5}", [w for w in groups[i % 3] for _ in range(1 + (i + len(w)) % 3)]) for i in range(60)], "doc long, entity string, words array<string>").cache()


def test_bundle_reloads_as_written(spark, docs, tmp_path):
    path = f"file://{tmp_path}/b"
    out = bundle.write_bundle(spark, docs, path, 4, 1, 10, range(2, 4))
    assert out["m"] in (2, 3) and len(out["top_words"]) == 4
    assert {r.label: r.ok for r in bundle.reload_equals(spark, path, docs).collect()} == {"files": True, "topics": True}
    voc = {r.term: (r.df, r.tf) for r in spark.read.parquet(f"{path}/vocabulary").collect()}
    assert voc["fan"][0] == 20 and voc["fan"][1] >= 20
    assert spark.read.parquet(f"{path}/linkage").count() == 3 and spark.read.parquet(f"{path}/distances").count() == 16
    spark.createDataFrame([(1,)], "x int").write.mode("append").parquet(f"{path}/m_grid_more")
    assert {r.label: r.ok for r in bundle.reload_equals(spark, path, docs).collect()} == {"files": False, "topics": True}


def test_study_is_taken_up_again(spark, docs, tmp_path):
    path = f"file://{tmp_path}/s"
    one = bundle.seed_study(spark, {"live": docs}, [4], [1], path, 3, range(2, 4))
    assert one.count() == 2
    study = bundle.seed_study(spark, {"live": docs}, [4], [1, 2], path, 3, range(2, 4))
    assert study.count() == 4 and study.select("seed").distinct().count() == 2
    s = bundle.study_summary(study, m=3)
    rows = s.collect()
    assert len(rows) == 2 and all(0 <= r.jaccard <= 1 and r.best_sil >= r.sil for r in rows)
    assert lineage.gate(s, -1.0, jaccard=0.0, m=3).count() == 1


def test_alignment_of_permuted_topics():
    phi = np.random.default_rng(1).random((4, 6))
    words = [f"w{i}" for i in range(6)]
    tops = [[words[i] for i in np.argsort(-row)[:3]] for row in phi]
    perm = [2, 0, 3, 1]
    a = {w: phi[:, i] for i, w in enumerate(words)}
    b = {w: phi[perm][:, i] for i, w in enumerate(words)}
    for i, j, jac, cos, partner, mutual in compare.align(tops, a, [tops[p] for p in perm], b):
        assert perm[j] == i and partner == j and mutual and jac == 1.0 and cos == pytest.approx(1.0)


def test_comparisons(spark):
    a = spark.createDataFrame([("r1", 1), ("swap_r2_p2", 2)], "round string, x int")
    b = spark.createDataFrame([("merge_log_r1", 5), ("r2", 6), ("r2_p2", 7)], "round string, y int")
    assert sorted((r.x, r.y) for r in compare.by_round(a, b).collect()) == [(1, 5), (2, 7)]
    g = spark.createDataFrame([(4, 10.0, 1.0, 0.5, 0.4)], "k int, perplexity double, coherence double, diversity double, stability double")
    r = compare.compare_fits(g, g.withColumn("perplexity", F.lit(12.0))).first()
    assert (r.d_perplexity, r.d_coherence) == (2.0, 0.0)
    c = compare.correlations(spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0)], "x double, y double, z double"), ("x", "y"), ("x", "z")).collect()
    assert c[0].r == pytest.approx(1.0) and c[1].r is None
    s = spark.createDataFrame([("a", "F1", 1.0), ("b", "F1", 0.5), ("b", "F2", 0.5)], "entity string, factor string, share double")
    assert {x.factor: x.r for x in compare.by_factor(s, s).collect()} == {"F1": pytest.approx(1.0), "F2": pytest.approx(1.0)}
    fr = spark.createDataFrame([("the", "en", 7.0), ("la", "es", 7.0), ("hall", "en", 5.0)], "word string, lang string, zipf double")
    it = spark.createDataFrame([(1, "The hall"), (2, "la x"), (3, "zz")], "bullet_id long, t string")
    assert {x.bullet_id: (x.lang, x.margin) for x in compare.frequency_language(it, fr).collect()} == {1: ("en", 6.0), 2: ("es", 7.0)}
    md = sinks.markdown(spark.createDataFrame([("a|b", 0.12345, None)], "x string, y double, z int"))
    assert md.splitlines()[2] == "| a\\|b | 0.1234 |  |" or md.splitlines()[2] == "| a\\|b | 0.1235 |  |"


def test_vocabulary_is_whole_or_refused(spark, docs):
    assert len(topics.vectorize(docs)[1].vocabulary) == 12
    with pytest.raises(ValueError):
        topics.vectorize(docs, most=11)


def test_grid_of_topics_is_that_of_the_method(monkeypatch, spark, docs):
    fits = []
    real = topics.fit_topics

    def fit(counted, k, seed, rounds=50):
        fits.append((k, seed, rounds))
        return real(counted, k, seed, 1)

    monkeypatch.setattr(entity_queries, "bullets", lambda spark, d: None)
    monkeypatch.setattr(topics, "words_of", lambda items: (docs, None))
    monkeypatch.setattr(topics, "fit_topics", fit)
    assert entity_queries.lda_grid(spark, "").count() == 7
    assert fits == [(k, s, 50) for k in (8, 10, 12, 15, 20, 25, 30) for s in (1, 2, 3)]


def test_fits_are_begun_as_the_driver_has_memory(monkeypatch, spark, docs):
    """What the driver holds of topics x terms at once is bounded, whatever the number of fits; small ones are begun side by side."""
    held, most = set(), []

    class Fit:
        def __init__(self, k):
            held.add(id(self))
            most.append(len(held))

        def topics(self):
            return None

        def __del__(self):
            held.discard(id(self))

    monkeypatch.setattr(topics, "fit_topics", lambda counted, k, seed, rounds=50: Fit(k))
    jobs = [(k, s) for k in (8, 10, 12) for s in (1, 2, 3)]
    for terms, want in ((12, 9), (1_000_000, 2)):
        most.clear()
        assert [k for k, m in topics.fits(None, jobs, terms)] == [k for k, _ in jobs]
        assert max(most) <= want and (want < 9 or max(most) == 9)


def test_topics_take_four_bytes_a_cell(monkeypatch, spark, docs):
    """Nothing of the size of topics x terms is made in eight bytes at the driver while the rounds run."""
    monkeypatch.setattr(variational, "SMALL", 0)
    seen, real = [], variational._weights
    monkeypatch.setattr(variational, "_weights", lambda lam: seen.append(lam.dtype) or real(lam))
    counted, vec = topics.vectorize(docs)
    model = topics.fit_topics(counted, 4, 1, 3)
    model.topicsMatrix()
    assert set(seen) == {np.dtype(np.float32)}
    row = np.array([1.0, 3.0, 3.0, 2.0, 3.0])
    words = ["e", "d", "c", "b", "a"]
    assert [topics._heaviest(row, words, n) for n in (0, 1, 2, 4, 9)] == [[], [4], [4, 2], [4, 2, 1, 3], [4, 2, 1, 3, 0]]


def test_best_match_of_every_cloud(monkeypatch, spark):
    """Every cloud has a row, and one of the same parity may be the best."""
    rows = [(1, "e", ["a", "b", "c"]), (3, "e", ["a", "b", "d"]), (2, "e", ["a", "x"]), (4, "e", ["z"]), (5, "f", ["a", "b", "c"])]
    monkeypatch.setattr(compare_queries, "_cloud", lambda spark, d: spark.createDataFrame(rows, "cloud_id long, entity string, words array<string>"))
    assert sorted(tuple(r) for r in QUERIES["cloud_best_of_all"](spark, "").collect()) == [(1, 3, 2), (2, 1, 1), (3, 1, 2)]


def test_bootstraps_draw_as_often_as_the_method(monkeypatch, spark):
    """2,000 draws are registered."""
    reps = []
    monkeypatch.setattr(entity_queries, "scores", lambda spark, d: spark.createDataFrame([(f"e{i}", i / 9, (i * 7 % 10) / 9, i * 2.0, i) for i in range(10)], "entity string, loyalty_score double, spillover_score double, loyalty_raw double, activity long"))
    real = entity_queries.RS.bootstrap
    monkeypatch.setattr(entity_queries.RS, "bootstrap", lambda spark, e, n, seed=0: reps.append(n) or real(spark, e, n, seed))
    QUERIES["bootstrap_r"](spark, "")
    QUERIES["bootstrap_difference"](spark, "")
    assert reps == [2000, 2000]


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_rounds_pass_over_every_document_once(monkeypatch, spark, docs, small):
    """Topics x terms hold every token once, however the documents are spread and whether a fit is one task or many."""
    monkeypatch.setattr(variational, "SMALL", small)
    vec = topics.vectorize(docs)[1]
    lam = [topics.fit_topics(vec.transform(docs.repartition(n)), 4, 1, 3).topicsMatrix().toArray() for n in (1, 3)]
    tokens = docs.selectExpr("sum(size(words))").first()[0]
    assert lam[0].shape == (12, 4)
    for x in lam:
        assert x.sum() == pytest.approx(tokens + 12, rel=1e-5)  # each topic has a prior of 1 / 4 for each term
    assert lam[0] == pytest.approx(lam[1], rel=1e-2, abs=1e-2)


def test_shares_and_perplexity_are_those_of_spark(spark, docs):
    more = docs.select("doc", "words").unionByName(spark.createDataFrame([(99, [])], "doc long, words array<string>"))
    counted, _ = topics.vectorize(more)
    model = topics.fit_topics(counted, 3, 1, 20)
    same = model.as_spark()
    assert topics.perplexity(model, counted) == pytest.approx(np.exp(same.logPerplexity(counted)), rel=1e-2)
    want = {r.doc: r.topicDistribution.toArray() for r in same.transform(counted).collect()}
    for r in topics.theta(model, counted).collect():
        assert r.weight == pytest.approx(want[r.doc][r.topic], abs=0.02)


def test_functions_of_gamma():
    x = np.array([0.03, 0.5, 1.0, 7.5, 1e4])
    assert variational.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)
    assert np.log(variational.exp_digamma(x)) == pytest.approx([(math.lgamma(v * (1 + 1e-6)) - math.lgamma(v * (1 - 1e-6))) / (2e-6 * v) for v in x], rel=1e-5)
