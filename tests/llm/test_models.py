"""Learned operators by held-out figures, and their parts against brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidworks.llm import langmix, puquality, toxicity
from braidworks.llm.common import bounded_sample, held_out

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    return read("documents"), read("labels")


def test_fold_is_crc32_of_the_id(spark):
    got = spark.createDataFrame([(i,) for i in [*range(-20, 200), None]], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_samples_are_bounded_whatever_repeats(spark):
    many = spark.range(100_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"), (F.col("id") % 2 == 0).alias("kind"))
    got = bounded_sample(many, 1000).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(0, "text 0"), (1, "text 0")]
    mixed = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "few").when(F.col("id") < 40_000, "many").alias("kind"))
    sizes = lambda df: {r.kind: r["count"] for r in df.groupBy("kind").count().collect()}
    sample = bounded_sample(mixed.unionByName(mixed), 3000, "kind")
    assert sizes(sample) == {"few": 3000, "many": 3000, None: 3000} and sample.distinct().count() == 9000
    assert sizes(bounded_sample(mixed, 10**6, "kind")) == sizes(mixed)
    assert bounded_sample(mixed.limit(0), 5, "kind").count() == 0 and bounded_sample(many.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="strata"):
        bounded_sample(mixed.withColumn("kind", F.col("doc_id") % 300), 5, "kind")


def test_language_held_out_accuracy(tables):
    documents, _ = tables
    got = langmix.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert right.a > 0.99 and 0 < right.low <= right.high <= 1


def test_mixtures_are_found(tables):
    documents, _ = tables
    model = langmix.train(documents)
    parts = {r.lang: r.t for r in documents.where("doc_id % 7 = 0 and n_chars > 3000").groupBy("lang").agg(F.first("text").alias("t")).collect()}
    chosen, share = model.infer(parts["en"][:2000] + " " + parts["fr"][:1000])
    found = dict(zip((model.languages[c] for c in chosen), share))
    assert set(found) >= {"en", "fr"} and abs(found["en"] - 2 / 3) < 0.1 and abs(found["fr"] - 1 / 3) < 0.1
    assert [model.languages[c] for c in model.infer(parts["de"])[0]] == ["de"]


def test_proportions_match_plain_expectation_maximisation():
    draw = np.random.default_rng(8)
    p = draw.dirichlet(np.ones(40) * 0.2, 3) + 1e-6
    model = langmix.Model(["a", "b", "c"], p / p.sum(axis=1, keepdims=True))
    counts = draw.multinomial(4000, 0.7 * model.p[0] + 0.3 * model.p[2]).astype(float)
    buckets = np.flatnonzero(counts)
    share, likelihood = model.mixture(buckets, [0, 1, 2], counts[buckets])
    plain = [1 / 3] * 3
    for _ in range(500):
        new = [0.0] * 3
        for b in buckets:
            parts = [plain[k] * model.p[k, b] for k in range(3)]
            for k in range(3):
                new[k] += counts[b] * parts[k] / sum(parts)
        plain = [x / sum(new) for x in new]
    best = sum(counts[b] * np.log(sum(plain[k] * model.p[k, b] for k in range(3))) for b in buckets)
    assert np.abs(share - plain).max() < 0.02 and best - likelihood < 0.5


def test_equal_likelihoods_go_to_the_first_language_and_long_texts_are_whole(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("ab ab", "yy"), ("ab ab", "xx"), ("cd cd", "zz")] * 9)]
    df = spark.createDataFrame([*rows, (1000, "ab", None), (1001, "cd " * 400_000 + "ab " * 500_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langmix.identify(df).where("doc_id >= 1000").collect()}
    assert got[1000].lang_pred == "xx"
    assert got[1001].lang_pred in ("xx", "yy") and set(got[1001].languages) >= {"zz"} and abs(got[1001].score - 5 / 9) < 0.05


def test_language_edge_cases(spark):
    rows = [(1, "ab ab ab", "xx", "c"), (2, "cd cd cd", "yy", "c"), (3, None, "xx", "c"), (4, "12 34 !!", "xx", "c"), (5, "", None, "c"), (6, "ab ab", None, "c"), (None, "cd", "yy", "c"), (1, "ab ab ab", "xx", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang_pred) for r in langmix.identify(df).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "xx")} <= got and len(got) == 7
    none = langmix.identify(df.where("lang is null")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langmix.identify(df.limit(0)).count() == 0


def auc(score, label):
    a, b = np.sort(score[label]), np.sort(score[~label])
    return (np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).sum() / 2 / len(a) / len(b)


def test_quality_held_out(tables):
    documents, labels = tables
    got = puquality.score_quality(documents, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy() == 1) > 0.99
    assert (got.predicted == got.quality).mean() > 0.98


def test_risk_is_estimated_without_negatives():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(0, 1, (3000, 3)), draw.normal(3, 1, (1000, 3))
    model = puquality.fit(good[:1500], np.concatenate([good[1500:], bad]), prior=0.6)
    assert (model.score(good[:500]) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.9


def test_class_prior_is_found_without_negatives():
    draw = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.85):
        good, bad = draw.normal(0, 1, (3000, 6)), draw.normal(2.5, 1, (3000, 6))
        n = int(3000 * share)
        assert abs(puquality.estimated_prior(good[:2000], np.concatenate([draw.normal(0, 1, (n, 6)), bad[: 3000 - n]])) - share) < 0.1


def test_fit_lowers_the_risk_to_a_direct_minimisers():
    """The risk as defined, summed up by hand; the fit's is near the least that plain descent by differences finds."""
    draw = np.random.default_rng(6)
    good, bad = draw.integers(0, 3, (400, 2)).astype(float), draw.integers(1, 5, (400, 2)).astype(float)
    positive, unlabelled, prior = good[:200], np.concatenate([good[200:], bad]), 1 / 3
    model = puquality.fit(positive, unlabelled, prior)
    p, u = model.encode(positive), model.encode(unlabelled)

    def risk(w):
        zp, zu = w[p].sum(axis=1) + w[-1], w[u].sum(axis=1) + w[-1]
        loss = lambda z: np.log1p(np.exp(-z))
        return prior * loss(zp).mean() + max(0.0, loss(-zu).mean() - prior * loss(-zp).mean())

    w = np.zeros(len(model.weights))
    for step in range(400):
        slope = np.array([(risk(w + 1e-5 * e) - risk(w - 1e-5 * e)) / 2e-5 for e in np.eye(len(w))])
        w -= slope * 2.0
    assert risk(model.weights) < risk(np.zeros(len(w))) and risk(model.weights) <= risk(w) + 0.02


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a", "x"), (2, "", "x"), (3, "word " * 50_000, "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert puquality.score_quality(docs, labels).count() == 5
    got = puquality.score_quality(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    assert puquality.score_quality(docs.limit(0), labels).count() == 0


def test_toxicity_held_out(tables):
    documents, labels = tables
    got = toxicity.grade_toxicity(documents, labels).where("held_out").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    toxic = got.label.to_numpy() == 1
    assert auc(got.score.to_numpy(), toxic) > 0.95
    assert got.toxic[toxic].mean() > 0.85 and got.toxic[~toxic].mean() < 0.02
    assert ((got.expected_severity >= 0) & (got.expected_severity <= 2)).all()


def test_one_weight_vector_serves_ordered_thresholds():
    draw = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(600):
        g = int(draw.integers(0, 3))
        words = [0] * 0 + list(draw.integers(100, 160, 12)) + list(draw.integers(0, 3, g * 3))
        at, n = np.unique(words, return_counts=True)
        rows.append((at, 0.5 + np.log1p(100 * n / len(words))))
        grades.append(g)
    model = toxicity.fit(rows, np.array(grades))
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) == 2
    reach = np.array([model.reach(model.evidence(r)) for r in rows])
    assert (np.diff(reach, axis=1) <= 0).all()
    assert np.corrcoef(reach.sum(axis=1), grades)[0, 1] > 0.9


def test_gradients_lead_to_the_likeliest_weights():
    """One feature, two thresholds: the fit's likelihood is near the best on a grid."""
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2, 900)
    grades = np.where(x == 1, draw.choice(3, 900, p=[0.1, 0.3, 0.6]), draw.choice(3, 900, p=[0.8, 0.15, 0.05]))
    model = toxicity.fit([(np.array([7]) if v else np.zeros(0, np.int64), np.ones(int(v))) for v in x], grades, l1=0.0)
    s = lambda z: 1 / (1 + np.exp(-z))

    def loss(w, a, b):  # cumulative: each threshold's own logistic loss
        return sum(-np.log(np.where(grades >= k, s(w * x - t), 1 - s(w * x - t))).mean() for k, t in ((1, a), (2, b)))

    grid = min(loss(w, a, b) for w in np.arange(1, 5, 0.1) for a in np.arange(0, 4, 0.2) for b in np.arange(1, 5, 0.2))
    assert loss(model.weights[0], *model.thresholds) < grid + 0.01


def test_a_texts_grade_comes_from_the_other_half():
    rows = [(np.array([1]), np.array([0.5 + np.log1p(100 * d)])) for d in (0.1, 0.1, 0.5, 0.5)] * 20 + [(np.array([2]), np.array([0.5]))] * 80
    toxic = np.arange(160) < 80
    grades = toxicity.density_grades(rows, toxic)
    assert grades[:80].tolist() == [1, 1, 2, 2] * 20 and not grades[80:].any()
    assert toxicity.density_grades(rows[:2], toxic[:2]).tolist() == [1, 1]


def test_evidence_by_words_is_evidence_by_features():
    model = toxicity.Model(np.sort(np.array(toxicity.word_buckets("stupid") + toxicity.word_buckets("über"))), np.arange(1.0, 6.0)[: len(toxicity.word_buckets("stupid") + toxicity.word_buckets("über"))], np.array([1.0, 2.0]))
    for text in ("stupid Über stupider", "", "nothing here", "stup ÜBER " * 40):
        assert abs(model.evidence(toxicity.features(text)) - model.evidence_of(text, {})) < 1e-9


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "idiot", "x"), (2, "", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.grade_toxicity(docs, labels).count() == 4
    assert not any(r.toxic for r in toxicity.grade_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.grade_toxicity(docs.limit(0), labels).count() == 0
