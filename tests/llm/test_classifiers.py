import numpy as np
import pytest

from spanloom.llm.quality import STATISTICS, fit_quality, pool_adjacent, score_documents, statistics
from spanloom.llm.toxicity import GRADES, ToxicityModel, fit_ordinal, fit_toxicity, score_toxicity, telling, terms_of


def auc(score, y):
    s, y = np.asarray(score), np.asarray(y)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


@pytest.fixture(scope="module")
def tables(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    rows = score_documents(docs, fit_quality(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert auc([r.score for r in out], [r.quality for r in out]) > 0.95
    assert np.mean([r.predicted == r.quality for r in out]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    rows = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert auc([r.expected_severity for r in out], [r.toxic for r in out]) > 0.8
    assert np.mean([r.predicted for r in out if not r.toxic]) < 0.05
    assert all(0 <= r.expected_severity <= 3 and r.grade in range(GRADES) for r in rows)


def test_isotonic_regression_is_the_least_squares_fit():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = 30
        y, w = rng.normal(size=n), rng.integers(1, 4, n).astype(float)
        x, level = pool_adjacent(np.arange(n), y, w)
        assert (np.diff(level) > 0).all() and (np.diff(x) > 0).all()
        # max over starts of min over ends of the weighted means
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(sorted(set(np.round(want, 9))), np.round(level, 9))


def test_ordinal_gradient_finds_ordered_thresholds():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        has = rng.random(3) < 0.3
        s = has @ np.array([1.0, 2.0, -1.0]) + rng.logistic() * 0.7
        rows.append((np.flatnonzero(has), np.zeros(has.sum()), int((s > np.array([0.5, 1.5, 2.5])).sum())))
    present, _, t = fit_ordinal(rows, 3, l2=0.0)
    assert (np.diff(t) > 0).all()
    assert np.allclose(present, np.array([1.0, 2.0, -1.0]) / 0.7, atol=0.4)
    assert np.allclose(t, np.array([0.5, 1.5, 2.5]) / 0.7, atol=0.4)


def test_telling_and_terms():
    g = telling(np.array([10.0, 1.0, 0.0]), np.array([0.0, 10.0, 0.0]), 10, 100)
    assert g[0] > 20 and g[1] == 0 and g[2] == 0
    assert terms_of("word") == ["word"] and terms_of("wordy") == ["wordy", "word-"]


def test_statistics_of_odd_texts():
    for t in (None, "", " \n\t", "a", "|", "é" * 3, "\ud800", "x" * 100_000):
        v = statistics(t)
        assert len(v) == len(STATISTICS) and np.isfinite(v).all()


def test_odd(spark, sf, odd, clashing, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    none = labels.limit(0)
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (3, 1, 1), (3, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, none, nulls):
        q, t = fit_quality(odd, known), fit_toxicity(odd, known)
        for docs in (odd, clashing):
            rows = score_documents(docs, q).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
            assert len(score_toxicity(docs, t).collect()) == odd.count()
    assert {r.score for r in score_documents(odd, fit_quality(odd, none)).collect()} == {0.5}
    assert {r.grade for r in score_toxicity(odd, ToxicityModel()).collect()} == {0}
    assert score_documents(empty, fit_quality(empty, labels)).collect() == []
    assert score_toxicity(empty, fit_toxicity(empty, labels)).collect() == []
