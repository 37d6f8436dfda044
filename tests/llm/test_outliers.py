import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.outliers import COUNTS, FLOORS, SIZE, chi_quantile, consistency, judge, keep_ordinary, repeated_words, statistics

from .conftest import SCHEMA


def naive(text):
    """The base statistics by their definitions, with regular expressions and loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def quadratic(x, centre, precision):
    d = x - centre
    return np.einsum("ni,ij,nj->n", d, precision, d)


def lower_median(v):
    return np.sort(v)[(len(v) + 1) // 2 - 1]


def brute_estimate(x, share=0.75, floors=FLOORS, steps=5):
    """The minimum covariance determinant of rows, one row at a time rather than by counts and bins' sums."""
    floor = np.diag(np.square(np.array(floors, float)))
    about = np.array([lower_median(c) for c in x.T], float)
    unit = np.maximum(np.array(floors, float), 1.4826 * np.array([lower_median(np.abs(c - m)) for c, m in zip(x.T, about, strict=True)]))
    z = (x - about) / unit
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    starts = []
    for k, scores in enumerate((None, np.tanh(z), np.divide(z, norm, out=np.zeros_like(z), where=norm > 0))):
        c = np.eye(SIZE)
        if scores is not None:
            c = scores.T @ scores / len(x)
            root = np.sqrt(np.maximum(np.diag(c), 1e-12))
            c = c / root / root[:, None]
        starts.append([k, about, c * unit * unit[:, None] + floor, True])
    for step in range(steps):
        if step == 2:
            starts = [min(starts, key=lambda s: (np.linalg.slogdet(s[2])[1], s[0]))]
        for s in starts:
            if s[3]:
                was = np.linalg.slogdet(s[2])[1]
                s[1], s[2] = subset(x, s[1], s[2], share, floor, 1.0)
                s[3] = abs(np.linalg.slogdet(s[2])[1] - was) > 1e-4
    best = min(starts, key=lambda s: (np.linalg.slogdet(s[2])[1], s[0]))
    centre, scatter = subset(x, best[1], best[2], share, floor, consistency(share))
    near = x[quadratic(x, centre, np.linalg.inv(scatter)) <= chi_quantile(0.975, SIZE)]
    return near.mean(0), np.linalg.inv(np.cov(near.T, bias=True) * consistency(0.975) + floor)


def subset(x, centre, scatter, share, floor, factor):
    bins = np.floor(64 * np.log1p(quadratic(x, centre, np.linalg.inv(scatter))))
    wanted = np.sort(bins)[int(np.ceil(share * len(x))) - 1]
    near = x[bins <= wanted]
    return near.mean(0), np.cov(near.T, bias=True) * factor + floor


def made_documents(n=700, seed=5):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(1, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(w.capitalize() if rng.random() < 0.1 else w for w in rng.choice(words, rng.integers(15, 120)))
        if i % 5 == 0:
            text = text.replace(" ", ".\n", int(rng.integers(1, 5)))
        if i % 23 == 0:
            text = text.replace(" ", "### ")
        if i % 29 == 0:
            text = text.upper()
        rows.append((i, text, "de" if i % 3 == 0 else "en" if i % 17 else None, f"s{i % 7 % 3}", len(text)))
    return rows


def test_repeated_words():
    rng = np.random.default_rng(1)
    texts = [[b"w%d" % w for w in rng.integers(0, 2 if k % 3 else 40, rng.integers(0, 60))] for k in range(200)] + [[b"a"] * 500, [], [b"x"] * 8, [b"x"] * 9]
    assert repeated_words(texts).tolist() == [naive(" ".join(w.decode() for w in t))[4] for t in texts]
    assert repeated_words([]).tolist() == [] and repeated_words([[b"a"]]).tolist() == [0]


def test_statistics(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd, docs.withColumn("text", F.concat("text", F.lit("\n \x85   x\r\nx\r\n <b> 　"), "text"))):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in statistics(df).collect():
            assert tuple(r[c] for c in COUNTS) == naive(texts[r.doc_id])


def test_brute_force(spark):
    rows = made_documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r.doc_id: r for r in statistics(df).collect()}
    x = {i: np.array([r[f"x{k}"] for k in range(SIZE)], float) for i, r in found.items()}
    failed = {i: r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words for i, r in found.items()}
    least, made = 60, {}
    for key in {k for r in found.values() for k in ((r.lang, r.source), (r.lang,), ())}:
        inside = [x[i] for i, r in found.items() if not failed[i] and (r.lang, r.source)[: len(key)] == key]
        if len(inside) >= least or not key:
            made[key] = brute_estimate(np.array(inside))
    assert {len(k) for k in made} == {0, 1, 2} and len([k for k in made if len(k) == 2]) > 2
    got = judge(df, least=least, steps=5).collect()
    assert sorted(r.doc_id for r in got) == sorted(found)
    rejected = 0
    for r in got:
        f = found[r.doc_id]
        key = next(k for k in ((f.lang, f.source), (f.lang,), ()) if k in made)
        d = quadratic(x[r.doc_id][None], *made[key])[0]
        assert len(key) == r.judged_by and r.base_failed == failed[r.doc_id]
        assert r.distance == pytest.approx(d, rel=1e-6, abs=1e-6)
        assert r.kept == (not failed[r.doc_id] and d <= chi_quantile(1 - 1e-6, SIZE))
        rejected += not r.base_failed and not r.kept
        assert r.base_failed or r.kept == (r.doc_id % 23 != 0 and r.doc_id % 29 != 0)
    assert rejected > 20


def test_rejects_what_labels_call_bad(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    kept = dict(map(tuple, rows))
    assert kept[1] >= 0.99 and kept[0] <= 0.3


def test_odd_rows(spark, odd, clashing, empty):
    got = judge(odd, steps=1).drop("distance").collect()
    assert len(got) == odd.count()
    assert all(r.kept <= (not r.base_failed) for r in got)
    assert sorted(map(tuple, judge(clashing, steps=1).drop("distance").collect()), key=str) == sorted(map(tuple, got), key=str)
    assert judge(empty, steps=1).collect() == []
    few = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, None)], SCHEMA)
    assert [(r.base_failed, r.kept, r.distance) for r in judge(few, steps=1).collect()] == [(True, False, None)] * 2
    # a group of equal documents agrees exactly; all of it is kept
    same = spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(40)), "en", "s", 1) for i in range(150)], SCHEMA)
    assert all(r.kept for r in judge(same, steps=2).collect())


def test_keep_ordinary(spark):
    df = spark.createDataFrame(made_documents(), SCHEMA)
    kept = keep_ordinary(df.withColumn("distance", F.lit("x")), steps=2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judge(df, steps=2).where("kept").collect())
    assert kept.columns == [*df.columns, "distance"]


def test_quantiles():
    for p, degrees, x in ((0.975, 6, 14.449375), (0.5, 6, 5.348121), (0.95, 8, 15.507313), (0.99, 2, 9.210340)):
        assert chi_quantile(p, degrees) == pytest.approx(x, abs=1e-5)
