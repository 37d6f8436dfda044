from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import blocks, lexicon, similarity


def words(rng, n, letters="abcdé🙂 ", most=14):
    return ["".join(rng.choice(list(letters), rng.integers(0, most))) for _ in range(n)]


def test_matching_blocks_as_the_library_counts_them():
    rng = np.random.default_rng(9)
    a, b = words(rng, 600), words(rng, 600)
    for letters, size in (("ab", 260), ("abcdefghijklmnopqrstuvwxyz ", 420), ("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZäöü🙂", 900)):
        long = ["".join(rng.choice(list(letters), int(rng.integers(150, size)))) for _ in range(12)]
        a += long + long
        b += long[::-1] + [x[: len(x) // 2] + y[len(y) // 3 :] for x, y in zip(long, long[1:] + long[:1], strict=True)]
    want = [sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in zip(a, b, strict=True)]
    assert blocks.matching(a, b).tolist() == want
    assert blocks.matching([], []).tolist() == []


def test_ratio_and_bound(spark):
    rng = np.random.default_rng(4)
    pairs = list(zip(words(rng, 300), words(rng, 300), strict=True)) + [(None, "a"), ("a", None), ("", ""), ("x" * 500, "x" * 499 + "y")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    shared = blocks.shared_at_most(blocks.signature(F.col("a")), blocks.signature(F.col("b")))
    for r in df.select("*", blocks.ratio("a", "b").alias("r"), shared.alias("most")).collect():
        if r.a is None or r.b is None:
            assert r.r is None
            continue
        assert r.r == SequenceMatcher(None, r.a, r.b).ratio()
        assert 2 * r.most >= r.r * (len(r.a) + len(r.b)) - 1e-9


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7, 0.95])
def test_no_pair_is_lost(spark, least):
    rng = np.random.default_rng(6)
    asked = sorted(set(words(rng, 60, "abcdefgh", 12)))
    held = sorted(set(words(rng, 120, "abcdefgh", 12)))
    q = spark.createDataFrame([(x, ("k", None, "m")[i % 3]) for i, x in enumerate(asked)], "q string, kind string")
    labels = spark.createDataFrame([(x, f"u{i}", ["k"] if i % 2 else ["k", "m"]) for i, x in enumerate(held)], "label string, uri string, kinds array<string>")

    def score(a, b):
        return max(SequenceMatcher(None, a, b).ratio(), min(len(a), len(b)) / max(len(a), len(b)) if b and (a in b or b in a) else 0)

    want = {(x, k, f"u{j}"): score(x, y) for i, x in enumerate(asked) if x for k in [("k", None, "m")[i % 3]] for j, y in enumerate(held) if (k != "m" or j % 2 == 0) and score(x, y) >= least}
    got = {(r.q, r.kind, r.uri): r.similarity for r in similarity.find_matches(q, labels, 10_000, least).collect()}
    assert got == pytest.approx(want)


def test_labels_that_hold_a_query(spark):
    rng = np.random.default_rng(2)
    held, asked = words(rng, 200, "abc ", 20), sorted({w for w in words(rng, 80, "abc ", 6) if w} | {"a", "ab", "zz"})
    labels = spark.createDataFrame([(x, f"u{i}", ["k"]) for i, x in enumerate(held)], "label string, uri string, kinds array<string>")
    got = similarity.holding(spark.createDataFrame([(x, None) for x in asked], "q string, kind string"), labels)
    assert sorted((r.q, r.uri) for r in got.collect()) == sorted((x, f"u{i}") for x in asked for i, y in enumerate(held) if x in y)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_trigram_join_by_trying_every_pair(spark, least):
    rng = np.random.default_rng(8)
    asked, held = sorted(set(words(rng, 80, "abc", 9))), sorted(set(words(rng, 150, "abc", 9)))

    def grams(x):
        return {("  " + x + " ")[i : i + 3] for i in range(len(x) + 1)}

    want = {}
    for x in asked:
        near = [(-len(grams(x) & grams(y)) / len(grams(x) | grams(y)), y) for y in held if len(y) >= 5]
        best = min(near)
        if -best[0] >= least:
            want[x] = (best[1], -best[0])
    got = lexicon.trigram_join(spark.createDataFrame([(x,) for x in asked], "q string"), spark.createDataFrame([(x,) for x in held], "key string"), least)
    assert {r.q: (r.key, r.similarity) for r in got.collect()} == want


def test_long_labels_that_hold_long_queries(spark):
    """Queries of every size of window in labels of many pages: a row for each stretch of such a label with the label in it doesn't end."""
    rng = np.random.default_rng(4)
    held = ["".join(rng.choice(list("abcdé  "), 60_000)) for _ in range(40)] + ["", "é"]
    sizes = [1, 2, 3, 5, 31, 32, 33, 63, 64, 65, 127, 128, 129, 300, 5000, 60_000]
    asked = sorted({held[i][at : at + n] for i, n in enumerate(sizes) for at in (0, 777, 60_000 - n)} | {held[3][:200] + "z" + held[3][201:400], "é", "zz", ""})
    labels = spark.createDataFrame([(x, f"u{i}", ["k"]) for i, x in enumerate([*held, held[3]])], "label string, uri string, kinds array<string>")
    queries = spark.createDataFrame([(x, k) for x in asked for k in ("k", None)], "q string, kind string")
    want = sorted((x, k or "", f"u{i}") for x in asked if x for k in ("k", None) for i, y in enumerate([*held, held[3]]) if x in y)
    got = similarity.holding(queries, labels)
    assert sorted((r.q, r.kind or "", r.uri) for r in got.select("q", "kind", "uri").collect()) == want


def test_more_queries_than_are_broadcast(spark):
    rng = np.random.default_rng(2)
    held, asked = words(rng, 200, "abc ", 20), sorted({w for w in words(rng, 80, "abc ", 6) if w} | {"a", "ab", "zz"})
    labels = spark.createDataFrame([(x, f"u{i}", ["k"]) for i, x in enumerate(held)], "label string, uri string, kinds array<string>")
    queries = spark.createDataFrame([(x, None) for x in asked], "q string, kind string")
    one, two = (sorted((r.q, r.label, r.uri) for r in similarity.holding(queries, labels, most_queries=n).collect()) for n in (0, 1000))
    assert one == two


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_trigram_join_of_long_texts(spark, most):
    """Long texts on both sides, by both ways; rows of a text for each of its trigrams would hold a hundred times the input."""
    rng = np.random.default_rng(5)
    base = words(rng, 60, "abcdéf 😀", 3000)
    held = [*base, *[b[: len(b) // 2] + w for b, w in zip(base, words(rng, 60, "abcdéf 😀", 900), strict=True)], "abcd", "abcde"]
    asked = [b[3:200] for b in base if len(b) > 300] + ["abcde", "", "😀"]

    def grams(x):
        return {("  " + x + " ")[i : i + 3] for i in range(len(x) + 1)}

    sets, want = {y: grams(y) for y in held if len(y) >= 5}, {}
    for x in asked:
        score, y = min((-len(grams(x) & g) / len(grams(x) | g), y) for y, g in sets.items())
        if -score >= 0.3:
            want[x] = (y, -score)
    q, k = spark.createDataFrame([(x,) for x in asked], "q string"), spark.createDataFrame([(x,) for x in held], "key string")
    got = lexicon.trigram_join(q, k, 0.3, most_trigrams=most)
    assert {r.q: (r.key, r.similarity) for r in got.collect()} == want
