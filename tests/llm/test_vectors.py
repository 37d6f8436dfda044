import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.cap_filters import ProductCodes, link, smallest_common
from spanloom.llm.common import components, local_roots
from spanloom.llm.threshold_search import SortedLists, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k=5, every=50):
    v = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q in {i for i, _ in v if i % every == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for i, a in v if i == q for c, b in v if c != q)[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def brute_links(rows, least=0.93):
    n = len(rows)
    x = [None if i[2] is None or i[1] is None or any(y is None or not np.isfinite(y) for y in i[1]) or not any(i[1]) else np.array(i[1], np.float32).astype(float) for i in rows]
    x = [None if y is None else y / np.linalg.norm(y) for y in x]
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= least]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        root[find(a)] = find(b)
    low = {}
    for i in range(n):
        r = find(i)
        ids = [v for v in (low.get(r), rows[i][0]) if v is not None]
        low[r] = min(ids) if ids else None
    return sorted(((rows[i][0], links[i], low[find(i)], rows[i][0] is not None and rows[i][0] == low[find(i)]) for i in range(n)), key=str)


def near_copies(seed=1, clusters=30, size=8, dims=64):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for c in range(clusters):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for k in range(size):
            v = centre + rng.normal(size=dims) * rng.choice([0.0, 0.01, 0.024])
            rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], c % 3))
            i += 1
    return rows


ODD = [
    (0, [1.0, 0.0, 0.5], 1),
    (0, [1.0, 0.0, 0.5], 1),
    (50, [-1.0, 0.25, 0.5], 1),
    (100, [0.0, 0.0, 0.0], 1),
    (150, None, 1),
    (200, [1.0, None, 0.5], 1),
    (250, [float("nan"), 0.0, 0.5], 1),
    (300, [float("inf"), 0.0, 0.5], 1),
    (3, [2.0, 0.0, 1.0], None),
    (None, [2.0, 0.0, 1.0], 1),
    (4, [2.0, 0.0, 1.0], 1),
    (5, [2.0, 0.0], 1),
    (6, [], 1),
    (7, [2.0, 0.0, 1.0], 2),
]


def test_search(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    want = brute_top(rows)
    assert sorted(map(tuple, search(vectors).collect())) == want
    assert sorted(map(tuple, search(vectors, block=60).collect())) == want


def test_search_stops_early():
    rng = np.random.default_rng(2)
    x = (rng.pareto(1.0, size=(4000, 4)) * 100).astype(np.int64)
    lists = SortedLists(np.arange(4000), x)
    for q in rng.integers(-3, 9, size=(20, 4)):
        got, scored = lists.top(q, 5)
        s = x @ q
        assert got == [(int(s[i]), int(i)) for i in np.lexsort((np.arange(4000), -s))[:5]]
    assert lists.top(np.array([1, 1, 1, 1]), 5)[1] < 2000


def test_search_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert sorted(map(tuple, search(df).collect())) == brute_top(ODD)
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("c", "asks", "v", "q", "rank", "score", "query_id", "n")])
    assert sorted(map(tuple, search(clashing, block=2).collect())) == brute_top(ODD)
    assert search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert search(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).collect() == []
    repeated = [(0, [1.0, 2.0], 1), (0, [0.5, -1.0], 1), (7, [3.0, 0.5], 1), (7, [0.0, -2.0], 1), (50, [-1.0, 0.0], 1), (3, [0.25, 0.25], 1)]
    assert sorted(map(tuple, search(spark.createDataFrame(repeated, SCHEMA)).collect())) == brute_top(repeated)
    with pytest.raises(Exception, match="64-bit"):
        search(spark.createDataFrame([(0, [1e9, 1e9], 1), (1, [1e9, 1e9], 1)], SCHEMA)).collect()


def test_links(spark, sf):
    for rows in (near_copies(), [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]):
        df = spark.createDataFrame(rows, SCHEMA)
        want = brute_links(rows)
        assert sorted(map(tuple, link(df).collect()), key=str) == want
        assert sorted(map(tuple, link(df, block=3).collect()), key=str) == want


def test_links_odd(spark):
    assert sorted(map(tuple, link(spark.createDataFrame(ODD, SCHEMA)).collect()), key=str) == brute_links(ODD)
    clashing = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("cid", "v", "n", "low", "d", "f", "held", "own", "root", "links", "n_links", "kept")])
    assert sorted(map(tuple, link(clashing).collect()), key=str) == brute_links(ODD)
    assert link(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_of_large_groups_of_near_copies(spark):
    rows = near_copies(clusters=4, size=140)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_links(rows)
    assert max(r[1] for r in want) > 100
    for block in (2048, 50):
        assert sorted(map(tuple, link(df, block=block).collect()), key=str) == want


def test_smallest_common_filter():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lists, group, this, pairs = [], [], [], []
        for g in range(int(rng.integers(1, 6))):
            f, first = int(rng.integers(50, 400)), len(lists)
            for _ in range(int(rng.integers(2, 30))):
                lists.append(np.unique(np.append(rng.integers(0, 400, size=rng.integers(0, 40)), f)))
                group.append(g)
                this.append(f)
            pairs += [(i, j) for i in range(first, len(lists)) for j in range(i + 1, len(lists))]
        a, b = np.array(pairs).T
        offsets = np.append(0, np.cumsum([len(x) for x in lists]))
        want = [np.intersect1d(lists[i], lists[j])[0] == this[i] for i, j in pairs]
        for words in (0, 1, 2, 16):
            assert smallest_common(offsets, np.concatenate(lists), np.array(group), np.array(this), a, b, words).tolist() == want


def test_smallest_common_filter_of_a_crowd():
    """Work on a pair does not follow the longest list: 125,000 pairs of 500 rows, one of which holds 100,000 filters."""
    lists = [np.append(np.arange(i % 7, 60, 7), 200_000) for i in range(499)] + [np.append(np.arange(100_000) + 1000, 200_000)]
    offsets = np.append(0, np.cumsum([len(x) for x in lists]))
    a, b = np.triu_indices(500, 1)
    tracemalloc.start()
    got = smallest_common(offsets, np.concatenate(lists), np.zeros(500, int), np.full(500, 200_000), a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == ((a % 7 != b % 7) | (b == 499)).tolist()
    assert peak < 100e6


def test_links_of_short_vectors(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=2)], int(rng.integers(0, 2))) for i in range(10_000)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    for k in (0, 1):
        at = np.flatnonzero(label == k)
        links = (x[at] @ x[at].T >= 0.93).sum(1) - 1
        assert [got[i][0] for i in at.tolist()] == links.tolist()
        assert {got[i][1] for i in at.tolist()} == {int(at[0])}  # so many leave no gap on the circle
    for d in (5, 7, 9):
        some = [(i, [float(np.float32(y)) for y in rng.normal(size=d)], 1) for i in range(400)]
        assert sum(r.n_links for r in link(spark.createDataFrame(some, SCHEMA)).collect()) >= 0.98 * sum(r[1] for r in brute_links(some))


@pytest.mark.parametrize(("cosine", "words"), [(0.93, 16), (0.93, 32), (0.93, 64), (0.93, 256), (0.96, 32)])
def test_recall_of_the_filters(cosine, words):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3000 if words < 256 else 300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    w = rng.normal(size=a.shape)
    w -= (w * a).sum(1, keepdims=True) * a
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    codes = ProductCodes(64, words, 16, 3, 23)
    x, y = codes.decode(a), codes.decode(cosine * a + np.sqrt(1 - cosine**2) * w)
    share = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)])
    assert share >= 0.995
    # all directions above the threshold, by trying them all
    if words == 16:
        for c in range(3):
            first, second = codes.halves(a, c)
            for row in range(20):
                sums = (first[row][:, None] + second[row]).reshape(-1)
                level = min(codes.threshold, np.sort(sums)[-codes.least])
                own = x[row][(x[row] > c * words**4) & (x[row] <= (c + 1) * words**4)]
                assert own.tolist() == (1 + c * words**4 + np.flatnonzero(sums >= level)).tolist() and len(own) >= 16


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4000 + i) for i in range(50)]
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    at = {x: i for i, x in enumerate(nodes)}
    real = [p for p in pairs if p[0] != p[1]]
    root = local_roots(len(nodes), np.array([at[a] for a, _ in real]), np.array([at[b] for _, b in real]))
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(nodes)
    assert {r.node: r.root for r in got} == {x: nodes[root[at[x]]] for x in nodes}
