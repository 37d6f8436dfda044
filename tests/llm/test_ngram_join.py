import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm.ngram_join import Bitmaps, PrefixTree, WordHashes, across, gram_set, join, keep_one, key_filter, leaders, least_runs, needed, parities, runs


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    shared = defaultdict(int)
    for ids in by.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                shared[a, b] += 1
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            root[find(a)] = find(b)
    low = {}
    for i in range(len(rows)):
        ids = [x for x in (low.get(find(i)), rows[i][0]) if x is not None]
        low[find(i)] = min(ids) if ids else None
    return sorted(((rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows))), key=str)


def got(df, **params):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join(df, **params).collect()), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    rows = []
    for c in range(25):
        base = rng.choices(words, k=rng.randint(4, 160)) + passage * (c % 3 == 0)
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 60))):
                t[rng.randrange(len(t))] = rng.choice(words).upper()
            if rng.random() < 0.3:
                t = t[: -rng.randint(1, 4)]
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (3, 60)])
def test_against_brute_force(spark, n, percent):
    for seed, pools in ((1, [None]), (2, [0.02, 1.0] if percent == 90 else [])):
        rows = near_copies(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for pool in pools:
            assert got(df, n=n, percent=percent, tree=4, pool=pool) == brute(rows, n, percent)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


def test_odd(spark, odd, clashing, empty):
    want = brute([(r.doc_id, r.text) for r in odd.collect()], 3, 90)
    assert got(odd) == want
    assert got(clashing) == want
    assert join(empty).collect() == []


def test_tree_finds_what_brute_force_finds():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        base = rng.integers(0, 60, 40).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(40) < 0.1, rng.integers(0, 200, 40).astype(np.uint64), base)[: rng.integers(5, 41)]) for _ in range(60)]
        tree = PrefixTree(sets)
        for p in sets[:20]:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(p, s)) >= percent * len(np.union1d(p, s))]
            assert sorted(tree.linked(p, percent)) == want


def test_bounds():
    assert all(100 * needed(a, b, 90) >= 90 * (a + b - needed(a, b, 90)) > 100 * (needed(a, b, 90) - 1) - 90 for a in range(1, 60) for b in range(a, 60))
    assert leaders(np.array([10, 10, 11, 12, 13, 30]), 90, np.array([0])).tolist() == [0, 0, 0, 3, 3, 5]
    assert leaders(np.array([10, 10, 11, 12, 13, 30]), 90, np.array([0, 3, 5])).tolist() == [0, 0, 0, 3, 3, 5]
    assert leaders(np.array([10, 12, 13, 20, 21]), 90, np.array([0, 3])).tolist() == [0, 1, 1, 3, 3]
    run = {"n": np.array([10, 10, 11]), "comp": np.array([1, 1, 2]), "cid": np.array([1, 4, 2]), "place": np.ones(3, np.int64), "bits": np.array([parities(np.arange(k).astype(np.uint64)) for k in (10, 10, 11)], object)}
    assert [(x["a"].tolist(), x["b"].tolist()) for x in across(run, np.array([0]), 90)] == [([1, 4], [2, 2])]
    # 10 and 11 grams share 10 at least: they meet first at their first, or the longer one's second
    assert [(x["a"].tolist(), x["b"].tolist()) for x in across({**run, "place": np.array([1, 2, 2])}, np.array([0]), 90)] == [([1], [2])]


def test_bitmaps_differ_no_more_than_sets():
    rng = np.random.default_rng(9)
    sets = []
    for size in (1, 60, 200, 250, 300, 500, 520, 3000, 4090, 4100, 9000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        sets += [a, *[np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 2**63, rng.integers(1, 50)).astype(np.uint64)])) for share in (0.5, 0.8, 0.97)]]
    sets.sort(key=len)
    bitmaps = Bitmaps(np.array([parities(x) for x in sets] + [None], object)[:-1])
    a, b = np.triu_indices(len(sets), 1)
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (bitmaps.far(a, b, np.full(len(a), 1 << 30)) <= true).all()
    # sets of one size that share half of their grams are told from near ones
    for size in (300, 1000, 4000):
        x = rng.integers(0, 2**63, size).astype(np.uint64)
        y = np.where(rng.random(size) < 0.75, x, rng.integers(0, 2**63, size).astype(np.uint64))
        far = Bitmaps(np.array([parities(x), parities(y), None], object)[:-1]).far(np.array([0]), np.array([1]), np.array([1 << 30]))[0]
        assert far > 2 * size - 2 * needed(size, size, 80)


def brute_pairs(run, starts, percent):
    n, place = run["n"], run["place"]
    out = set()
    for i in range(len(n)):
        for j in range(i + 1, min([len(n), *[x for x in starts if x > i]])):
            least = needed(int(n[i]), int(n[j]), percent)
            if run["comp"][i] != run["comp"][j] and min(n[i], n[j]) >= least and place[i] <= n[i] - least + 1 and place[j] <= n[j] - least + 1:
                out.add((run["cid"][i], run["cid"][j]))
    return out


def test_pairs_of_a_run():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for most in (3, 60):
            for _ in range(30):
                sizes = rng.integers(2, most, 6)
                starts, m = np.cumsum(sizes) - sizes, int(sizes.sum())
                n = np.concatenate([np.sort(rng.integers(5, 30, k)) for k in sizes])
                comp = np.where(rng.random(m) < 0.5, 0, rng.integers(0, 4, m))
                run = {"n": n, "comp": comp, "cid": np.arange(m), "place": rng.integers(1, 5, m), "bits": np.array([parities(np.zeros(0, np.uint64))] * m + [None], object)[:-1]}
                pairs = [p for x in across(run, starts, percent, most=7) for p in zip(x["a"].tolist(), x["b"].tolist(), strict=True)]
                assert len(pairs) == len(set(pairs)) and set(pairs) == brute_pairs(run, starts, percent)


def test_whole_runs_of_batches():
    rng = np.random.default_rng(7)
    gram = np.sort(rng.integers(0, 400, 2000))
    gram[500:1300] = gram[500]
    batches = pa.table({"gram": gram, "x": np.arange(2000)}).to_batches(max_chunksize=90)
    got = [(int(g), int(x), k) for k, (run, starts) in enumerate(runs(iter(batches), rows=200)) for g, x in zip(run["gram"], run["x"], strict=True)]
    often = {g for g, n in zip(*np.unique(gram, return_counts=True), strict=True) if n > 1}
    assert [x for _, x, _ in got] == [i for i, g in enumerate(gram) if g in often]
    assert len({(g, k) for g, _, k in got}) == len(often)


def test_linked_sets_share_their_first_gram_early():
    rng = np.random.default_rng(12)
    for percent in (60, 80, 90):
        checked = 0
        for _ in range(4000):
            universe = rng.permutation(400)
            a = universe[: rng.integers(1, 120)]
            b = np.concatenate([a[rng.random(len(a)) < 0.97], universe[300 : 300 + rng.integers(0, 8)]])
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                order = rng.permutation(400)
                x, y = (sorted(z.tolist(), key=lambda g: order[g]) for z in (a, b))
                first = next(g for g in x if g in set(y))
                least = needed(len(x), len(y), percent)
                assert x.index(first) + 1 <= len(x) - least + 1 and y.index(first) + 1 <= len(y) - least + 1
                checked += 1
        assert checked > 500


def test_filter_of_keys_loses_none(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    maybe = key_filter(keys)
    assert keys.where(maybe("key")).count() == 5000
    assert spark.range(5000, 15000).selectExpr("xxhash64(id) AS key").where(maybe("key")).count() < 3000


def test_linked_sets_meet_as_often_as_is_asked():
    rng = np.random.default_rng(8)
    for percent in (60, 80, 90):
        checked = 0
        for _ in range(4000):
            universe = rng.permutation(400)
            a = universe[: rng.integers(1, 120)]
            b = np.concatenate([a[rng.random(len(a)) < 0.97], universe[300 : 300 + rng.integers(0, 8)]])
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                order = rng.permutation(400)
                pre = [sorted(x.tolist(), key=lambda g: order[g])[: len(x) - -(-percent * len(x) // 100) + 1] for x in (a, b)]
                least = int(least_runs(np.array([len(a)]), np.array([len(b)]), percent)[0])
                assert 1 <= least <= len(set(pre[0]) & set(pre[1]))
                checked += 1
        assert checked > 500


def test_grams():
    h = WordHashes()
    assert len(gram_set(b"a b c A B C a b c", 3, h)) == 3
    assert len(gram_set(b"a b", 3, h)) == len(gram_set(b"a", 3, h)) == 1
    assert gram_set(b" \t", 3, h).size == gram_set(None, 3, h).size == 0
    assert gram_set("É b c".encode(), 3, h)[0] != gram_set("é b c".encode(), 3, h)[0]
    assert gram_set(b"a b c d e f", 5, h).size == 2
