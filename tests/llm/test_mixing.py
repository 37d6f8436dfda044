import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.llm.mixing import fit, knapsack, mix, with_copies


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what exceeds a cap is shared again among the others, until none does."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out = set(order), sum(sizes.values()), {}
    while left:
        level = total / sum(w[s] for s in left)
        over = {s for s in left if w[s] * level > most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in left}
        for s in over:
            out[s] = most * sizes[s]
            total -= most * sizes[s]
        left -= over
    return out


def held(rows, docs):
    words = [(d.doc_id, d.source, len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))) for d in docs]
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, n) for d, _, n in words)
    sizes = Counter()
    for _, s, n in words:
        sizes[s] += n
    want = targets(sizes)
    taken = Counter()
    source = {}
    for d, s, _ in words:
        source.setdefault(d, set()).add(s)
    for r in rows:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        s = next(s for s in source[r.doc_id] if sizes[s] == r.source_size and want[s] == pytest.approx(r.target))
        taken[s] += r.taken
    return taken, want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = with_copies(docs).collect()
    taken, want = held(rows, docs.collect())
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 + 0.02 * t, (s, taken[s], t)
    assert sorted(with_copies(docs.repartition(5)).collect()) == sorted(rows)


def test_mix_repeats_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = Counter({r.doc_id: r.copies for r in with_copies(docs).collect()})
    out = mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies


def test_knapsack_is_exact():
    rng = random.Random(3)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), 5)
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, 120)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        took = knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(took, counts, strict=True))
        assert sum(t * n for t, n in zip(took, lengths, strict=True)) - budget in (d := min((s - budget for s in sums), key=abs), -d)


def test_fit_of_large_counts():
    lengths = np.arange(1, 3001) * 7 + 3
    counts = np.arange(3000, 0, -1) * 1000
    total = int((lengths * counts).sum())
    for budget in (total // 3, total // 2 + 1, 17):
        x = fit(lengths, counts, budget)
        assert (x >= 0).all() and (x <= counts).all()
        assert abs(int((x * lengths).sum()) - budget) <= 3


def test_odd(odd, clashing, empty):
    rows = with_copies(odd).collect()
    held(rows, odd.collect())
    assert sorted(map(str, with_copies(clashing).collect())) == sorted(map(str, rows))
    assert with_copies(empty).collect() == []
    assert mix(empty).collect() == []
    assert mix(clashing).columns == clashing.columns
