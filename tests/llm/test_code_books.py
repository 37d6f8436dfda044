import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.code_books import compress, decode, encode, fit_codebooks

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4, parts=4):
    """The same with Python's integers, one vector and entry at a time."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))
    whole = []
    for i, v, label in kept:
        q = [int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (parts * width - len(v))
        whole.append((i, [tuple(q[p * width : (p + 1) * width]) for p in range(parts)], label))
    order = sorted(kept_index(kept))
    books = [[whole[k][1][p] for *_, k in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, x, _ in whole:
                met.setdefault(near(x[p], books[p])[1], []).append(x[p])
            books[p] = [tuple(sum(c) // len(met[e]) for c in zip(*met[e], strict=True)) if e in met else book for e, book in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    coded = [(i, [near(x[p], books[p]) for p in range(parts)], label) for i, x, label in whole]
    total = {}
    for _, best, label in coded:
        total[label] = total.get(label, 0) + sum(d for d, _ in best)
    return sorted(((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), total[label], digest) for i, best, label in coded), key=str)


def kept_index(kept):
    return [(i is None, i or 0, [float(np.float32(x)) for x in v], k) for k, (i, v, _) in enumerate(kept)]


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8) * 0.1], int(rng.integers(0, 3)) if i % 7 else None) for i in rng.permutation(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, compress(df, entries=16).collect()), key=str) == brute(rows, entries=16)
    assert sorted(map(tuple, compress(df).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (5, [0.5, -0.25, 0.1, 1.0, 0.0], 1),
        (5, [0.5, -0.25, 0.1, 1.0, 0.0], 1),
        (5, [0.5, -0.75, 0.1, 1.0, 0.0], 1),
        (None, [0.5, 0.5], 1),
        (1, [], None),
        (2, None, 1),
        (3, [None, 1.0], 1),
        (4, [float("nan"), 1.0], 1),
        (6, [float("-inf"), 1.0], 1),
        (-7, [-0.0001] * 9, None),
        (8, [3.0], 2),
    ]
    want = brute(rows, entries=3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, compress(df, entries=3).collect()), key=str) == want
    clashing = df.select("*", *[F.lit("x").alias(c) for c in "v code error label_error part entry n total key length most".split()])
    assert sorted(map(tuple, compress(clashing, entries=3).collect()), key=str) == want
    assert compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    assert len(compress(spark.createDataFrame([(1, [], 1)], SCHEMA)).collect()) == 1
    with pytest.raises(ValueError, match="64-bit"):
        compress(spark.createDataFrame([(1, [1e9], 1)], SCHEMA))


def test_hot_and_rare_labels(spark):
    rows = [(i, [i % 13 / 16, i % 7 / 8, i % 5 / 4, i % 3 / 2], i % 150 if i % 2 else 0) for i in range(400)]
    assert sorted(map(tuple, compress(spark.createDataFrame(rows, SCHEMA), entries=8).collect()), key=str) == brute(rows, entries=8)


def test_decoded_vectors_are_as_far_as_the_error_says(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    fitted = fit_codebooks(vectors)
    back = decode(encode(vectors, fitted), fitted).join(vectors.select("vec_id", "embedding"), "vec_id").collect()
    assert len(back) == vectors.count()
    for r in back:
        q = np.floor(1024 * np.array(r.embedding, np.float32).astype(float))
        assert round(((q - 1024 * np.array(r.approximation)) ** 2).sum()) == r.error
    small = fit_codebooks(vectors, entries=2)
    assert encode(vectors, small).agg(F.sum("error")).first()[0] > encode(vectors, fitted).agg(F.sum("error")).first()[0]
