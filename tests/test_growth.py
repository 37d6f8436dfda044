"""Steps whose time or memory grew faster than their input."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from jobs import build_prompts
from spanloom.functions import spans as fs
from spanloom.operators import lexicon as lx
from spanloom.operators import resampling as rs
from spanloom.operators import vectors as vc
from spanloom.operators.trie import TokenTrie, in_slices


def labels_of(spans, n):
    flat = []
    for x in sorted(spans):
        if not any(x[0] < y[1] and y[0] < x[1] for y in flat):
            flat.append(x)
    own = [next((x for x in flat if x[0] <= i < x[1]), None) for i in range(n)]
    return ["O" if x is None else ("B-" if x[0] == i else "I-") + x[2] for i, x in enumerate(own)]


def test_labels_of_odd_spans(spark):
    rng = np.random.default_rng(3)
    rows = [([(int(s), int(s + k), "ab"[k % 2]) for s, k in zip(rng.integers(-3, 20, m), rng.integers(0, 6, m), strict=True)], int(n)) for m, n in zip(rng.integers(0, 7, 150), rng.integers(0, 22, 150), strict=True)]
    df = spark.createDataFrame(rows, f"spans {fs.SPANS}, n int")
    got = df.select("spans", "n", fs.spans_to_bio(F.col("spans"), F.col("n")).alias("l")).collect()
    assert [(r.l, r.n) for r in got] == [(labels_of(s, n), n) for s, n in rows]


def test_labels_of_many_spans(spark):
    """The choice among spans was made anew for each token, which is cubic: this row took hours."""
    n = 12_000
    one = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 3), F.lit(3)), lambda i: fs.span(i, i + 2, F.lit("a"))).alias("spans"))
    start = time.time()
    got = one.select(fs.spans_to_bio(F.col("spans"), F.lit(n)).alias("l")).first().l
    assert got == ["B-a", "I-a", "O"] * (n // 3)
    assert time.time() - start < 60


def test_largest_with_ties():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 5, (40, 30)).astype(float)
    s[3], s[5, :4] = -np.inf, np.nan
    for k in (1, 4, 30, 50):
        row, at, value = vc.largest(s, k)
        key = np.where(np.isnan(s), -np.inf, s)
        top = np.argsort(-key, axis=1, kind="stable")[:, :k]
        assert np.array_equal(at.reshape(40, -1), top) and np.array_equal(row, np.repeat(np.arange(40), top.shape[1]))
        assert np.array_equal(value, s[row, at], equal_nan=True)


def test_neighbours_hold_some_products_at_a_time():
    """All products of two blocks of 8,192 vectors and their order take 1.5 GB; 128 rows of them take 8 MB for each array."""
    assert vc.nearest.__defaults__[-1] <= 128
    s = np.random.default_rng(2).random((128, 8192))
    tracemalloc.start()
    vc.largest(s, 6)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    x = vc.matrix(pa.chunked_array([pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32())), pa.array([[5.0, 6.0]], pa.list_(pa.float32()))]))
    assert x.tolist() == [[1, 2], [3, 4], [5, 6]]


def test_hits_of_a_batch_are_found_some_texts_at_a_time():
    """All texts of a batch were walked at once: 2 million tokens took over 200 MB beside their hits."""
    rng = np.random.default_rng(7)
    trie = TokenTrie(np.array([1, 2, 2, 3], np.int64), np.array([1, 2, 1]))
    sizes = rng.integers(0, 900, 4500)
    hashes = rng.integers(0, 400, sizes.sum())
    want = trie.hits(hashes, sizes)
    tracemalloc.start()
    got = in_slices(trie, hashes, sizes)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_occurrences_in_long_and_repeated_texts(spark):
    """A text's tokens were copied for each of its hits: 40,000 tokens with 20,000 hits are 800 million."""
    long = ["a", "b", "c d", "x"] * 10_000
    texts = [("u", ["a", "b", "a"]), ("u", ["a", "b", "a"]), ("v", ["b"]), ("w", long), ("z", [])]
    spans = [("u", 0, 1, "t", "a", 1), ("u", 0, 1, "k", "a", 2), ("u", 0, 2, "t", "a b", 3), ("v", 0, 1, "t", "b", 4), ("gone", 0, 1, "t", "q", 5)]
    start = time.time()
    index = lx.surface_index(spark.createDataFrame(spans, "sid string, s int, e int, type string, surface string, pos long"), spark.createDataFrame(texts, "sid string, tokens array<string>"))
    assert {r.key: (r.total, r.o) for r in index.collect()} == {"a": (2, 2 + 10_000), "a b": (1, 10_000), "b": (1, 2 + 10_000), "q": (1, 0)}
    assert time.time() - start < 60
    plan = lx.dictionary_join(spark.createDataFrame(texts, "sid string, tokens array<string>"), index.select("key"))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate" in line and "explode" in line and " t#" in line for line in plan.splitlines())


def test_texts_join_the_prompts_once(spark, tmp_path):
    """Whole texts were grouped by themselves, several times, and moved again with their demonstrations in front."""
    rows = [(1, "a  b", "en"), (2, "a b", "en"), (3, "c", None), (3, "c", None), (3, "d", "de"), (4, "e f", "en"), (5, " e  f ", "en"), (6, " ", "en"), (None, "g", "en")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, passages = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([("zz",)], "text string")
    made = build_prompts.prompts(documents, labels, passages, build_prompts.Settings())
    got = [(r.doc_id, r.lang, r.copies, r.position, r.shown) for r in made.orderBy("batch", "position").collect()]
    assert got == [(3, "de", 1, 0, 0), (1, "en", 2, 1, 1), (3, "none", 2, 2, 0)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "coalesce(text" not in plan


def test_grid_counts_take_some_rows_at_a_time(spark, monkeypatch):
    """A whole batch of 10,000 rows was multiplied with 512 vectors at once: 40 MB for each of several arrays."""
    sizes = spark.sparkContext.accumulator(0)
    floor = np.floor

    def watched(x):
        if x.size > 4096 * 512:
            sizes.add(1)
        return floor(x)

    df = spark.range(0, 9000, 1, 1).select((F.col("id") % 8999 / 9000).alias("a"), (F.col("id") % 7 / 7).alias("b"), (F.col("id") % 2).cast("int").alias("y"))
    weights = np.column_stack([np.linspace(0, 1, 600), 1 - np.linspace(0, 1, 600)])
    watch = type("np", (), {"__getattr__": lambda self, name: watched if name == "floor" else getattr(np, name)})()
    monkeypatch.setattr(rs, "np", watch)
    counts = rs.grid_counts(df, ["a", "b"], "y", weights)
    assert counts.agg(F.sum("n")).first()[0] == 9000 * 600
    assert sizes.value == 0
