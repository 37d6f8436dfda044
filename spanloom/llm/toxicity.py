"""Toxicity by cumulative-link ordinal regression over sparse text features.

Terms are words of letters and their beginnings of 4 to 8 letters. P(grade > k) = sigmoid(w.x - t_k): one weight vector for
all thresholds t_0 < t_1 < t_2, which are kept in order by their parametrisation. The result is the expected grade.

Grade 0 are documents labelled clean. Labels say no more than toxic or not, so toxic ones are graded 1 to 3 by the share of
their words that hold a marker term (terms far commoner in toxic documents): below 1 %, below 3 %, more.

Terms are chosen in two steps, neither of which collects strings of the corpus: document counts by hashed term (a fixed-size
array for each task, summed block by block) name the most telling hashes, then exact counts are made for the terms under
those hashes alone, and the ``vocabulary`` most telling remain. Fitting uses at most ``max_train`` labelled documents (those
with the smallest seeded hash of their id) reduced to chosen terms, in one task of bounded size. Scoring is one pass over
all whole texts without any shuffle.

Defined results: null and empty texts have no terms and get the intercept's grade; a null id matches no label; of repeated
labels for one id the largest counts; with no toxic label (or none at all) every document is graded 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_blocks, blocks_of, collect_blocks, held_out, materialise, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
GRADES = 4


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings (marked by a hyphen) of 4 to 8 letters that are shorter than it."""
    return [word, *[word[:k] + "-" for k in range(4, min(8, len(word) - 1) + 1)]]


def word_counts(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """G-squared of presence against toxicity where presence is commoner in toxic documents, else 0."""

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    n = n_toxic + n_clean
    seen = toxic + clean
    g = part(toxic, seen * n_toxic / n) + part(clean, seen * n_clean / n) + part(n_toxic - toxic, (n - seen) * n_toxic / n) + part(n_clean - clean, (n - seen) * n_clean / n)
    return np.where(toxic * n_clean > clean * n_toxic, 2 * g, 0.0)


@dataclass
class ToxicityModel:
    ids: dict[str, int] = field(default_factory=dict)
    present: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([50.0, 51.0, 52.0]))

    def exceed(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > 0), P(grade > 1), P(grade > 2) of each text."""
        s = np.zeros(len(texts))
        memo: dict[str, list[int]] = {}
        for i, text in enumerate(texts):
            found, total = features(text, self.ids, memo)
            if found:
                at, x = design(found, total)
                s[i] = self.present[at].sum() + x @ self.dense[at]
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds, -60, 60)))


def features(text: str | None, ids: dict[str, int], memo: dict[str, list[int]]) -> tuple[Counter, int]:
    """How often each chosen term occurs, and the number of words."""
    words = word_counts(text)
    found: Counter = Counter()
    for w, n in words.items():
        known = memo.get(w)
        if known is None:
            known = memo[w] = [ids[t] for t in terms_of(w) if t in ids]
        for k in known:
            found[k] += n
    return found, sum(words.values())


def design(found: Counter, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Term indices, and their log density per 100 words."""
    at = np.fromiter(found.keys(), np.int64, len(found))
    n = np.fromiter(found.values(), np.float64, len(found))
    return at, np.log1p(n * 100 / max(total, 30))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, *, l2: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of presence and of density, and thresholds, by Adam on the likelihood of grades."""
    at = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    x = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    n = max(len(rows), 1)
    p = np.zeros(2 * size + GRADES - 1)  # presence, density, first threshold, logs of the steps between thresholds
    p[2 * size] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, u = p[:size], p[size : 2 * size]
        gaps = np.exp(p[2 * size + 1 :])
        t = p[2 * size] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(row, w[at] + x * u[at], minlength=len(rows))
        q = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -60, 60)))
        # cell probabilities and their slopes along s and t
        edge = np.hstack([np.ones((len(rows), 1)), q, np.zeros((len(rows), 1))])
        slope = edge * (1 - edge)
        i = np.arange(len(rows))
        cell = np.maximum(edge[i, y] - edge[i, y + 1], 1e-9)
        ds = -(slope[i, y] - slope[i, y + 1]) / cell / n
        dt = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            dt[k] = (((y == k + 1) * slope[:, k + 1] - (y == k) * slope[:, k + 1]) / cell).sum() / n
        g = np.concatenate([np.bincount(at, ds[row], minlength=size) + l2 * w, np.bincount(at, ds[row] * x, minlength=size) + l2 * u, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:size], p[size : 2 * size], p[2 * size] + np.concatenate([[0.0], np.cumsum(np.exp(p[2 * size + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, max_train: int = 20_000, vocabulary: int = 2048, hashes: int = 1 << 18, kept_hashes: int = 8192, seed: int = 13) -> ToxicityModel:
    """Learn from the labelled rows that are not held out."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, held))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("__y"))
        .orderBy(F.xxhash64("__id", F.lit(seed)), "__id")
        .limit(max_train)
    )
    sample = materialise(small_batches(docs).select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(known), "__id").select("text", "__y"))
    sizes = {r["__y"]: r["n"] for r in sample.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n_toxic or not n_clean:
        return ToxicityModel()

    def terms(text: str | None) -> set[str]:
        return {t for w in word_counts(text) for t in terms_of(w)}

    def by_hash(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, hashes))
        memo: dict[str, int] = {}
        for batch in it:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = terms(text.as_py())
                at = set()
                for t in found:
                    h = memo.get(t)
                    if h is None:
                        h = memo[t] = xxhash.xxh64_intdigest(t, seed) % hashes
                    at.add(h)
                if len(memo) > 500_000:
                    memo.clear()
                total[y, list(at)] += 1
        yield from blocks_of(total.reshape(-1), 2048)

    counts = collect_blocks(add_blocks(sample.mapInArrow(by_hash, "block int, data binary")), 2 * hashes, 2048).reshape(2, hashes)
    g = telling(counts[1], counts[0], n_toxic, n_clean)
    best = np.sort(np.argsort(-g, kind="stable")[:kept_hashes])
    chosen = np.zeros(hashes, bool)
    chosen[best[g[best] > 0]] = True

    def exact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in it:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for t in terms(text.as_py()):
                    if chosen[xxhash.xxh64_intdigest(t, seed) % hashes]:
                        total.setdefault(t, [0, 0])[y] += 1
        if total:
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.string()), "clean": pa.array([v[0] for v in total.values()], pa.int64()), "toxic": pa.array([v[1] for v in total.values()], pa.int64())})

    per_term = sample.mapInArrow(exact, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    @F.pandas_udf("double")
    def weigh(toxic: pd.Series, clean: pd.Series) -> pd.Series:
        return pd.Series(telling(toxic.to_numpy(float), clean.to_numpy(float), n_toxic, n_clean))

    top = per_term.where("toxic >= 2").withColumn("g", weigh("toxic", "clean")).where("g > 6").orderBy(F.desc("g"), "term").limit(vocabulary).collect()  # at most ``vocabulary`` rows
    ids = {r["term"]: i for i, r in enumerate(top)}
    markers = np.array([(r["toxic"] + 0.5) * n_clean / ((r["clean"] + 0.5) * n_toxic) >= 6 and r["toxic"] >= 5 for r in top], bool)

    def train(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, memo = [], {}
        for batch in it:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found, total = features(text.as_py(), ids, memo)
                at, x = design(found, total)
                marked = sum(n for k, n in found.items() if markers[k]) / max(total, 1)
                rows.append((at, x, 0 if not y else 1 if marked < 0.01 else 2 if marked < 0.03 else 3))
        present, dense, t = fit_ordinal(rows, len(ids))
        yield pa.RecordBatch.from_pydict({"name": pa.array(["present", "dense", "thresholds"]), "data": pa.array([present.tobytes(), dense.tobytes(), t.tobytes()], pa.binary())})

    # one task of at most ``max_train`` texts
    got = {r["name"]: np.frombuffer(r["data"]) for r in sample.repartition(1).mapInArrow(train, "name string, data binary").collect()}
    return ToxicityModel(ids, got["present"], got["dense"], got["thresholds"])


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """struct(p_toxic, expected_severity, grade) of a text column."""

    @F.pandas_udf("p_toxic double, expected_severity double, grade int")
    def rate(texts: pd.Series) -> pd.DataFrame:
        q = model.exceed(list(texts))
        return pd.DataFrame({"p_toxic": q[:, 0], "expected_severity": q.sum(1), "grade": (q >= 0.5).sum(1).astype(np.int32)})

    return rate(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, p_toxic, expected_severity (0 to 3), grade, predicted (1: toxic) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, held).alias("held_out"), toxicity(F.col("text"), model).alias("t")).select("doc_id", "held_out", "t.*", (F.col("t.grade") > 0).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of grade 0, with their own columns."""
    model = fit_toxicity(docs, labels)
    return docs.where(toxicity(F.col("text"), model)["grade"] == 0)
