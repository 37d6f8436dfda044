"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

A document becomes ``len(STATISTICS)`` numbers about its whole text. Cosines of random projections of them approximate a
Gaussian kernel. Each task sums its part of the normal equations, by fold; the sums have a fixed size and meet block by block.
Every fold is scored by the weights of the other folds, and isotonic regression of the labels on those scores (in fixed
bins) turns scores into probabilities, read off by linear interpolation.

Fitting uses at most ``max_train`` labelled documents, those with the smallest seeded hash of their id: their ids are the
only rows that are broadcast. Scoring is one pass over all documents without any shuffle.

Defined results: a null text is scored as the empty text; every text gets a score between 0 and 1; a null id matches no label
and is not held out; of repeated labels for one id the largest counts; repeated documents are fitted and scored as often as
they occur; with no labels the score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_blocks, blocks_of, collect_blocks, held_out, materialise, small_batches

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "distinct_words", "top_word", "distinct_lines", "line_length",
    "upper", "lower", "digits", "high_bytes", "signs", "spaces", "words_end_in_sign", "words_start_in_sign", "words_start_upper", "words_of_signs", "repeated_bytes", "packed_size", "sentence_ends", "bars", "distinct_bytes",
)

_KIND = np.zeros(256, np.uint8)  # 0 space or control, 1 upper, 2 lower, 3 digit, 4 other sign, 5 part of a character beyond ASCII
_KIND[33:127] = 4
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS for a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATISTICS)
    b = np.frombuffer(raw, np.uint8)
    kind = _KIND[b]
    n = len(b)
    share = np.bincount(kind, minlength=6) / n
    words, lines = raw.split(), raw.split(b"\n")
    inside = (b != 32) & ((b < 9) | (b > 13))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    m = len(starts)
    if not m:
        return [np.log1p(n), 0.0, np.log1p(len(lines))] + [0.0] * 11 + [1.0] + [0.0] * (len(STATISTICS) - 15)
    length = ends - starts
    first, last = kind[starts], kind[ends - 1]
    signs = np.concatenate([[0], np.cumsum(kind == 4)])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), length.mean(), length.std(), len(counts) / m, max(counts.values()) / m, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        share[1], share[2], share[3], share[5], share[4], share[0], (last == 4).mean(), (first == 4).mean(), (first == 1).mean(), (signs[ends] - signs[starts] == length).mean(), (b[1:] == b[:-1]).mean() if n > 1 else 0.0,
        len(zlib.compress(raw, 1)) / n, (b[ends - 1] == 46).mean(), raw.count(b"|") / m, np.log1p(np.count_nonzero(np.bincount(b, minlength=256))),
    ]


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y (weights w) on ascending x: the blocks' mean x and their levels."""
    blocks: list[list[float]] = []  # sum of w*x, sum of w*y, sum of w
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    a = np.array(blocks).reshape(-1, 3)
    return a[:, 0] / a[:, 2], a[:, 1] / a[:, 2]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.expand(x) @ self.weights, self.knots, self.levels), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, max_train: int = 40_000, features: int = 384, ridge: float = 1e-3, bandwidth: float = 4.0, bins: int = 2000, seed: int = 11) -> QualityModel:
    """Learn from the labelled rows that are not held out."""
    d = len(STATISTICS)
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, held))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max((F.col("quality") > 0).cast("double")).alias("__y"))
        .withColumn("__h", F.xxhash64("__id", F.lit(seed)))
        .orderBy("__h", "__id")
        .limit(max_train)
    )
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(known), "__id").select("text", "__y", F.pmod(F.col("__h"), F.lit(folds)).cast("int").alias("__fold"))
    schema = f"fold int, y double, {', '.join(f'x{i} double' for i in range(d))}"

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column(0)])
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), *[pa.array(c) for c in x.T]], names=["fold", "y", *[f"x{i}" for i in range(d)]])

    sample = materialise(rows.mapInArrow(measure, schema))
    moments = sample.agg(*[f(f"x{i}") for i in range(d) for f in (F.mean, F.stddev_pop)]).first()
    rng = np.random.default_rng(seed)
    m = np.array([v or 0.0 for v in moments]).reshape(d, 2)
    model = QualityModel(m[:, 0], np.where(m[:, 1] > 1e-9, m[:, 1], 1.0), rng.normal(size=(d, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(0), np.zeros(0))
    k = features + 1
    per_fold = k * (k + 1)
    block = 4 * (k + 1)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, k, k + 1))
        for batch in it:
            a = batch.to_pandas().to_numpy(np.float64)
            z = model.expand(a[:, 2:])
            for f in range(folds):
                own = a[:, 0] == f
                if own.any():
                    total[f] += z[own].T @ np.hstack([z[own], a[own, 1:2]])
        yield from blocks_of(total.reshape(-1), block)

    parts = sample.repartition(16).mapInArrow(sums, "block int, data binary")
    total = collect_blocks(add_blocks(parts), folds * per_fold, block).reshape(folds, k, k + 1)

    def solve(t: np.ndarray) -> np.ndarray:
        n = max(t[0, 0], 1.0)
        return np.linalg.solve(t[:, :k] + ridge * n * np.eye(k) / k, t[:, k])

    without = [solve(total.sum(0) - total[f]) for f in range(folds)]

    def rate(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            a = pdf.to_numpy(np.float64)
            z = model.expand(a[:, 2:])
            s = np.einsum("ij,ij->i", z, np.array(without)[a[:, 0].astype(int)])
            yield pd.DataFrame({"bin": np.clip(np.floor((s + 0.5) * bins / 2), 0, bins - 1).astype(np.int32), "y": a[:, 1]})

    binned = sample.mapInPandas(rate, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # at most ``bins`` rows
    model.weights = solve(total.sum(0))
    if binned:
        model.knots, model.levels = pool_adjacent(np.array([(r["bin"] + 0.5) * 2 / bins - 0.5 for r in binned]), np.array([r["y"] for r in binned]), np.array([float(r["n"]) for r in binned]))
    return model


def quality_score(text: Column, model: QualityModel) -> Column:
    """The probability of label 1 for a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return score(text)


def score_documents(docs: DataFrame, model: QualityModel, *, folds: int = 4, held: int = 2, accept: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, held).alias("held_out"), quality_score(F.col("text"), model).alias("score")).withColumn("predicted", (F.col("score") >= accept).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, accept: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    model = fit_quality(docs, labels)
    return docs.where(quality_score(F.col("text"), model) >= accept)
