"""Quality rules: multivariate outliers among document statistics, by the minimum covariance determinant for each language and source.

Each document becomes a vector of six transformed statistics, in whole thousandths (so that sums are exact and equal documents are one vector
with a count): the log of its mean word length, and the arcsine roots of five shares, of symbols among characters, capitals among letters,
signs among characters, repeated lines among lines and words of repeated 8-word windows among words. Documents that pass the base rules give,
for each (language, source), each language and everything, an estimate of centre and scatter:

1. medians and median deviations from counts by value; three starting scatters from all vectors (correlation of tanh scores, spatial signs,
   and the deviations alone), as in the deterministic MCD of Hubert, Rousseeuw and Verdonck (2012);
2. concentration steps over all vectors: squared Mahalanobis distances, counts and moments by (group, start, distance bin), and from the
   bins that hold the nearest ``share`` of a group its next centre and scatter; after two steps a group's best start goes on alone, until no
   determinant falls by a ten-thousandth any more;
3. the start of the smallest determinant, made consistent for normal data, and one reweighting by the 97.5 % quantile.

A scatter's diagonal carries ``floors`` squared, so that a statistic in which most documents agree exactly doesn't reject the others. A document
is judged by the estimate of its (language, source), or of its language, or of everything: the first that ``least`` documents support.
It is rejected where its squared distance exceeds the quantile of chi-square that normal data exceed with probability ``reject``.

Only counts, sums and moments by group are shuffled, a hot group's like any other's; no documents of a group are gathered.

Defined results: a null text has no words and fails the base rule; so do empty ones; null languages and sources are a language and a source of
their own; repeated rows and null ids are rows of their own; equal texts of one language and source have equal verdicts; where no document passes
the base rules there is nothing to estimate and nothing is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Standard deviations below which differences mean nothing, in thousandths: word length, symbols, capitals, signs, repeated lines, repeated words.
#: An arcsine root deviates by 1 / (2 sqrt(n)) through chance alone, which these are in a text of 20 words, 70 characters and 11 lines.
FLOORS = (100, 60, 60, 60, 150, 120)
SIZE = len(FLOORS)
PAIRS = tuple(combinations_with_replacement(range(SIZE), 2))
X = [f"x{i}" for i in range(SIZE)]


# ---- statistics of texts


def repeated_words(texts: Sequence[list[bytes]], window: int = 8) -> np.ndarray:
    """For each list of words: how many lie in windows that the list holds twice or more. ``window`` is a power of two."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.int64)
    if sizes.sum() < window:
        return out
    of = np.repeat(np.arange(len(texts)), sizes)
    ids = pd.factorize(np.array([w for t in texts for w in t], object))[0].astype(np.int64)
    at = np.arange(len(ids))  # where windows start
    width = 1
    while width < window:
        # windows of twice the width: two neighbours of one text
        end = at + 2 * width
        keep = end <= len(of)
        keep[keep] &= of[at[keep]] == of[end[keep] - 1]
        place = np.full(len(of) + 1, -1, np.int64)
        place[at] = ids
        at = at[keep]
        ids = pd.factorize(place[at] * (int(ids.max(initial=0)) + 1) + place[at + width])[0].astype(np.int64)
        width *= 2
    if not len(at):
        return out
    mine = pd.factorize(ids * len(texts) + of[at])[0]
    twice = at[np.bincount(mine)[mine] > 1]
    step = np.zeros(len(of) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + window, -1)
    return np.bincount(of[np.cumsum(step)[:-1] > 0], minlength=len(texts))


def counts_of(text: str | None) -> tuple[list[bytes], list[int]]:
    """The words of a text, and its word characters, symbols, repeated lines, lines with a word, capitals, letters, signs."""
    if not text:
        return [], [0] * 7
    data = text.encode("utf-8", "surrogatepass")
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = Counter(text)
    chars = len(text) - sum(n[c] for c in BLANKS)
    upper = sum(k for c, k in n.items() if c.isupper())
    letters = sum(k for c, k in n.items() if c.isalpha())
    signs = chars - sum(k for c, k in n.items() if c.isalnum())
    return data.split(), [chars, sum(n[c] for c in SYMBOLS), len(lines) - len(set(lines)), len(lines), upper, letters, signs]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts, and the transformed statistics x0 to x5 in thousandths (0 without words)."""
    names = [*COUNTS, *X]

    def chunks(texts: list[str | None], most: int = 1 << 22) -> Iterator[slice]:
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t or "") > most:
                yield slice(start, i)
                start, size = i, 0
            size += len(t or "")
        if start < len(texts):
            yield slice(start, len(texts))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(3).to_pylist()
            for s in chunks(texts):
                read = [counts_of(t) for t in texts[s]]
                words = np.array([len(w) for w, _ in read], np.int64)
                chars, symbols, dup, lines, upper, letters, signs = np.array([c for _, c in read], np.int64).T
                again = repeated_words([w for w, _ in read])
                some = words > 0
                length = np.log(np.where(some, chars, 1) / np.maximum(words, 1))
                shares = [np.arcsin(np.sqrt(np.minimum(1.0, part / np.maximum(whole, 1)))) for part, whole in ((symbols, chars), (upper, letters), (signs, chars), (dup, lines), (again, words))]
                x = [np.where(some, np.rint(1000 * v), 0).astype(np.int64) for v in (length, *shares)]
                made = [pa.array(c) for c in (words, chars, symbols, dup, again, *x)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(s.start, s.stop - s.start) for i in range(3)], *made], names=["doc_id", "lang", "source", *names])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


# ---- estimates


def chi_square(x: float, degrees: int) -> float:
    """The distribution function of chi-square for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def chi_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """What makes the scatter of the nearest ``share`` of normal data their own."""
    return share / chi_square(chi_quantile(share, SIZE), SIZE + 2) if share < 1 else 1.0


def distance(x: Sequence[Column], centre: Column, precision: Column) -> Column:
    """The squared Mahalanobis distance; ``precision`` holds the upper triangle of the inverse scatter."""
    d = [c - centre[i] for i, c in enumerate(x)]
    terms = [precision[k] * d[i] * d[j] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)]
    return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))


def moments(n: Column, x: Sequence[Column]) -> list[Column]:
    """Weighted counts, sums and products, as columns n, s, q."""
    n = n.cast("double")
    return [F.sum(n).alias("n"), F.array(*[F.sum(n * c) for c in x]).alias("s"), F.array(*[F.sum(n * x[i] * x[j]) for i, j in PAIRS]).alias("q")]


def add_moments() -> list[Column]:
    return [F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(SIZE)]).alias("s"), F.array(*[F.sum(F.col("q")[i]) for i in range(len(PAIRS))]).alias("q")]


#: A group's vectors are dealt over so many parts where they meet its estimates, so that no join brings a hot group into one task.
PARTS = 16


def meet(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Vectors (with ``part``) and what is known of their group."""
    return vectors.join(groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["key", "part"])


FITTED = "key string, start int, centre array<double>, precision array<double>, logdet double"


def fitted(sums: DataFrame, factor: float, floors: Sequence[float]) -> DataFrame:
    """Centre and inverse scatter of each row (key, start, n, s, q) of moments; where ``about`` is given, scatter is taken about it, in units of ``unit``."""
    a, b = np.array(PAIRS).T
    guided = "about" in sums.columns

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            t = {k: np.array(batch.column(batch.schema.get_field_index(k)).to_pylist(), float) for k in ("n", "s", "q", *(("about", "unit") if guided else ()))}
            mean = t["s"] / t["n"][:, None]
            scatter = np.zeros((batch.num_rows, SIZE, SIZE))
            scatter[:, a, b] = scatter[:, b, a] = t["q"] / t["n"][:, None]
            if guided:  # moments of scores: only their correlation is used
                root = np.sqrt(np.maximum(np.einsum("nii->ni", scatter), 1e-12))
                scatter /= root[:, :, None] * root[:, None, :]
                scatter *= t["unit"][:, :, None] * t["unit"][:, None, :]
                mean = t["about"]
            else:
                scatter -= mean[:, :, None] * mean[:, None, :]
            scatter = scatter * factor + np.diag(np.square(np.array(floors, float)))
            inverse = np.linalg.inv(scatter)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(mean), pa.list_(pa.float64())), pa.array(list(inverse[:, a, b]), pa.list_(pa.float64())), pa.array(np.linalg.slogdet(scatter)[1])],
                names=["key", "start", "centre", "precision", "logdet"],
            )

    return sums.select("key", "start", "n", "s", "q", *(["about", "unit"] if guided else [])).mapInArrow(solve, FITTED)


def middle(counts: DataFrame) -> DataFrame:
    """key, i, mid: the lower weighted median of rows (key, i, v, n), whose values are whole numbers: rows of a key are at most its distinct values."""
    by = Window.partitionBy("key", "i")
    summed = counts.groupBy("key", "i", "v").agg(F.sum("n").alias("n"))
    running = summed.withColumn("up", F.sum("n").over(by.orderBy("v"))).withColumn("all", F.sum("n").over(by))
    return running.where(F.col("up") * 2 >= F.col("all")).groupBy("key", "i").agg(F.min("v").alias("mid"))


def as_array(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "mid"))), lambda r: r["mid"].cast("double")).alias(name))


def starts(vectors: DataFrame, floors: Sequence[float]) -> DataFrame:
    """Three first estimates of each key, from all of its vectors."""
    long = vectors.select("key", "part", "n", F.posexplode(F.array(*X)).alias("i", "v"))
    about = materialise(as_array(middle(long), "about"))
    away = meet(long, about).select("key", "i", "n", F.abs(F.col("v") - F.expr("about[i]")).cast("long").alias("v"))
    unit = as_array(middle(away), "mads").select("key", F.array(*[F.greatest(F.lit(float(f)), F.col("mads")[i] * 1.4826) for i, f in enumerate(floors)]).alias("unit"))
    guides = materialise(about.join(unit, "key"))
    z = [(F.col(c) - F.col("about")[i]) / F.col("unit")[i] for i, c in enumerate(X)]
    norm = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]))
    scored = meet(vectors, guides).withColumn("z", F.array(*z)).withColumn("norm", norm)
    flat = [F.when(F.col("norm") > 0, F.col("z")[i] / F.col("norm")).otherwise(0.0) for i in range(SIZE)]
    ways = (("tanh", [F.tanh(F.col("z")[i]) for i in range(SIZE)]), ("sign", flat))
    sums = scored.groupBy("key").agg(*[m.alias(f"{name}_{col}") for name, x in ways for col, m in zip("nsq", moments(F.col("n"), x), strict=True)])
    none = F.array(*[F.lit(1.0 if i == j else 0.0) for i, j in PAIRS])
    rows = F.array(
        F.struct(F.lit(0).alias("start"), F.lit(1.0).alias("n"), F.col("tanh_s").alias("s"), none.alias("q")),
        *[F.struct(F.lit(k).alias("start"), F.col(f"{name}_n").alias("n"), F.col(f"{name}_s").alias("s"), F.col(f"{name}_q").alias("q")) for k, (name, _) in enumerate(ways, 1)],
    )
    return fitted(sums.select("key", F.inline(rows)).join(guides, "key"), 1.0, floors)


def nearest_moments(vectors: DataFrame, at: DataFrame, share: float, fine: int = 64) -> DataFrame:
    """Moments of the nearest ``share`` of each key's vectors under each estimate of ``at``, by bins of ln(1 + squared distance)."""
    x = [F.col(c) for c in X]
    binned = meet(vectors, at.select("key", "start", "centre", "precision")).withColumn("bin", F.floor(F.log1p(distance(x, F.col("centre"), F.col("precision"))) * fine))
    summed = binned.groupBy("key", "start", "bin").agg(*moments(F.col("n"), x))
    by = Window.partitionBy("key", "start")
    ranked = summed.withColumn("before", F.sum("n").over(by.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(by))
    return ranked.where(F.col("before") < F.ceil(F.col("all") * share)).groupBy("key", "start").agg(*add_moments())


def estimate(vectors: DataFrame, *, share: float = 0.75, floors: Sequence[float] = FLOORS, steps: int = 30, trial: int = 2) -> DataFrame:
    """key, centre, precision of rows (key, part, x0 to x5, n): the reweighted minimum covariance determinant of each key."""
    at = materialise(starts(vectors, floors).withColumn("falls", F.lit(True)))
    for step in range(steps):
        if step == trial:  # of each key's starts the best one goes on
            at = at.groupBy("key").agg(F.min_by(F.struct(*at.columns[1:]), F.struct("logdet", "start")).alias("b")).select("key", "b.*")
        active = at.where("falls")
        new = fitted(nearest_moments(vectors, active, share), 1.0, floors)
        old = active.select("key", "start", F.col("logdet").alias("was"))
        # the first step leaves a guess for a subset's scatter, so it may rise
        moved = new.join(old, ["key", "start"]).withColumn("falls", F.abs(F.col("logdet") - F.col("was")) > 1e-4).drop("was")
        at = materialise(moved.unionByName(at.where("not falls")))
        if at.where("falls").isEmpty():
            break
    best = at.groupBy("key").agg(F.min_by(F.struct("start", "centre", "precision"), F.struct("logdet", "start")).alias("b")).select("key", "b.*")
    raw = materialise(fitted(nearest_moments(vectors, best, share), consistency(share), floors))
    x = [F.col(c) for c in X]
    near = meet(vectors, raw).where(distance(x, F.col("centre"), F.col("precision")) <= chi_quantile(0.975, SIZE))
    return fitted(near.groupBy("key", "start").agg(*moments(F.col("n"), x)), consistency(0.975), floors).select("key", "centre", "precision")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``keys``: of the source in its language, the language, and everything."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source"))
    return rows.withColumn("keys", F.array(F.concat(F.lit("2:"), F.length(lang), F.lit(":"), lang, source), F.concat(F.lit("1:"), lang), F.lit("0:")))


def judge(docs: DataFrame, *, share: float = 0.75, reject: float = 1e-6, least: int = 100, floors: Sequence[float] = FLOORS, steps: int = 30) -> DataFrame:
    """doc_id, the five counts, base_failed, kept; then distance (squared, null where there is no estimate) and judged_by (2: language and source, 1: language, 0: everything)."""
    rows = materialise(statistics(docs).withColumn("base_failed", base_failed()))
    passed = with_keys(rows.where("not base_failed"))
    vectors = materialise(passed.groupBy("keys", *X).agg(F.count("*").alias("n")))
    supported = vectors.groupBy("keys").agg(F.sum("n").alias("n")).select(F.explode("keys").alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    supported = materialise(supported.where((F.col("n") >= least) | (F.col("key") == "0:")).select("key"))
    vectors = materialise(vectors.select(F.explode("keys").alias("key"), *X, "n").groupBy("key", *X).agg(F.sum("n").alias("n")).join(supported, "key", "left_semi").withColumn("part", F.pmod(F.xxhash64(*X), F.lit(PARTS)).cast("int")))
    estimates = materialise(estimate(vectors, share=share, floors=floors, steps=steps))
    # the estimate of each language and source, the most special one there is
    groups = with_keys(rows.select("lang", "source").distinct())
    chosen = groups.select("keys", F.posexplode("keys").alias("i", "key")).join(estimates, "key").groupBy("keys").agg(F.min_by(F.struct(F.lit(2) - F.col("i"), "centre", "precision"), "i").alias("e"))
    chosen = materialise(chosen.select("keys", F.col("e.col1").cast("int").alias("judged_by"), "e.centre", "e.precision"))
    measured = with_keys(rows).join(chosen, "keys", "left").withColumn("distance", F.when(F.col("centre").isNotNull(), distance([F.col(c) for c in X], F.col("centre"), F.col("precision"))))
    fine = F.coalesce(F.col("distance") <= chi_quantile(1 - reject, SIZE), F.lit(False))
    return measured.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & fine).alias("kept"), "distance", "judged_by")


def keep_ordinary(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were. Rows of equal id, text, language and source share a verdict."""
    rows = docs.withColumn("__h", F.xxhash64("doc_id", "text", "lang", "source"))
    verdict = judge(rows.select(F.col("__h").alias("doc_id"), "text", "lang", "source"), **params).where("kept").select(F.col("doc_id").alias("__h")).distinct()
    return rows.join(verdict, "__h", "left_semi").drop("__h")
