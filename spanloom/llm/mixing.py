"""Mixing sources to target weights by subset-sum budget fitting.

Sources, ordered by code point with null last, weigh ``weights`` in turn and share the words of all sources. No target
exceeds ``most`` times its source's size; the excess goes to the other sources by weight. A source takes every document
``target // size`` times; what is left of its budget is fitted exactly: counts of documents by length are scaled to the
budget, and a bounded-knapsack dynamic program over lengths with their counts settles the last words. The documents of
each chosen length are then picked by a seeded hash.

Tasks see counts by (source, length), never a source's rows; a (source, length) that holds a third of all rows is ranked
in ``salts`` parts.

Defined results: a null text has size 0; documents without words are taken 0 words; a null source is a source of its own
(last); repeated rows and null ids are rows of their own; an empty table gives no rows. Rows that tie on the seeded hash are
alike in every column that is returned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that the words come as near to ``budget`` as any choice does.

    Bounded knapsack over the sums that can be nearest: counts are split into powers of two, each sum remembers the item
    that reached it first.
    """
    took = [0] * len(lengths)
    if budget <= 0:
        return took
    most = budget + min(budget, max(lengths, default=0))
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    item = np.full(most + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        part, left = 1, min(int(count), most // length if length else 0)
        while left > 0 and not reached[budget]:
            k = min(part, left)
            left -= k
            part *= 2
            step = k * length
            fresh = np.zeros(most + 1, bool)
            fresh[step:] = reached[:-step]
            fresh &= ~reached
            item[fresh] = len(items)
            reached |= fresh
            items.append((i, k))
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, k = items[item[at]]
        took[i] += k
        at -= k * lengths[i]
    return took


def near_knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int, cells: int) -> list[int]:
    """The same for a budget of any size, in ``cells`` cells of equal width, each of which keeps the first sum that falls into it, exactly.

    Each item can cost one cell's width, so the result is off by at most their number over ``cells`` of the budget; in practice by far less.
    """
    took = [0] * len(lengths)
    if budget <= 0:
        return took
    most = budget + min(budget, max(lengths, default=0))
    unit = most // cells + 1
    goal = budget // unit
    value = np.full(most // unit + 1, -1, np.int64)
    value[0] = 0
    item, came = np.full(len(value), -1, np.int32), np.full(len(value), -1, np.int64)
    items: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        part, left = 1, min(int(count), most // length if length else 0)
        while left > 0 and value[goal] != budget:
            k = min(part, left)
            left -= k
            part *= 2
            at = np.flatnonzero(value >= 0)  # sums grow with their cells
            sums = value[at] + k * length
            at, sums = at[sums <= most], sums[sums <= most]
            exact = np.flatnonzero((sums == budget) & (at != goal))
            if len(exact):  # nothing is built on it any more, so it may take its cell from another sum
                value[goal], item[goal], came[goal] = budget, len(items), at[exact[0]]
            else:
                cell = sums // unit
                first = np.flatnonzero((value[cell] < 0) & np.append(True, cell[1:] != cell[:-1])[: len(cell)])
                value[cell[first]], item[cell[first]], came[cell[first]] = sums[first], len(items), at[first]
            items.append((i, k))
    reached = np.flatnonzero(value >= 0)
    at = int(reached[np.argmin(np.abs(value[reached] - budget))])
    while at:
        i, k = items[item[at]]
        took[i] += k
        at = int(came[at])
    return took


def settle(lengths: np.ndarray, counts: np.ndarray, x: np.ndarray, left: int, most_exact: int) -> int:
    """Add to ``x`` (at most ``counts``) documents of ``left`` words, and return what is still left (below 0: too many).

    Long documents fill until at most ``most_exact`` words are left, for which the dynamic program is exact. More are left only
    where no unused document is short enough; its cells are wider then.
    """
    if left > most_exact:
        for i in np.argsort(-lengths, kind="stable"):
            take = int(min(counts[i] - x[i], max(0, left - most_exact // 2) // max(1, lengths[i])))
            x[i] += take
            left -= take * int(lengths[i])
    usable = np.flatnonzero((counts > x) & (lengths <= 2 * left))
    usable = usable[np.argsort(-lengths[usable], kind="stable")]
    if len(usable):
        some, open_ = [int(v) for v in lengths[usable]], [int(v) for v in (counts - x)[usable]]
        took = np.array(knapsack(some, open_, left) if left <= 4 * most_exact else near_knapsack(some, open_, left, 4 * most_exact), np.int64)
        x[usable] += took
        left -= int((took * lengths[usable]).sum())
    return left


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, most_exact: int = 1 << 16, near: int = 1000) -> np.ndarray:
    """Choose ``0 <= x <= counts`` with ``sum(x * lengths)`` near to ``budget``.

    Counts are scaled down to the budget and the rest is settled. Where that is off by more than a ``near``-th of the budget, as long documents can make it, the
    dynamic program runs over the whole budget, in cells, what it leaves is settled in its turn, and the nearer choice is taken; of equal ones the scaled.
    """
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    x = np.array([int(c) * budget // total for c in counts], np.int64)
    left = settle(lengths, counts, x, budget - int((x * lengths).sum()), most_exact)
    if abs(left) * near <= budget:
        return x
    order = np.argsort(-lengths, kind="stable")
    y = np.zeros(len(lengths), np.int64)
    y[order] = near_knapsack([int(v) for v in lengths[order]], [int(c) for c in counts[order]], budget, 4 * most_exact)
    over = budget - int((y * lengths).sum())
    if over > 0:
        over = settle(lengths, counts, y, over, most_exact)
    return y if abs(over) < abs(left) else x


def source_targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """skey, source_size, target from rows (skey, size), where a null source's key sorts last. One row for each source."""
    per = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # the level at which weight * level fills the whole: sources below it are at their cap
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    above = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(above))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("skey"), F.col("level")))
    per = per.withColumn("at", F.min(fits).over(everything)["level"])
    return per.select("skey", "source_size", F.least(F.col("w") * F.coalesce("at", F.lit(0.0)), F.col("cap")).alias("target"))


def with_copies(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), most: int = 3, salts: int = 32, seed: int = 29, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (times that the mix takes the document), and ``keep``."""
    ids = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("skey"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            ids.alias("h"),
            *[F.col(c) for c in keep],
        ).withColumn("salt", F.pmod(F.col("h"), F.lit(salts)).cast("int"))
    )
    targets = materialise(source_targets(rows, weights, most))
    counts = materialise(rows.groupBy("skey", "size", "salt").agg(F.count("*").alias("n")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        size, budget = int(pdf["source_size"].iloc[0]), int(np.floor(pdf["target"].iloc[0] + 0.5))
        rounds = min(most, budget // size) if size else 0
        lengths, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        extra = np.zeros(len(n), np.int64)
        if size and rounds < most:
            some = lengths > 0
            extra[some] = fit(lengths[some], n[some], budget - rounds * size)
        return pd.DataFrame({"skey": pdf["skey"], "size": lengths, "rounds": np.int32(rounds), "extra": extra})

    lengths = counts.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(targets, "skey")
    quota = lengths.groupBy("skey").applyInPandas(choose, "skey string, size long, rounds int, extra long")
    before = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        counts.join(quota, ["skey", "size"])
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0)))))
        .join(targets, "skey")
        .select("skey", "size", "salt", "rounds", "part", "source_size", "target")
    )
    parts = materialise(parts)
    picked = Window.partitionBy("skey", "size", "salt").orderBy("h", "doc_id")
    return (
        rows.join(parts, ["skey", "size", "salt"])
        .withColumn("copies", (F.col("rounds") + (F.row_number().over(picked) <= F.col("part")).cast("int")).cast("int"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *keep)
    )


def mix(docs: DataFrame, **params) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``: a document of n copies is n rows.

    Documents without words weigh nothing in the budget; each of them is kept once.
    """
    names = list(docs.columns)
    wrapped = docs.select("doc_id", "text", "source", F.struct(*[F.col(c) for c in names]).alias("__row"))
    taken = with_copies(wrapped, keep=["__row"], **params)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))
    return taken.where(times > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), times))).select("__row.*")
