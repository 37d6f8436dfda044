"""Rank statistics, calibration, decisions, corrections. Every statistic takes grouping columns, so slices are one plan.

Ties are aggregated first, and running sums over the distinct scores of a group are made in two levels: totals of at most
``BUCKETS`` stretches of the score's range, then sums within a stretch. So no task orders all scores of a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 4096


def _by(group: Sequence[str], *order) -> object:
    w = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))
    return w.orderBy(*order) if order else w


def _meet(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join by keys where nulls are equal; without keys ``small`` is one row."""
    if not keys:
        return df.crossJoin(small)
    small = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(small, on).drop(*[f"__k{i}" for i in range(len(keys))])


def running(cells: DataFrame, group: Sequence[str], score: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Rows with one distinct finite or infinite score each, plus before_<c>: the sum of column c over the scores before (below, or above if descending)."""
    s, inf = F.col(score), float("inf")
    finite = F.when(F.abs(s) < inf, s)
    ends = cells.groupBy(*group).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"))
    place = F.coalesce(F.floor(F.try_divide(s - F.col("__lo"), F.col("__hi") - F.col("__lo")) * BUCKETS), F.lit(0))
    place = F.when(s == inf, BUCKETS + 1).when(s == -inf, -1).otherwise(place).cast("int")
    rows = _meet(cells, ends, group).withColumn("__b", -place if descending else place).drop("__lo", "__hi")
    totals = rows.groupBy(*group, "__b").agg(*[F.sum(c).alias(c) for c in sums])
    ahead = _by(group, "__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__b", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__t_{c}") for c in sums])
    inside = Window.partitionBy(*group, "__b").orderBy(F.desc(score) if descending else F.asc(score)).rowsBetween(Window.unboundedPreceding, -1)
    rows = _meet(rows, totals, [*group, "__b"])
    return rows.select(*cells.columns, *[(F.col(f"__t_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in sums])


def score_counts(df: DataFrame, score: str, label: str, group: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """group, s, pos, neg: (weighted) rows of each class at each distinct score. NaN and null scores take no part."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    y = F.col(label).cast("int") == 1
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    return rows.groupBy(*group, F.col(score).cast("double").alias("s")).agg(F.sum(F.when(y, w).otherwise(0.0)).alias("pos"), F.sum(F.when(y, 0.0).otherwise(w)).alias("neg"))


def auroc(df: DataFrame, score: str = "score", label: str = "y", group: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """group, auroc, n_pos, n_neg: the share of pairs in order, ties half; null where a class is missing."""
    counts = running(score_counts(df, score, label, group, weight), group, "s", ["neg"])
    won = counts.withColumn("won", F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    out = won.groupBy(*group).agg(F.sum("won").alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*group, F.try_divide("w", F.col("n_pos") * F.col("n_neg")).alias("auroc"), F.col("n_pos").cast("long"), F.col("n_neg").cast("long"))


def average_precision(df: DataFrame, score: str = "score", label: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """group, pr_auc: precision at each distinct score from the top, weighted by the recall it adds."""
    counts = running(score_counts(df, score, label, group), group, "s", ["pos", "neg"], descending=True)
    run = counts.withColumn("tp", F.col("before_pos") + F.col("pos")).withColumn("seen", F.col("tp") + F.col("before_neg") + F.col("neg"))
    return run.groupBy(*group).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("pr_auc"))


def average_ranks(df: DataFrame, column: str, group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Ranks from 1, ties at their mean."""
    cells = df.groupBy(*group, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running(cells, group, "__v", ["__n"]).select(*group, F.col("__v").alias(column), (F.col("before___n") + (F.col("__n") + 1) / 2).alias(name))
    return _meet(df, ranks, [*group, column])


def spearman(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """group, rho: correlation of average ranks."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(rows, a, group, "__a"), b, group, "__b")
    return ranked.groupBy(*group).agg(F.corr("__a", "__b").alias("rho"))


def cliffs_delta(df: DataFrame, score: str = "score", label: str = "y", group: Sequence[str] = ()) -> DataFrame:
    return auroc(df, score, label, group).select(*group, (2 * F.col("auroc") - 1).alias("delta"))


def kruskal(df: DataFrame, value: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """group, h, df: the Kruskal-Wallis statistic with tie correction. The p-value is :func:`chi2_tail` of it."""
    ranked = average_ranks(df.where(F.col(value).isNotNull()), value, group, "__r")
    parts = ranked.groupBy(*group, label).agg(F.sum("__r").alias("r"), F.count("*").alias("n"))
    total = parts.groupBy(*group).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("t")).groupBy(*group).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    both = total.join(ties, list(group)) if group else total.crossJoin(ties)  # one row each
    n = F.col("n").cast("double")
    h = F.try_divide(12 * F.col("q"), n * (n + 1)) - 3 * (n + 1)
    return both.select(*group, F.try_divide(h, 1 - F.try_divide(F.col("ties"), n * n * n - n)).alias("h"), (F.col("k") - 1).alias("df"))


def chi2_tail(h: float, df: int) -> float:
    """P(X > h) for chi-squared with df degrees of freedom: the regularised upper incomplete gamma function."""
    a, x = df / 2, h / 2
    if x <= 0:
        return 1.0
    if x < a + 1:  # series of the lower part
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(a * math.log(x) - x - math.lgamma(a)))
    tiny = 1e-300  # continued fraction of the upper part
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h_ = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h_ *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h_ * math.exp(a * math.log(x) - x - math.lgamma(a))


def calibration(df: DataFrame, p: str = "p", label: str = "y", group: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """group, bin, n, mean_p, rate: equal bins, closed at their left end, the last at both. Edges are compared, not divided."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    k = F.aggregate(edges, F.lit(0), lambda a, e: a + F.when(F.col(p) >= e, 1).otherwise(0))
    return df.where(F.col(p).isNotNull()).groupBy(*group, k.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))


def calibration_summary(df: DataFrame, p: str = "p", label: str = "y", group: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """group, ece, brier."""
    cells = calibration(df.withColumn("__se", F.pow(F.col(p) - F.col(label), 2)), p, label, group, bins)
    ece = cells.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    brier = df.where(F.col(p).isNotNull()).groupBy(*group).agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))
    return ece.join(brier, list(group)) if group else ece.crossJoin(brier)  # one row each


def decision_metrics(df: DataFrame, decision: str = "decision", label: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """Shares of decisions, and seven conditional rates; null where a condition never holds."""
    y, d = F.col(label) == 1, F.col(decision)

    def rate(part: Column, whole: Column) -> Column:
        return F.try_divide(F.count_if(part & whole).cast("double"), F.count_if(whole))

    passed, failed = d == "passed", d == "failed"
    return df.groupBy(*group).agg(
        rate(passed, F.lit(True)).alias("share_passed"), rate(d == "needs_review", F.lit(True)).alias("share_review"), rate(failed, F.lit(True)).alias("share_failed"),
        rate(y, passed).alias("p_correct_given_passed"), rate(passed, ~y).alias("false_acceptance"), rate(~passed, y).alias("false_rejection"), rate(~y, failed).alias("p_incorrect_given_failed"),
    )


def filter_effect(df: DataFrame, keep: str, label: str, total_gold: int | Column) -> DataFrame:
    """Precision, recall and F1 before and after a filter keeps only some rows."""
    gold = total_gold if isinstance(total_gold, Column) else F.lit(total_gold)
    y, k = F.col(label) == 1, F.col(keep).cast("boolean")
    n = df.agg(F.count("*").alias("n"), F.count_if(y).alias("tp"), F.count_if(k).alias("kn"), F.count_if(k & y).alias("ktp")).withColumn("gold", gold.cast("double"))

    def three(tp: str, m: str, name: str) -> list[Column]:
        p, r = F.coalesce(F.try_divide(F.col(tp), F.col(m)), F.lit(0.0)), F.coalesce(F.try_divide(F.col(tp), F.col("gold")), F.lit(0.0))
        return [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias(f"{name}_f1")]

    return n.select(*three("tp", "n", "unfiltered"), *three("ktp", "kn", "filtered"))


def holm(df: DataFrame, p: str = "p", family: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Adds p_holm: step-down running maximum of (m - i) p, at most 1. Null p take no part and stay null."""
    has = F.col(p).isNotNull()
    w = Window.partitionBy(*family, has).orderBy(p, *([order] if order else []))
    m = F.count(p).over(Window.partitionBy(*family, has))
    raw = (m - F.row_number().over(w) + 1) * F.col(p)
    ranked = df.withColumn("__a", raw)
    run = F.max("__a").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_holm", F.when(has, F.least(F.lit(1.0), run))).drop("__a")


def score_summary(df: DataFrame, score: str = "overall", group: Sequence[str] = ()) -> DataFrame:
    """Mean and exact quantiles by linear interpolation."""
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    return df.groupBy(*group).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), *[F.percentile(score, x).alias(f"q{int(x * 100)}") for x in q])


def criterion_by_label(df: DataFrame, criteria: Sequence[str], label: str = "label") -> DataFrame:
    """criterion, label, n, mean, median of the rows where the criterion was assessed."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("v")) for c in criteria])).alias("x")).select(label, "x.*")
    return long.where("v IS NOT NULL").groupBy("criterion", label).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"))


def discrimination(df: DataFrame, criteria: Sequence[str], label: str = "y", group: Sequence[str] = (), least: int = 30) -> DataFrame:
    """AUROC of each criterion; null where a class has fewer than ``least`` rows."""
    long = df.select(*group, label, F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("v")) for c in criteria])).alias("x")).select(*group, label, "x.*")
    out = auroc(long, "v", label, [*group, "criterion"])
    return out.withColumn("auroc", F.when((F.col("n_pos") >= least) & (F.col("n_neg") >= least), F.col("auroc")))


def slices(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row once for the pooled slice and once for each column: slice, value. The input of any statistic by slice."""
    pairs = [F.struct(F.lit("pooled").alias("slice"), F.lit("all").alias("value"))] + [F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in by]
    return df.withColumn("__s", F.explode(F.array(*pairs))).select("*", "__s.slice", "__s.value").drop("__s")


def gap_closed(a: Column, b: Column, ceiling: Column) -> Column:
    """Share of the distance from a to the ceiling that b covers."""
    return F.coalesce(F.try_divide(b - a, ceiling - a), F.lit(float("nan")))
