"""Predicted spans against gold spans. Span tables: sid, s, e, type; both sides are sets for each sid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["sid", "s", "e", "type"]


def ratio(part: Column, whole: Column, otherwise: float | None = 0.0) -> Column:
    r = F.try_divide(part.cast("double"), whole.cast("double"))
    return r if otherwise is None else F.coalesce(r, F.lit(otherwise))


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """precision, recall and f1 of count columns; 0 where a denominator is."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return [ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1")]


def matched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Full outer join on the whole span: sid, s, e, type, tp, fp, fn (0 or 1). One shuffle by the span for both sides."""
    both = gold.select(*KEY, F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select(*KEY, F.lit(0), F.lit(1)))
    both = both.groupBy(*KEY).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return both.select(*KEY, (F.col("g") * F.col("p")).alias("tp"), (F.col("p") * (1 - F.col("g"))).alias("fp"), (F.col("g") * (1 - F.col("p"))).alias("fn"))


def sentence_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn of each sid: the unit of resampling."""
    return matched(gold, pred).groupBy("sid").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def scores_by_type(gold: DataFrame, pred: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Counts and ratios for each type and, as type null, for all (micro). ``types`` adds types without spans."""
    counts = matched(gold, pred).groupingSets([["type"], []], "type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    counts = counts.select("type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    if types is not None:
        absent = types.select("type").distinct().join(counts.where("type IS NOT NULL"), "type", "left_anti")
        counts = counts.unionByName(absent.select("type", *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")]))
    return counts.withColumn("support", F.col("tp") + F.col("fn")).select("*", *prf())


def macro_f1(by_type: DataFrame) -> DataFrame:
    """Mean F1 over types that have gold spans."""
    return by_type.where("type IS NOT NULL AND support > 0").agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("macro_types"))


def error_labels(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Each distinct predicted span with its class: correct, type_error, boundary_error, boundary_type_error, spurious.

    Equi-join by sid; the best of a prediction's meetings is a maximum, so it is aggregated before anything is kept.
    """
    g, p = gold.select(*KEY).distinct().alias("g"), pred.select(*KEY).distinct().alias("p")
    same, bounds = F.expr("p.type = g.type"), F.expr("p.s = g.s AND p.e = g.e")
    code = F.when(bounds & same, 4).when(bounds, 3).when(same, 2).otherwise(1)
    met = p.join(g, F.expr("p.sid = g.sid AND g.s < p.e AND p.s < g.e"), "left").withColumn("code", F.when(F.col("g.sid").isNull(), 0).otherwise(code))
    names = F.array(*[F.lit(x) for x in ("spurious", "boundary_type_error", "boundary_error", "type_error", "correct")])
    return met.groupBy(*[F.col(f"p.{k}").alias(k) for k in KEY]).agg(F.max("code").alias("code")).select(*KEY, F.element_at(names, F.col("code") + 1).alias("label"))


def error_taxonomy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """label, n: exact spans leave both sides first; each other prediction takes one gold span (equal bounds, then type, then the
    lowest s, e, type); gold spans that none has taken are missed."""
    m = matched(gold, pred)
    g, p = m.where("fn = 1").select(*KEY).alias("g"), m.where("fp = 1").select(*KEY).alias("p")
    bounds, same = F.expr("p.s = g.s AND p.e = g.e"), F.expr("p.type = g.type")
    kind = F.when(bounds, "type_error").when(same, "boundary_error").otherwise("boundary_type_error")
    rank = F.when(bounds, 0).when(same, 1).otherwise(2)
    met = p.join(g, F.expr("p.sid = g.sid AND g.s < p.e AND p.s < g.e")).select(
        F.struct(*[F.col(f"p.{k}") for k in KEY]).alias("p"), F.struct(rank.alias("rank"), *[F.col(f"g.{k}") for k in ("s", "e", "type", "sid")]).alias("g"), kind.alias("label")
    )
    taken = met.groupBy("p").agg(F.min_by("label", "g").alias("label"), F.min("g").alias("g"))
    hit = taken.select("g.sid", "g.s", "g.e", "g.type").distinct()
    counts = (
        m.where("tp = 1").select(F.lit("correct").alias("label"))
        .union(taken.select("label"))
        .union(p.select(F.struct(*KEY).alias("p")).join(taken, "p", "left_anti").select(F.lit("spurious")))
        .union(g.join(hit, KEY, "left_anti").select(F.lit("missed")))
    )
    return counts.groupBy("label").agg(F.count("*").alias("n"))


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold_type, pred_type, n over equal bounds; O where a side has none; the last type (by name) where a side has several."""

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sid", "s", "e").agg(F.max("type").alias(name))

    both = one(gold, "gold_type").join(one(pred, "pred_type"), ["sid", "s", "e"], "full")
    return both.select(*[F.coalesce(c, F.lit("O")).alias(c) for c in ("gold_type", "pred_type")]).groupBy("gold_type", "pred_type").agg(F.count("*").alias("n"))


def token_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn over tokens with their types, whether at the start of a span or inside."""

    def tokens(df: DataFrame) -> DataFrame:
        return df.where("e > s").select("sid", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("s"), "type").withColumn("e", F.col("s") + 1)

    return matched(tokens(gold), tokens(pred)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])


def overlap_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn with one-to-one matches of spans of one type that overlap, in order; duplicates count."""
    from ..functions.spans import lenient_matches

    def lists(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sid").agg(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "type")).alias(name))

    none = F.array().cast("array<struct<s:int,e:int,type:string>>")
    rows = lists(gold, "g").join(lists(pred, "p"), "sid", "full").select(F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))
    n = lenient_matches(F.col("g"), F.col("p"))
    return rows.select(n.alias("tp"), (F.size("p") - n).alias("fp"), (F.size("g") - n).alias("fn")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])


def seen_unseen_recall(gold: DataFrame, pred: DataFrame, lexicon: DataFrame) -> DataFrame:
    """grp (seen or unseen), recall, gold: recall of gold spans (with ``key``) by whether the lexicon (key) has their surface."""
    hits = gold.join(pred.select(*KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left")
    known = lexicon.select("key").distinct().withColumn("known", F.lit(1))
    return (
        hits.join(known, "key", "left")
        .groupBy(F.when(F.col("known") == 1, "seen").otherwise("unseen").alias("grp"))
        .agg(ratio(F.count("hit"), F.count("*")).alias("recall"), F.count("*").alias("gold"))
    )


def exposure_recall(gold: DataFrame, pred: DataFrame, train: DataFrame, demos: DataFrame) -> DataFrame:
    """Recall by where a surface was met: in training data, in demonstrations, in both or nowhere."""
    t, d = train.select("key").distinct().withColumn("t", F.lit(1)), demos.select("key").distinct().withColumn("d", F.lit(1))
    hits = gold.join(pred.select(*KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left").join(t, "key", "left").join(d, "key", "left")
    group = F.when(F.col("t").isNotNull() & F.col("d").isNotNull(), "both").when(F.col("t").isNotNull(), "train").when(F.col("d").isNotNull(), "demo").otherwise("none")
    return hits.groupBy(group.alias("grp")).agg(ratio(F.count("hit"), F.count("*")).alias("recall"), F.count("*").alias("gold"))


def evaluation(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: micro counts and ratios, macro F1, lenient and token F1."""
    by_type = scores_by_type(gold, pred)
    micro = by_type.where("type IS NULL").drop("type")
    lenient = overlap_counts(gold, pred).select(prf()[2].alias("overlap_f1"))
    token = token_counts(gold, pred).select(prf()[2].alias("token_f1"))
    return micro.crossJoin(macro_f1(by_type)).crossJoin(lenient).crossJoin(token)  # one row each


def run_totals(records: DataFrame, failures: DataFrame) -> DataFrame:
    """One row about a run: sentences, those given up, unaligned entities, mean latency, tokens, validator actions, failed attempts.

    records: a row for each sentence, with arrays ``unaligned`` and ``validator_actions``. What was given up counts as a sentence and nowhere else; a latency of
    0 is unknown, as is a null.
    """
    done = ~F.coalesce("abandoned", F.lit(False))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(done, c)), F.lit(0)).cast("long")

    def entries(name: str) -> Column:
        return F.coalesce(F.array_size(name), F.lit(0))

    out = records.agg(
        F.count("*").alias("n_sentences"), F.count_if(~done).alias("n_abandoned"), total(entries("unaligned")).alias("unaligned"), F.avg(F.when(done & (F.col("latency_s") != 0), F.col("latency_s"))).alias("mean_latency_s"),
        total(F.col("prompt_tokens")).alias("prompt_tokens"), total(F.col("completion_tokens")).alias("completion_tokens"), total(entries("validator_actions")).alias("validator_actions"),
    )
    return out.crossJoin(failures.agg(F.count("*").alias("failed_attempts")))  # one row each


def with_absent(subset: DataFrame, records: DataFrame) -> DataFrame:
    """Every id of the subset in its order; no record means no predictions and ``abandoned``."""
    none = F.array().cast("array<struct<s:int,e:int,type:string>>")
    return subset.join(records, "sid", "left").select(*subset.columns, F.coalesce("pred", none).alias("pred"), F.col("pred").isNull().alias("abandoned"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of two runs side by side; raises on the executors if their sids differ."""
    both = a.select("sid", *[F.col(c).alias(f"{c}_a") for c in ("tp", "fp", "fn")]).join(b.select("sid", *[F.col(c).alias(f"{c}_b") for c in ("tp", "fp", "fn")]), "sid", "full")
    check = F.when(F.col("tp_a").isNull() | F.col("tp_b").isNull(), F.raise_error(F.lit("the runs cover different sentences"))).otherwise(F.col("tp_a"))
    return both.withColumn("tp_a", check)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
