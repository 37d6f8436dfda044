"""Report tables: corpora, graphs, families of comparisons, rollups by sentence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import ratio
from .resampling import approximate_randomization, bootstrap_f1, paired_bootstrap
from .stats import holm, spearman


def corpus_description(spans: DataFrame, sentences: DataFrame, train: DataFrame) -> DataFrame:
    """One row: rows, unique sentences, mentions, distinct and novel surfaces, types, mean tokens. spans: key, type; train: key."""
    novel = spans.select("key").distinct().join(train.select("key").distinct(), "key", "left_anti").agg(F.count("*").alias("novel"))
    text = sentences.agg(F.count("*").alias("sentences"), F.countDistinct(F.sha2(F.array_join("tokens", " "), 256)).alias("unique_sentences"), F.avg(F.size("tokens")).alias("mean_tokens"))
    return text.crossJoin(spans.agg(F.count("*").alias("mentions"), F.countDistinct("key").alias("distinct_mentions"), F.countDistinct("type").alias("types"))).crossJoin(novel)  # one row each


def type_distribution(spans: DataFrame) -> DataFrame:
    n = spans.groupBy("type").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("all"))).select("type", "n", ratio(F.col("n"), F.col("all")).alias("share"))  # one row on the right


def kg_stats(labels: DataFrame, classes: Mapping[str, str]) -> DataFrame:
    """type, nodes, labels of a graph's labels (uri, label, kinds) by the type that a class maps to; type null: all."""
    names = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    rows = labels.select("uri", "label", F.explode_outer("kinds").alias("class")).withColumn("type", F.element_at(names, F.col("class")))
    cells = rows.where("type IS NOT NULL").groupBy("type").agg(F.countDistinct("uri").alias("nodes"), F.countDistinct("label").alias("labels"))
    return cells.unionByName(labels.agg(F.countDistinct("uri").alias("nodes"), F.countDistinct("label").alias("labels")).withColumn("type", F.lit(None).cast("string")))


def sentence_rollup(scored: DataFrame, pass_at: float = 0.75) -> DataFrame:
    """run, sid, mean and lowest score, share at or above the pass threshold, mean completeness."""
    return scored.groupBy("run", "sid").agg(
        F.avg("overall").alias("mean_score"), F.min("overall").alias("min_score"), F.avg((F.col("overall") >= pass_at).cast("double")).alias("share_passed"), F.avg("completeness").alias("mean_completeness")
    )


def sentence_correlations(scored: DataFrame, f1: DataFrame) -> DataFrame:
    """feature, rho: rank correlations of the rollups with the sentence's F1 (run, sid, f1)."""
    rows = sentence_rollup(scored).join(f1, ["run", "sid"])
    names = ["mean_score", "min_score", "share_passed", "mean_completeness"]
    long = rows.select("f1", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])))
    return spearman(long, "v", "f1", ["feature"])


def comparison(pair: DataFrame, name: str, reps: int, seed: int = 7) -> DataFrame:
    """name, delta, low, high, p of two runs' counts (sid, tp_a .. fn_b)."""
    test = approximate_randomization(pair, reps, seed)
    return test.crossJoin(paired_bootstrap(pair, reps, seed).select("low", "high")).select(F.lit(name).alias("name"), "delta", "low", "high", "p")  # one row each


def comparisons(pairs: Mapping[str, DataFrame], reps: int = 1000, seed: int = 7) -> DataFrame:
    """A family of comparisons with p adjusted by Holm. The caller names the few pairs."""
    out = None
    for name, pair in pairs.items():
        row = comparison(pair, name, reps, seed)
        out = row if out is None else out.unionByName(row)
    return holm(out, "p", order="name")


def classification(runs: Mapping[str, DataFrame], reps: int = 1000, seed: int = 7) -> DataFrame:
    """run, tp, fp, fn, f1, low, high for the counts of each run."""
    out = None
    for name, counts in runs.items():
        total = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        row = total.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).crossJoin(bootstrap_f1(counts, reps, seed).select("low", "high")).select(F.lit(name).alias("run"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def completeness_of_batches(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: requests, answered, missing, unexpected answers."""
    a, b = requests.select("custom_id").distinct().withColumn("r", F.lit(1)), answers.select("custom_id").distinct().withColumn("a", F.lit(1))
    both = a.join(b, "custom_id", "full")
    return both.agg(F.count("r").alias("requests"), F.count_if(F.col("r").isNotNull() & F.col("a").isNotNull()).alias("answered"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("unexpected"))


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Spans of two annotation layers: of the first, of the second, and of the second found by the first."""
    from .evaluate import matched

    return matched(second, first).agg(F.sum(F.col("tp") + F.col("fp")).alias("first"), F.sum(F.col("tp") + F.col("fn")).alias("second"), F.sum("tp").alias("found"))


def build_index(spans: DataFrame, sentences: DataFrame, path: str, splits: DataFrame | None = None) -> dict:
    """Write a surface index and its triples below ``path``; returns a manifest. Raises if test data are among the sources."""
    from ..sources.sinks import index_triples, write_ntriples
    from .lexicon import surface_index

    if splits is not None and splits.where("split = 'test'").limit(1).count():
        raise ValueError("the graph never holds test data")
    surface_index(spans, sentences).write.mode("overwrite").parquet(f"{path}/index")
    index = spans.sparkSession.read.parquet(f"{path}/index")
    write_ntriples(index_triples(index), f"{path}/triples")
    row = index.agg(F.count("*").alias("keys"), F.sum("total").alias("mentions"), F.sum("o").alias("outside")).first()
    return {k: int(row[k] or 0) for k in ("keys", "mentions", "outside")}
