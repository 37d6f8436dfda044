"""Similarity of mentions to graph labels: matching-block ratio, containment, and the joins built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from .blocks import ratio, shared_at_most, signature
from .inside import finder
from .prefix import frequencies, meet_once, prefix, rare_first


def containment(a: Column, b: Column) -> Column:
    """Shorter over longer length where one text holds the other, else 0."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((longer > 0) & (F.contains(a, b) | F.contains(b, a)), shorter / longer).otherwise(0.0)


def occurrences(text: Column) -> Column:
    """Each character with its number among the equal ones before it: two texts share as many of these as they can have matching characters."""
    chars = F.split(text, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")))


def prefixes(texts: DataFrame, column: str, frequency: DataFrame, least: float) -> DataFrame:
    """column, n, sig, prefix: the rarest of the text's numbered characters.

    A similarity of t needs at least n t / (2 - t) shared characters, whatever the other's length.
    """
    rows = texts.select(column).distinct().where(F.length(column) > 0)
    sorted_ = rare_first(rows, column, occurrences(F.col(column)), frequency)
    n = F.size("tokens")
    return sorted_.select(column, n.alias("n"), signature(F.col(column)).alias("sig"), prefix(F.col("tokens"), n * (least / (2 - least))).alias("prefix"))


def candidates(queries: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Pairs (q, label) of texts that may have a similarity of at least ``least``, each once, whatever their classes; equal texts among them.

    An exact prefix filter: both sides meet by equality on one of the rarest of their characters (numbered, rare ones first), are kept at the first that
    both prefixes hold, and only where lengths and shared characters allow the bound. Nothing is broadcast or capped.
    """
    held = labels.select("label").distinct()
    frequency = frequencies(held, occurrences(F.col("label")))
    asked = prefixes(queries, "q", frequency, least).select("q", F.col("n").alias("qn"), F.col("sig").alias("qs"), F.col("prefix").alias("qp"))
    there = prefixes(held, "label", frequency, least)
    n = F.col("n") + F.col("qn")
    possible = (2 * F.least("n", "qn") >= least * n - 1e-9) & (2 * shared_at_most(F.col("sig"), F.col("qs")) >= least * n - 1e-9)
    return meet_once(asked, "qp", there, "prefix").where(possible).select("q", "label")


def of_class(pairs: DataFrame, queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, kind, label, uri) of pairs (q, label, ...), where the node has the query's class; a query without class meets all."""
    extra = [c for c in pairs.columns if c not in ("q", "label")]
    rows = pairs.join(queries.select("q", "kind").distinct(), "q").join(labels.select("label", "uri", "kinds"), "label")
    return rows.where(F.col("kind").isNull() | F.array_contains("kinds", F.col("kind"))).select("q", "kind", "label", "uri", *extra).distinct()


def find_matches(queries: DataFrame, labels: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """q, kind, uri, label, similarity, rank: the k best graph nodes for each query, one label (the best) for each.

    queries: q (normalised), kind (class or null). labels: label (normalised), uri, kinds (array). Each pair of different texts
    is compared once, however many nodes and classes share them; containment never exceeds the ratio but for long texts, and is taken where it does.
    """
    pairs = candidates(queries, labels, least)
    scored = pairs.withColumn("similarity", F.when(F.col("q") == F.col("label"), 1.0).otherwise(F.greatest(ratio("q", "label"), containment(F.col("q"), F.col("label"))))).where(F.col("similarity") >= least)
    return top_per_uri(of_class(scored, queries, labels).select("q", "kind", "label", "uri", "similarity"), k)


def top_per_uri(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("q", "kind", "uri").agg(F.min(F.struct(-F.col("similarity"), "label", "similarity")).alias("b")).select("q", "kind", "uri", "b.label", "b.similarity")
    w = Window.partitionBy("q", "kind").orderBy(F.desc("similarity"), "label", "uri")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_matches(local: DataFrame, external: DataFrame, k: int = 10) -> DataFrame:
    """Matches of two graphs, the better of each node."""
    cols = ["q", "kind", "label", "uri", "similarity"]
    return top_per_uri(local.select(*cols).union(external.select(*cols)), k)


def contained(queries: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """q, label, similarity of pairs of which one holds the other, with similarity of at least ``least``."""
    pairs = of_class(candidates(queries, labels, least), queries, labels)
    return pairs.select("q", "label").distinct().withColumn("similarity", containment(F.col("q"), F.col("label"))).where(F.col("similarity") >= least)


def validate_entities(entities: DataFrame, labels: DataFrame, matched: float = 0.95, partial: float = 0.70) -> DataFrame:
    """entities (text, kind) with status (matched, partial, novel), label and similarity; without a match of the class all classes are tried."""
    rows = entities.withColumn("q", normalize_label(F.col("text")))
    typed = find_matches(rows.select("q", "kind"), labels, 1, partial).withColumn("tier", F.lit(0))
    again = rows.where("kind IS NOT NULL").select("q", "kind").distinct().join(typed.select("q", "kind"), ["q", "kind"], "left_anti")
    untyped = find_matches(again.select("q", F.lit(None).cast("string").alias("kind")), labels, 1, partial)
    untyped = again.join(untyped.drop("kind"), "q").select("q", "kind", "uri", "label", "similarity", "rank", F.lit(1).alias("tier"))
    found = typed.unionByName(untyped).withColumn("kk", F.coalesce("kind", F.lit(""))).select("q", "kk", "label", "uri", "similarity")
    out = rows.withColumn("kk", F.coalesce("kind", F.lit(""))).join(found, ["q", "kk"], "left").drop("kk")
    status = F.when(F.col("similarity") >= matched, "matched").when(F.col("similarity") >= partial, "partial").otherwise("novel")
    return out.withColumn("status", status)


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.groupBy("kind").pivot("status", ["matched", "partial", "novel"]).agg(F.count(F.lit(1))).na.fill(0)


def search_entities(queries: DataFrame, labels: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """Free-text search over all classes: labels that hold the query first, then similar ones. No cap on how many are scanned."""
    q = queries.select(normalize_label(F.col("text")).alias("q"), F.lit(None).cast("string").alias("kind")).distinct()
    holds = holding(q.where("q <> ''"), labels)
    holds = holds.select("q", F.col("kind"), "label", "uri", (1 + containment(F.col("q"), F.col("label"))).alias("similarity"))
    near = find_matches(q, labels, k, least).select("q", "kind", "label", "uri", "similarity")
    return top_per_uri(holds.union(near), k).withColumn("similarity", F.when(F.col("similarity") > 1, F.col("similarity") - 1).otherwise(F.col("similarity")))


def holding(queries: DataFrame, labels: DataFrame, most: int = 3, *, most_queries: int = 1 << 20) -> DataFrame:
    """Pairs (q, kind, label, uri) of which the label holds the query, at any length.

    Up to ``most_queries`` queries are broadcast, each as its length and the hashes of the bytes at its two ends, and found at all places of a label inside its row.
    More of them meet the labels by the rarest of the query's stretches of ``most`` characters, or by the whole of a shorter query; rows of that join hold
    digests and never a text. In both ways the texts are compared afterwards.
    """
    asked = queries.select("q").where("q <> ''").distinct()
    if asked.count() <= most_queries:
        near = labels.where("label <> ''").select("label", "uri", F.explode(finder(asked, "q")(F.col("label"))).alias("id"))
        found = near.join(queries.where("q <> ''").select(F.xxhash64("q").alias("id"), "q", "kind").distinct(), "id").where(F.contains("label", F.col("q")))
        return found.select("q", "kind", "label", "uri").distinct()

    def stretches(c: Column, n: Column) -> Column:
        chars = F.split(c, "")
        return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), "")))).otherwise(F.array().cast("array<string>"))

    grams = asked.select(F.md5("q").alias("__q"), F.explode(stretches(F.col("q"), F.least(F.length("q"), F.lit(most)))).alias("gram"))
    held = labels.select("label").distinct()
    index = held.select(F.md5("label").alias("__l"), F.explode(F.concat(*[stretches(F.col("label"), F.lit(n)) for n in range(1, most + 1)])).alias("gram"))
    counts = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a stretch that no label has is the rarest, and the query meets nothing
    rarest = grams.join(counts, "gram", "left").groupBy("__q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("__q", "g.gram")
    pairs = rarest.join(index, "gram").select("__q", "__l")
    pairs = pairs.join(queries.select(F.md5("q").alias("__q"), "q", "kind").distinct(), "__q").join(labels.select(F.md5("label").alias("__l"), "label", "uri").distinct(), "__l")
    return pairs.where(F.contains("label", F.col("q"))).select("q", "kind", "label", "uri")


def find_relations(relations: DataFrame, labels: DataFrame, triples: DataFrame, least: float = 0.95) -> DataFrame:
    """relations (source, predicate, target) with the resolved nodes, whether the triple exists, and how many objects the source has for the predicate."""

    def resolve(column: str, name: str) -> DataFrame:
        q = relations.select(normalize_label(F.col(column)).alias("q"), F.lit(None).cast("string").alias("kind"))
        return find_matches(q, labels, 1, least).select(F.col("q").alias(f"{name}_q"), F.col("uri").alias(name))

    rows = relations.withColumn("s_q", normalize_label(F.col("source"))).withColumn("o_q", normalize_label(F.col("target")))
    rows = rows.join(resolve("source", "s"), "s_q", "left").join(resolve("target", "o"), "o_q", "left")
    facts = triples.select("s", F.col("p").alias("predicate"), "o").distinct()
    counts = facts.groupBy("s", "predicate").agg(F.count("*").alias("objects"))
    rows = rows.join(counts, ["s", "predicate"], "left").join(facts.withColumn("found", F.lit(True)), ["s", "predicate", "o"], "left")
    return rows.select("source", "predicate", "target", "s", "o", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("objects", F.lit(0)).alias("objects"))
