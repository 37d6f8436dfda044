"""Exact prefix filters: texts as sets of tokens, rare ones first, of which near sets must share one of the first few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequencies(texts: DataFrame, tokens: Column) -> DataFrame:
    """token, f: in how many texts each token is. Tokens of a text are distinct."""
    return texts.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("f"))


def rare_first(texts: DataFrame, column: str, tokens: Column, frequency: DataFrame) -> DataFrame:
    """column, tokens: each text's tokens in one global order, the rarest first, ties by token. Unknown tokens are the rarest."""
    parts = texts.select(column, F.explode(tokens).alias("token")).join(frequency, "token", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "token")))
    return parts.groupBy(column).agg(F.transform(order, lambda x: x["token"]).alias("tokens"))


def prefix(tokens: Column, shared: Column) -> Column:
    """So many of the first tokens that a text which shares at least ``shared`` tokens shares one of these, where the other keeps as many."""
    n = F.size(tokens)
    return F.slice(tokens, F.lit(1), F.least(n, n - F.ceil(shared - 1e-9).cast("int") + 1))


def meet_once(a: DataFrame, a_prefix: str, b: DataFrame, b_prefix: str) -> DataFrame:
    """Pairs of rows whose prefixes share a token, each at the first one that they share, which ``token`` is."""
    left, right = a.withColumn("token", F.explode(a_prefix)), b.withColumn("token", F.explode(b_prefix))
    return left.join(right, "token").where(F.array_intersect(a_prefix, b_prefix)[0] == F.col("token"))
