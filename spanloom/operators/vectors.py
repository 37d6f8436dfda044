"""Unit vectors, nearest neighbours and the choice of demonstrations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Unit mean of the token vectors whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    total = F.aggregate(kept, F.transform(F.try_element_at(tokens, F.lit(1)), lambda _: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return unit(total)


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = vectors.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten()
    if flat.null_count or values.null_count or (sizes != sizes[0]).any():
        raise ValueError("vectors should have one length and no nulls")
    return values.to_numpy().astype(float).reshape(len(flat), -1)


def largest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, column, value of each row's k largest values, in order; ties by column. Only what reaches the k-th value is sorted."""
    key = np.where(np.isnan(s), -np.inf, s)
    k = min(k, s.shape[1])
    row, at = np.nonzero(key >= np.partition(key, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
    order = np.lexsort((at, -key[row, at], row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, at = row[kept], at[kept]
    return row, at, s[row, at]


def nearest(queries: DataFrame, pool: DataFrame, k: int, block: int = 8192, some: int = 128) -> DataFrame:
    """qid, pid, similarity, rank: the k pool vectors with the largest dot product; ties in pool order (pos).

    queries: qid, v; pool: pid, pos, v. Blocks of both sides meet by equality and are multiplied as matrices, ``some`` queries at a time, so a task
    holds two blocks and ``some`` rows of products. A block gives k rows for each query, so what is ranked grows with the queries and the number of
    blocks, not with all pairs.
    """
    n, m = max(1, -(-pool.count() // block)), max(1, -(-queries.count() // block))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select("qid", "v", F.pmod(F.xxhash64("qid"), F.lit(m)).cast("int").alias("i"), every(n).alias("j"))
    right = pool.select("pid", "pos", "v", F.pmod(F.xxhash64("pid"), F.lit(n)).cast("int").alias("j"), every(m).alias("i"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": pa.array([], a["qid"].type), "pid": pa.array([], b["pid"].type), "pos": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        b = b.sort_by("pos")
        x, y = matrix(a["v"]), matrix(b["v"])
        found = [largest(x[i : i + some] @ y.T, k) for i in range(0, len(x), some)]
        rows = np.concatenate([r + i * some for i, (r, _, _) in enumerate(found)])
        at, s = (np.concatenate([f[j] for f in found]) for j in (1, 2))
        return pa.table({"qid": a["qid"].take(pa.array(rows)), "pid": b["pid"].take(pa.array(at)), "pos": b["pos"].cast(pa.int64()).take(pa.array(at)), "similarity": pa.array(s)})

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (pool, "pid"))}
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"qid {kinds['qid']}, pid {kinds['pid']}, pos long, similarity double")
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "pos")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "pid", "similarity", "rank")


def mix_demonstrations(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid, pid, place: k // 2 of a's and the rest of b's ranked neighbours, interleaved by rank with b first, then reversed (nearest last)."""
    half = k // 2
    both = a.where(F.col("rank") <= half).select("qid", "pid", "rank", F.lit(1).alias("src")).union(b.where(F.col("rank") <= k - half).select("qid", "pid", "rank", F.lit(0)))
    w = Window.partitionBy("qid").orderBy(F.desc("rank"), F.desc("src"))
    return both.withColumn("place", F.row_number().over(w)).select("qid", "pid", "place")


def demonstration_pool(sentences: DataFrame, excluded: DataFrame, shortest: int = 8, longest: int = 40) -> DataFrame:
    """Sentences (sid, tokens, spans) that may serve as demonstrations."""
    return sentences.where((F.size("spans") > 0) & F.size("tokens").between(shortest, longest)).join(excluded.select("sid"), "sid", "left_anti")


def missing_embeddings(texts: DataFrame, cache: DataFrame, model: str, prefix: str = "") -> DataFrame:
    """key, text of distinct texts that the cache (key, v) doesn't hold. key: sha256 of model, NUL and prefixed text."""
    keyed = texts.select(F.concat(F.lit(prefix), F.col("text")).alias("text")).distinct().withColumn("key", F.sha2(F.concat(F.lit(model + "\u0000"), F.col("text")), 256))
    return keyed.join(cache.select("key"), "key", "left_anti").select("key", "text")
