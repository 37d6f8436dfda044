"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become whole numbers, floor(256 * x). Candidates are dealt into blocks by a hash of their id; each is sent once. A task sorts every
dimension of a block of candidates once; the queries, which follow the block's candidates in the task's input, then stream past it. For a query it reads all lists from
their best end (largest first where the query's component is positive, smallest first where it is negative) in growing
steps, scores what it meets, and stops when the score that an unseen vector could have at most is below the k-th best.
A task returns k rows for each query and block at most, which a window ranks.

On many dense dimensions the bound seldom stops a query early (on 64 of them nearly all rows are scored), so the work is that of all queries against all rows.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows without vec_id, take no part; every row of an
id that occurs more than once is a candidate, and a query id that does is asked with each of its vectors, whose results are ranked
together; shorter vectors are filled up with zeros; ties go to
the smaller vec_id; a table of one vector, or none, gives no rows. Scores are 64-bit; vectors whose scores might exceed that raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import matrix, usable_vectors


class SortedLists:
    """A block of vectors with the order of its rows along every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")  # ascending

    def top(self, query: np.ndarray, k: int, own: int | None = None, step: int = 32) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), without the row of id ``own``; and how many rows were scored."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        q = query[dims]
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(n, bool)
        if own is not None:
            seen[self.ids == own] = True
        skipped = int(seen.sum())
        depth = 0
        while depth < n:
            upto = min(n, depth + step)
            if len(dims):
                ranks = np.arange(depth, upto)[:, None]
                met = self.order[np.where(q > 0, n - 1 - ranks, ranks), dims]
                fresh = np.unique(met)
                fresh = fresh[~seen[fresh]]
            else:  # every score is zero
                upto, fresh = n, np.flatnonzero(~seen)
            if len(fresh):
                seen[fresh] = True
                best_s = np.concatenate([best_s, self.vectors[fresh] @ query])
                best_i = np.concatenate([best_i, self.ids[fresh]])
                keep = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[keep], best_i[keep]
            depth, step = upto, step * 2
            if len(best_s) == k and len(dims):
                bound = int((q * self.vectors[met[-1], dims]).sum())
                if bound < best_s[-1]:  # at equality an unseen vector may tie with a smaller id
                    break
        return list(zip(best_s.tolist(), best_i.tolist(), strict=True)), int(seen.sum()) - skipped


def within_64_bits(a: np.ndarray, b: np.ndarray) -> None:
    """Raise unless no inner product of rows of a and b can leave 64 bits."""
    if a.size and b.size and float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] >= 2.0**63:
        raise OverflowError("vectors are too large for 64-bit scores")


def search(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: int = 256, block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each query (ids divisible by ``every``) among all other vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")).where(F.col("vec_id").isNotNull() & usable_vectors(F.col("embedding")))
    sizes = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks, width = max(1, -(-sizes[0] // block)), int(sizes[1])
    held = rows.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("c"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), F.lit(1).alias("asks"), "vec_id", "v")

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, its candidates before the queries."""
        at, lists = None, None
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        for batch in it:
            c, asks, own = (batch.column(i).to_numpy() for i in range(3))
            x = matrix(batch.column(3), "int64", width)
            edges = np.flatnonzero((np.diff(c) != 0) | (np.diff(asks) != 0)) + 1
            out: list[tuple[int, int, int]] = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(c)], strict=True):
                if c[lo] != at:
                    at, lists, ids, held = c[lo], None, [], []
                if not asks[lo]:
                    ids.append(own[lo:hi])
                    held.append(x[lo:hi])
                elif held:
                    if lists is None:
                        lists = SortedLists(np.concatenate(ids), np.concatenate(held))
                    within_64_bits(lists.vectors, x[lo:hi])
                    for q, query in zip(own[lo:hi].tolist(), x[lo:hi], strict=True):
                        out += [(q, i, s) for s, i in lists.top(query, k, q)[0]]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in columns], names=["query_id", "vec_id", "score"])

    met = held.union(asked).repartition(blocks, "c").sortWithinPartitions("c", "asks").mapInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
