"""Exact nearest neighbours through cells: a ball around each cell bounds what a query can find in it, so far cells are not compared."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch


def _rows(lists: pa.Array) -> np.ndarray:
    return np.array(lists.to_pylist(), float)


class Cells:
    """Centres, radii and sizes of the cells of a pool, and where the pool lies with its cell. At most ``most`` cells, whatever the pool's size."""

    def __init__(self, pool: DataFrame, *, most: int = 2048, block: int = 8192):
        """pool: pid, pos, v. The centres are the vectors of the smallest hashes of pid, about the root of the pool's size."""
        spark = pool.sparkSession
        rows = pool.select("pid", F.col("pos").cast("long").alias("pos"), F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull())
        wanted = min(most, math.isqrt(rows.count()) + 1)
        first = rows.select(F.xxhash64("pid").alias("h"), "pos", "v").orderBy("h", "pos").limit(wanted).select("v").toArrow()["v"].combine_chunks()
        self.centres = centres = _rows(first) if len(first) else np.zeros((0, 0))
        self.block = block
        norms = (centres**2).sum(1) if len(centres) else np.zeros(0)

        def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if not batch.num_rows:
                    continue
                x = _rows(batch.column(2))
                near = (norms - 2 * x @ centres.T).argmin(1)
                far = np.linalg.norm(x - centres[near], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

        path = scratch(spark)
        rows.mapInArrow(assign, f"pid {rows.schema['pid'].dataType.simpleString()}, pos long, v array<double>, cell int, far double").write.parquet(path)
        self.pool = spark.read.parquet(path)
        self.radius, self.size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for cell, radius, n in self.pool.groupBy("cell").agg(F.max("far"), F.count("*")).collect():  # at most ``most`` rows
            self.radius[cell], self.size[cell] = radius, n


def visits(queries: DataFrame, cells: Cells, k: int, known: DataFrame | None = None) -> DataFrame:
    """qid, v, cell, part: the cells that each query has to see.

    Without ``known`` (qid, least): the cells of the largest bounds, until they hold k vectors. With it: all others whose bound reaches ``least``, the
    similarity of the k-th of what was found in those.
    """
    centres, radius, size, block, more = cells.centres, cells.radius, cells.size, cells.block, known is not None
    rows = queries.select("qid", F.col("v").cast("array<double>").alias("v"))
    rows = rows.withColumn("least", F.lit(None).cast("double")) if known is None else rows.join(known, "qid", "left").withColumn("least", F.coalesce("least", F.lit(-float("inf"))))

    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows or not len(centres):
                continue
            x = _rows(batch.column(1))
            at = x @ centres.T
            bound = at + np.linalg.norm(x, axis=1, keepdims=True) * radius
            bound += 1e-9 * (1 + np.abs(bound))  # sums are rounded
            order = np.argsort(-np.where(size > 0, at, -np.inf), axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            least = batch.column(2).to_numpy(zero_copy_only=False)
            seen = ~first & (bound >= least[:, None]) if more else first
            q, c = np.nonzero(seen & (size > 0))
            parts = -(-size[c] // block)
            again = np.repeat(np.arange(len(q)), parts)
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q[again])), batch.column(1).take(pa.array(q[again])), pa.array(c[again], pa.int32()), pa.array(part, pa.int32())], names=["qid", "v", "cell", "part"])

    return rows.mapInArrow(choose, f"qid {rows.schema['qid'].dataType.simpleString()}, v array<double>, cell int, part int")


def compare(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """qid, pid, pos, similarity: the k best of each block that a query sees."""
    sizes = F.create_map(*[F.lit(x) for c in range(len(cells.size)) if cells.size[c] > cells.block for x in (c, int(-(-cells.size[c] // cells.block)))] or [F.lit(-1), F.lit(1)])
    parts = F.coalesce(F.try_element_at(sizes, F.col("cell")), F.lit(1))
    held = cells.pool.withColumn("part", F.pmod(F.xxhash64("pid", "pos"), parts).cast("int")).select("pid", "pos", "v", "cell", "part")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": a["qid"].slice(0, 0), "pid": b["pid"].slice(0, 0), "pos": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        b = b.sort_by("pos")
        s = _rows(a["v"]) @ _rows(b["v"]).T
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(s)), top.shape[1])
        flat = pa.array(top.reshape(-1))
        return pa.table({"qid": a["qid"].take(pa.array(rows)), "pid": b["pid"].take(flat), "pos": b["pos"].take(flat), "similarity": pa.array(s[rows, top.reshape(-1)])})

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "qid"), (held, "pid"))}
    # a cell that many queries see is dealt over blocks of queries too
    deal = F.pmod(F.xxhash64("qid"), F.lit(16)).cast("int")
    held = held.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return asked.withColumn("deal", deal).groupBy("cell", "part", "deal").cogroup(held.groupBy("cell", "part", "deal")).applyInArrow(meet, f"qid {kinds['qid']}, pid {kinds['pid']}, pos long, similarity double")


def nearest_in_cells(queries: DataFrame, pool: DataFrame, k: int, *, most: int = 2048, block: int = 8192) -> DataFrame:
    """qid, pid, similarity, rank: the k pool vectors with the largest dot product, exactly; ties in pool order (pos).

    Each query first sees the cells of its nearest centres that hold k vectors, whose k-th similarity bounds the answer from below; then every cell
    whose ball can hold a vector that reaches it: q.x is at most q.c + |q| radius. Cells are compared as blocks of vectors and of queries.
    """
    cells = Cells(pool, most=most, block=block)
    path = scratch(pool.sparkSession)
    compare(visits(queries, cells, k), cells, k).write.parquet(path)
    found = pool.sparkSession.read.parquet(path)
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "pos")
    known = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("qid", F.col("similarity").alias("least"))
    rest = compare(visits(queries, cells, k, known), cells, k)
    return found.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "pid", "similarity", "rank")
