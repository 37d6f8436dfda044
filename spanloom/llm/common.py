"""What the operators of this subpackage share: tables in the shared folder, literal tables, sums of sketches."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the data contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set, as in tests, local mode gets one of its own; on a cluster that raises ValueError, since executors don't see the driver's folders.
    """
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that executors share")
        at = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialise(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs start from the written rows, so a lost executor costs the tasks that it ran and nothing before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spanloom-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that :func:`materialise` wrote. Frames that were built on them can't be read afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended  # noqa: BLE001
            continue


atexit.register(release)


def small_batches(df: DataFrame, most: int = 500) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``most`` rows, so that a batch of long texts fits a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name, "10000")) > most:
        df.sparkSession.conf.set(name, str(most))
    return df


def literal_table(spark: SparkSession, rows: Iterable[dict], schema: str) -> DataFrame:
    """A small table from plain values, made inside the JVM (no Python rows on the executors)."""
    body = F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(body))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` is ``fold``; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def add_blocks(parts: DataFrame, kind: str = "f8", packed: bool = False, add: np.ufunc = np.add, fan: int = 64) -> DataFrame:
    """Sum arrays: rows (block int, data binary) of many tasks become one row for each block.

    ``data`` is the raw array of numbers of this kind, compressed on its way if ``packed``. Each block has a fixed size. Blocks are summed in two steps,
    first what ``fan`` groups of tasks sent, so that what meets in a task grows by a fan-th of the number of tasks.
    """

    def total(it: Iterator[pa.RecordBatch], packed_out: bool) -> Iterator[pa.RecordBatch]:
        def row(block: int, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "data": pa.array([zlib.compress(x, 1) if packed_out else x.tobytes()], pa.binary())})

        # rows come sorted by block
        at, x = None, None
        for batch in it:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = np.frombuffer(zlib.decompress(data) if packed else data, kind)
                if block != at:
                    if at is not None:
                        yield row(at, x)
                    at, x = block, y.copy()
                else:
                    add(x, y, out=x)
        if at is not None:
            yield row(at, x)

    def some(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from total(it, packed)

    def all_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from total(it, False)

    schema = "block int, data binary"
    first = parts.withColumn("__part", F.spark_partition_id() % fan).repartition("block", "__part").sortWithinPartitions("block", "__part").select("block", "data").mapInArrow(some, schema)
    return first.repartition("block").sortWithinPartitions("block").mapInArrow(all_, schema)


def blocks_of(total: np.ndarray, length: int, packed: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`add_blocks` for one task's flat array; blocks of zeros are left out."""
    for i in range(0, len(total), length):
        part = total[i : i + length]
        if part.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i // length], pa.int32()), "data": pa.array([zlib.compress(part, 1) if packed else part.tobytes()], pa.binary())})


def collect_blocks(summed: DataFrame, size: int, length: int, kind: str = "f8") -> np.ndarray:
    """The flat array of ``size`` numbers; its size is a parameter of the model, not of the data."""
    out = np.zeros(size, kind)
    for row in summed.coalesce(8).toLocalIterator():
        i = row["block"] * length
        out[i : i + length] = np.frombuffer(row["data"], kind)
    return out


def usable_vectors(column: Column) -> Column:
    """Not null, no null and no non-finite component."""
    return F.coalesce(F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def matrix(lists: pa.ListArray, dtype: str = "float64", width: int | None = None) -> np.ndarray:
    """Rows of numbers as a matrix; shorter rows end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    width = int(n.max(initial=0)) if width is None else width
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), dtype)
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
        different = root[a] != root[b]
        a, b = a[different], b[different]
    return root


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node of ``pairs`` (a long, b long).

    Large-star and small-star in turn (Kiveris et al. 2014): every node hangs itself and its neighbours under the smallest
    of them until only stars are left, in a logarithmic number of rounds in practice. Pairs never leave the executors.
    """

    def marks(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    at = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = marks(at)
    while seen[0]:
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        at = materialise(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct())
        now = marks(at)
        if now == seen:
            break
        seen = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select("b", "b").distinct())
