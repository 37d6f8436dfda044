"""Vector code compression: each of ``parts`` equal parts of a vector becomes the index of its nearest codebook entry.

Components are integers, floor(scale * x), so that everything is exact. Each part position has a codebook of at most ``entries`` entries, which
starts with the parts of the smallest ids. In each of ``rounds`` rounds the codebooks are broadcast (parts * entries * width integers, whatever the
table's size); tasks compute all distances of an Arrow batch by norm expansion, |a|^2 - 2 a.c + |c|^2 with an int64 matrix product, take the
first minimum, and add up their parts by entry. One row for each task, part and entry is shuffled, and what comes back to the driver is the
next codebook. Codes and errors are computed by the last codebooks; a label's errors are added up with partial sums, and labels that hold over
a hundredth of the rows (99 at most) meet their rows in a broadcast join, the others in a shuffled one.

Defined results: vectors that are null or hold null or non-finite components are left out; vectors shorter than the longest one end in zeros,
also where the longest length is no multiple of ``parts``; an empty vector is all zeros; rows without an id sort last among ids, rows of one id
by their vectors; repeated rows are rows of their own; with fewer rows than ``entries`` the codebooks are smaller; equal entries go to the
lower index, entries without parts stay; rows with a null label are one label; an empty table gives no rows. Components so large that a
distance could leave 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, matrix, usable_vectors


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the first of the nearest entries of ``book``, and its squared distance."""
    norms = (book * book).sum(1)
    columns = np.ascontiguousarray(book.T)
    at, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), 1024):
        some = x[i : i + 1024]
        far = some @ columns
        far *= -2
        far += norms
        best = far.argmin(1)
        at[i : i + 1024] = best
        error[i : i + 1024] = far[np.arange(len(some)), best] + (some * some).sum(1)
    return at, error


def sums_by(at: np.ndarray, x: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the number of rows of ``x`` for each entry."""
    n = np.bincount(at, minlength=entries)
    total = np.zeros((entries, x.shape[1]), np.int64)
    used = np.flatnonzero(n)
    if len(used):
        total[used] = np.add.reduceat(x[np.argsort(at, kind="stable")], np.cumsum(n)[used] - n[used], axis=0)
    return total, n


class Codebooks:
    """Integer codebooks, one for each part position: ``books[part, entry, component]``."""

    def __init__(self, books: np.ndarray, scale: int):
        self.books, self.scale = books, scale

    @property
    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def whole_numbers(vectors: pa.Array, scale: int, length: int) -> np.ndarray:
    return np.floor(scale * matrix(vectors, width=length)).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("label").cast("string").alias("label")).where(F.col("v").isNotNull() & usable_vectors(F.col("v")))


def fit_codebooks(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of all usable vectors after ``rounds`` rounds; None where there are none."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    bounds = rows.agg(F.max(F.size("v")).alias("length"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if bounds["length"] is None:
        return None
    width = max(1, -(-bounds["length"] // parts))
    # each distance is at most width * (2 most)^2, an error parts times that
    if parts * width * 4 * (scale * (bounds["most"] or 0.0) + 1) ** 2 >= 2.0**63:
        raise ValueError("components are too large: squared distances would not fit in a 64-bit integer")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()["v"]
    books = np.ascontiguousarray(whole_numbers(first, scale, parts * width).reshape(-1, parts, width).transpose(1, 0, 2))

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def add(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = sent.value
            total, n = np.zeros_like(held), np.zeros(held.shape[:2], np.int64)
            for batch in it:
                x = whole_numbers(batch.column(0), scale, parts * width)
                for p in range(parts):
                    mine = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    more, many = sums_by(nearest(mine, held[p])[0], mine, held.shape[1])
                    total[p] += more
                    n[p] += many
            p, e = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]), "total": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

        summed = rows.select("v").mapInArrow(add, "part int, entry int, n long, total array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
        books = books.copy()
        for row in summed.collect():  # at most parts * entries rows
            books[row["part"], row["entry"]] = [t // row["n"] for t in row["total"]]
        sent.unpersist()
    return Codebooks(books, scale)


def encode(vectors: DataFrame, fitted: Codebooks) -> DataFrame:
    """vec_id, label (as text), code, error of every usable vector."""
    parts, _, width = fitted.books.shape
    scale = fitted.scale
    sent = vectors.sparkSession.sparkContext.broadcast(fitted.books)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in it:
            x = whole_numbers(batch.column(1), scale, parts * width)
            at = [nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), held[p]) for p in range(parts)]
            digits = max(2, math.ceil(math.log(held.shape[1], 16))) if held.shape[1] > 1 else 2
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*[a.tolist() for a, _ in at], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(sum(e for _, e in at), pa.int64())], names=["vec_id", "label", "code", "error"])

    return usable(vectors).mapInArrow(assign, "vec_id long, label string, code string, error long")


def decode(codes: DataFrame, fitted: Codebooks) -> DataFrame:
    """``codes`` with ``approximation``: the vector that each code stands for, in the scale of the original ones."""
    parts, entries, width = fitted.books.shape
    digits = max(2, math.ceil(math.log(entries, 16))) if entries > 1 else 2
    sent = codes.sparkSession.sparkContext.broadcast(fitted.books / fitted.scale)

    def back(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in it:
            text = batch.column(batch.schema.get_field_index("code")).to_pylist()
            at = np.array([[int(c[p * digits : (p + 1) * digits], 16) for p in range(parts)] for c in text], np.int64).reshape(-1, parts)
            x = np.concatenate([held[p][at[:, p]] for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*batch.schema.names, "approximation"])

    return codes.mapInArrow(back, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + ", approximation array<double>")


def compress(vectors: DataFrame, **params) -> DataFrame:
    """vec_id, code, error, label_error (errors of all rows of the label), codebooks_sha256."""
    spark = vectors.sparkSession
    fitted = fit_codebooks(vectors, **params)
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    key = F.coalesce(F.concat(F.lit("1"), "label"), F.lit("0"))
    rows = materialise(encode(vectors, fitted).select("vec_id", key.alias("key"), "code", "error"))
    labels = materialise(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    many = rows.count() // 100
    hot = labels.where(F.col("n") > many).select("key", "label_error")  # at most 99 labels hold more than a hundredth each
    rare = labels.where(F.col("n") <= many).select("key", "label_error")
    rest = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rare, "key")
    both = rows.join(F.broadcast(hot), "key").unionByName(rest)
    return both.select("vec_id", "code", "error", "label_error", F.lit(fitted.digest).alias("codebooks_sha256"))
