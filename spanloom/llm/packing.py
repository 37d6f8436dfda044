"""Packing token sequences by exact-complement hashing, then best fit.

Documents are tokenised once and cut into pieces of at most ``length`` tokens. Only the number of pieces of each length
reaches the driver (at most ``length * salts`` counts). There, sums of one, two and three lengths are looked up as the exact
complement of a gap and consumed as long as pieces last; what is left is packed by best fit, longest first. The plan is a
table of runs: pieces of one length, from rank a to b, go to sequences from s on, at one offset. Each piece finds its run by
its rank among the pieces of its length; ranks come from counts by (length, salt), so that a length that a third of all
pieces share is ranked in ``salts`` parts.

Defined results: a null text is empty and packs as its end id alone; empty texts likewise; repeated rows and null ids are
pieces of their own; an empty table gives no rows. Any string is tokenised whole, whatever its length.
"""

from __future__ import annotations

import re
import struct
import sys
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

Plan = list[tuple[tuple[int, ...], int]]


def _letters() -> tuple[str, str]:
    """Latin letters below U+0250 that lower-case to letters below U+0250, as the insides of character classes: as they are in lower case, and all of them."""
    found = [c for c in map(chr, range(0xA1, 0x250)) if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 and c.lower() < "\u0250"]
    return "a-z" + "".join(sorted({c.lower() for c in found})), "".join(found)


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, the same as the library's own.

    The tokenizer splits at white space and between letters, digits and signs before it merges, so a word's ids do not
    depend on its neighbours and are remembered. A memory of ``most`` words is full; then a new one starts, into which
    words move from the last one as they are met again. That holds for Latin letters; any other text goes to the library as a whole.
    """

    LETTER, _LATIN = _letters()
    WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s0-9{LETTER}]+")
    #: Anything but printable ASCII, tab, newline, return, Latin letters and signs, or what may begin a special token.
    OTHER = re.compile(f"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf\xd7\xf7{_LATIN}]|<\\|")

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = WordIds(self.tokenizer.model.tokenize, most)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.memo.__getitem__
        return [self.whole(t) if self.OTHER.search(t) else b"".join(map(get, self.WORDS.findall(t.lower()))) for t in texts]


class WordIds(dict):
    """The ids of words, as bytes: the latest ``most`` that were met, and those before."""

    def __init__(self, merge, most: int):
        super().__init__()
        # the letters that stand for bytes beyond ASCII
        self.merge, self.most, self.last, self.letters = merge, most, {}, {i: x for i, x in bytes_to_letters().items() if i > 127}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.last = dict(self)
            self.clear()
        known = self.last.get(word)
        if known is None:
            ids = [t.id for t in self.merge(word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters))]
            known = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = known
        return known


def bytes_to_letters() -> dict[int, str]:
    """Which letter stands for each byte in byte-level vocabularies: printable Latin-1 signs for themselves, the others from U+0100 on in order."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [i for i in range(256) if i not in itself]
    return {i: chr(i) for i in itself} | {i: chr(256 + k) for k, i in enumerate(others)}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker, with the words that it remembers."""
    state = sys.modules.setdefault("_spanloom_worker", ModuleType("_spanloom_worker")).__dict__
    if path not in state:
        state[path] = WordTokenizer(path)
    return state[path]


def pieces(docs: DataFrame, path: str, *, length: int = 4096, end_id: int = 1, salts: int = 32, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt (and ids binary) of every piece of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int" + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * with_ids

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        end = np.array([end_id], "<u4").tobytes()
        fields = pa.schema(list(zip([x.split()[0] for x in schema.split(", ")], kinds, strict=True)))
        made = 0
        for batch in it:
            names = batch.schema.names
            ids, texts = batch.column(names.index("doc_id")), batch.column(names.index("text"))
            for first in range(0, batch.num_rows, 64):
                some = [t or "" for t in texts.slice(first, 64).to_pylist()]
                rows: list[tuple] = []
                for doc_id, data in zip(ids.slice(first, 64).to_pylist(), tokenizer.encode(some), strict=True):
                    data += end
                    for k, i in enumerate(range(0, len(data), 4 * length)):
                        part = data[i : i + 4 * length]
                        # salts in turn, so that repeated rows don't share one
                        rows.append((doc_id, k, i // 4, len(part) // 4, zlib.crc32(part), made % salts, *[part] * with_ids))
                        made += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=fields)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def exact_complements(have: np.ndarray, length: int, parts: int) -> Plan:
    """Sequences that are filled to the last token: one length, or one with up to ``parts`` others that are its exact complement. ``have`` is consumed."""
    plan: Plan = []
    if have[length]:
        plan.append(((length,), int(have[length])))
        have[length] = 0

    def consume(*sizes: int) -> None:
        need = defaultdict(int)
        for s in sizes:
            need[s] += 1
        n = min(int(have[s]) // k for s, k in need.items())
        if n > 0:
            for s, k in need.items():
                have[s] -= n * k
            plan.append((sizes, n))

    def fill(fixed: tuple[int, ...], gap: int) -> None:
        """Exact pairs for the gap, larger part first, while all of ``fixed`` last."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for x in a[(have[a] > 0) & (have[gap - a] > 0)].tolist():
            if any(have[s] <= 0 for s in fixed):
                return
            consume(*fixed, x, gap - x)

    for big in range(length - 1, 0, -1) if parts >= 1 else ():
        if have[big] and have[length - big]:
            consume(big, length - big)
    for big in range(length - 2, 0, -1) if parts >= 2 else ():
        if have[big]:
            fill((big,), length - big)
    if parts >= 3:
        # which sums two lengths have; lengths only run out, so the index never misses a pair
        there = np.fft.rfft(have > 0, 2 * length + 2)
        pair_sums = np.fft.irfft(there * there, 2 * length + 2) > 0.5
        for big in range(length - 3, 0, -1):
            gap = length - big
            if have[big]:
                second = np.arange(1, gap - 1)
                for s in second[(have[second] > 0) & pair_sums[gap - second]][::-1].tolist():
                    if not have[big]:
                        break
                    if have[s]:
                        fill((big, s), gap - s)
    return plan


def best_fit(have: np.ndarray, length: int) -> Plan:
    """Longest first, each into the smallest gap that takes it; sequences with equal gaps are handled together. ``have`` is consumed."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    open_gaps = np.zeros(length + 1, np.int64)
    for size in range(length, 0, -1):
        while n := int(have[size]):
            at = np.flatnonzero(open_gaps[size:])
            if len(at):
                gap = int(at[0]) + size
                pattern, m = gaps[gap].pop()
                k = min(n, m)
                if m > k:
                    gaps[gap].append((pattern, m - k))
                open_gaps[gap] -= k
            else:
                gap, pattern, k = length, (), -(-n // (length // size))
            have[size] -= k
            gaps[gap - size].append(((*pattern, size), k))
            open_gaps[gap - size] += k
    return [x for stack in gaps.values() for x in stack]


def plan_bins(counts: np.ndarray, length: int) -> Plan:
    """Patterns of piece lengths with how many sequences have each. counts[n]: pieces of n tokens; ``counts`` isn't changed.

    Complements of up to three lengths are consumed before best fit. Where that spends the short pieces too early, stopping
    at fewer lengths leaves less; the plan with the fewest sequences is taken.
    """
    best: Plan | None = None
    for parts in (3, 2, 1, 0):
        have = counts.astype(np.int64).copy()
        plan = exact_complements(have, length, parts) + best_fit(have, length)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
    return best


def runs_of(plan: Plan) -> dict[str, np.ndarray]:
    """The plan as runs: of pieces of ``length``, those from rank ``lo`` on (``n`` of them) go to sequences from ``seq`` on, at ``offset``. Sorted by (length, lo)."""
    rank: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for sizes, n in plan:
        offset = 0
        for size in sizes:
            rows.append((size, rank[size], first, offset))
            rank[size] += n
            offset += size
        first += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "lo": a[:, 1], "seq": a[:, 2], "offset": a[:, 3]}


def pack(cut: DataFrame, *, length: int = 4096) -> DataFrame:
    """Rows of :func:`pieces` with sequence_id and offset."""
    spark = cut.sparkSession
    cut = materialise(cut)
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # at most length * salts rows
    have = np.zeros(length + 1, np.int64)
    base: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["salt"])):
        base[r["length"], r["salt"]] = int(have[r["length"]])
        have[r["length"]] += r["n"]
    runs = runs_of(plan_bins(have, length))
    shared = spark.sparkContext.broadcast((runs, base))  # bounded by length * salts
    others = [c for c in cut.columns if c != "salt"]
    schema = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in others) + ", sequence_id long, offset long"

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, base = shared.value
        key = runs["length"] << 40 | runs["lo"]
        for batch in it:
            names = batch.schema.names
            size = batch.column(names.index("length")).to_numpy()
            salt = batch.column(names.index("salt")).to_numpy()
            rank = batch.column(names.index("__rank")).to_numpy() + np.fromiter((base[k] for k in zip(size.tolist(), salt.tolist(), strict=True)), np.int64, len(size))
            at = np.searchsorted(key, size.astype(np.int64) << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in others], pa.array(runs["seq"][at] + rank - runs["lo"][at]), pa.array(runs["offset"][at])], names=[*others, "sequence_id", "offset"])

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return cut.withColumn("__rank", (F.row_number().over(within) - 1).cast("long")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, *, length: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, path, length=length, end_id=end_id, with_ids=with_ids), length=length)
