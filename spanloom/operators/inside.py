"""Which of many texts are held by others: windows of powers of two bytes, hashed at all places of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST = 64  # bytes
_SLICE = 1 << 20  # bytes of texts that are looked at together
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _TWO
    return h ^ (h >> np.uint64(29))


def window_hashes(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """size, hashes of the windows of so many bytes, from every place that has one: sizes of 1, 2, 4 .. ``WIDEST``."""
    h, size = _mix((codes.astype(np.uint64) + np.uint64(1)) * _ONE), 1
    while len(h):
        yield size, h
        if size == WIDEST:
            return
        h = _mix(h[:-size] * _ONE + h[size:]) if len(h) > size else h[:0]
        size *= 2


def _widest(n: int) -> int:
    return min(WIDEST, 1 << (n.bit_length() - 1))


def ends(text: str) -> tuple[int, int, int]:
    """Bytes of a text, and the hashes of the widest window at its start and at its end: of up to twice ``WIDEST`` bytes they cover it."""
    codes = np.frombuffer(text.encode(), np.uint8)
    n = len(codes)
    h = dict(window_hashes(codes))[_widest(n)]
    return n, int(h[0].astype(np.int64)), int(h[-1].astype(np.int64))


class Finder:
    """Texts by the window at their start; those of one size of window are looked up together."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.classes: dict[int, tuple] = {}
        wide = np.array([_widest(int(n)) for n in sizes], np.int64)
        for size in np.unique(wide):
            mine = np.flatnonzero(wide == size)
            mine = mine[np.argsort(first[mine].view(np.uint64), kind="stable")]
            starts, at, n = np.unique(first[mine].view(np.uint64), return_index=True, return_counts=True)
            bits = min(24, max(16, int(len(starts)).bit_length() + 4))
            seen = np.zeros(1 << bits, bool)
            seen[starts >> np.uint64(64 - bits)] = True
            self.classes[int(size)] = starts, at, n, np.uint64(64 - bits), seen, ids[mine], sizes[mine], last[mine].view(np.uint64)

    def hits(self, codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """row, id of the texts that may be held by each row, once each; rows lie one after the other and end at ``stops``."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, h in window_hashes(codes):
            if size not in self.classes:
                continue
            starts, at, n, shift, seen, ids, sizes, last = self.classes[size]
            place = np.flatnonzero(seen[h >> shift])
            group = np.minimum(np.searchsorted(starts, h[place]), len(starts) - 1)
            same = starts[group] == h[place]
            place, group = place[same], group[same]
            some = max(1, (1 << 20) // int(n.max()))
            for low in range(0, len(place), some):
                p, g = place[low : low + some], group[low : low + some]
                k = n[g]
                text = np.repeat(at[g], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                p = np.repeat(p, k)
                row = np.searchsorted(stops, p, side="right")
                end = p + sizes[text]
                whole = end <= stops[row]
                p, text, row, end = p[whole], text[whole], row[whole], end[whole]
                equal = h[end - size] == last[text]
                pair = np.unique(row[equal] * len(ids) + text[equal])
                rows.append(pair // len(ids))
                found.append(ids[pair % len(ids)])
        pairs = np.unique(np.column_stack([np.concatenate(rows), np.concatenate(found)]), axis=0)
        return pairs[:, 0], pairs[:, 1]


def asked(queries: DataFrame, column: str) -> DataFrame:
    """id (xxhash64), size, first, last of each text."""

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            of = np.array([ends(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(of[:, i]) for i in range(3))], names=["id", "size", "first", "last"])

    return queries.select(F.xxhash64(column).alias("id"), column).mapInArrow(describe, "id long, size long, first long, last long")


def finder(queries: DataFrame, column: str):
    """A function of a text column: array<long>, the ids (xxhash64) of the queries that the text may hold. A few words of each query pass through the driver, so callers check their number first."""
    held = asked(queries, column).toArrow()
    sent = queries.sparkSession.sparkContext.broadcast(Finder(*[held[c].to_numpy().astype(np.int64) for c in ("id", "size", "first", "last")]))

    @F.arrow_udf("array<long>")
    def ids(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        row, out, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _SLICE, side="right")) - 1)
            r, i = sent.value.hits(data[offsets[low] : offsets[high]], offsets[low + 1 : high + 1] - offsets[low])
            row.append(r + low)
            out.append(i)
            low = high
        ends_ = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(row), minlength=len(texts)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends_), pa.array(np.concatenate(out)))

    return ids
