"""The matching-block ratio of many pairs of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: In a second text of this length or more, characters that make up over a hundredth of it (and one) start no block.
LONG, SHARE = 200, 100


def _matrix(texts: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row for each text, and the lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), max(1, int(sizes.max(initial=0)))), filler, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.repeat(np.arange(len(texts)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def _popular(b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of characters that start no block."""
    out = np.zeros(b.shape, bool)
    for row in np.flatnonzero(sizes >= LONG):
        _, of, n = np.unique(b[row, : sizes[row]], return_inverse=True, return_counts=True)
        out[row, : sizes[row]] = n[of] > sizes[row] // SHARE + 1
    return out


def matching(a_texts: list[str], b_texts: list[str]) -> np.ndarray:
    """How many characters of each pair lie in matching blocks: the longest common stretch (ties: first in a, then in b), and so on to both sides of it.

    All open stretches of all pairs take a step together: one pass over the longer side finds each one's block.
    """
    total = np.zeros(len(a_texts), np.int64)
    if not a_texts:
        return total
    a, a_size = _matrix(a_texts, -1)
    b, b_size = _matrix(b_texts, -2)
    popular = _popular(b, b_size)
    pair, zero = np.arange(len(a_texts)), np.zeros(len(a_texts), np.int64)
    stretches = np.stack([pair, zero, a_size, zero, b_size])
    columns = np.arange(b.shape[1])
    while True:
        pair, a_low, a_high, b_low, b_high = stretches = stretches[:, (stretches[2] > stretches[1]) & (stretches[4] > stretches[3])]
        if not len(pair):
            return total
        text = b[pair]
        usable = (columns >= b_low[:, None]) & (columns < b_high[:, None]) & ~popular[pair]
        run = np.zeros((len(pair), b.shape[1] + 1), np.int32)
        size, i, j = np.zeros(len(pair), np.int64), a_low.copy(), b_low.copy()
        rows = np.arange(len(pair))
        for at in range(int(a_low.min()), int(a_high.max())):
            inside = (at >= a_low) & (at < a_high)
            same = usable & inside[:, None] & (text == a[pair, min(at, a.shape[1] - 1)][:, None])
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            best = run.argmax(1)
            longer = run[rows, best] > size
            size[longer] = run[rows, best][longer]
            i[longer], j[longer] = at + 1 - size[longer], best[longer] - size[longer]
        # characters that start no block may still lengthen one
        while True:
            more = (i > a_low) & (j > b_low)
            more[more] = a[pair[more], i[more] - 1] == b[pair[more], j[more] - 1]
            if not more.any():
                break
            i, j, size = i - more, j - more, size + more
        while True:
            more = (i + size < a_high) & (j + size < b_high)
            more[more] = a[pair[more], (i + size)[more]] == b[pair[more], (j + size)[more]]
            if not more.any():
                break
            size = size + more
        np.add.at(total, pair, size)
        found = size > 0
        left = np.stack([pair, a_low, i, b_low, j])[:, found]
        right = np.stack([pair, i + size, a_high, j + size, b_high])[:, found]
        stretches = np.concatenate([left, right], axis=1)


@F.arrow_udf(DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the matching characters over both lengths; null where a text is. It isn't symmetric, so the order matters."""
    known = np.array([x is not None and y is not None for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], bool)
    first, second = ([x for x, k in zip(t.to_pylist(), known, strict=True) if k] for t in (a, b))
    out = np.ones(len(known))
    lengths = np.array([len(x) + len(y) for x, y in zip(first, second, strict=True)], np.float64)
    found = np.empty(len(first), np.int64)
    # pairs of like lengths are padded alike; a step holds a few million places
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        widest = len(first[order[start]]) + len(second[order[start]])
        while stop < len(order) and (stop - start + 1) * max(widest, int(lengths[order[stop]])) <= 1 << 18:
            widest = max(widest, int(lengths[order[stop]]))
            stop += 1
        some = order[start:stop]
        found[some] = matching([first[k] for k in some], [second[k] for k in some])
        start = stop
    out[known] = np.where(lengths > 0, 2.0 * found / np.maximum(lengths, 1), 1.0)
    return pa.array(out, pa.float64(), mask=~known)


def signature(text: Column, buckets: int = 16) -> Column:
    """How many characters of the text fall into each of so many buckets of code points."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) % buckets)
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.size(F.filter(codes, lambda c: c == k)))


def shared_at_most(a: Column, b: Column, buckets: int = 16) -> Column:
    """Characters that two texts can have in common, from their signatures. No fewer than their matching blocks hold."""
    return sum((F.least(a[k], b[k]) for k in range(1, buckets)), F.least(a[0], b[0]))
