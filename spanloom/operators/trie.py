"""A dictionary of token sequences as a trie of token codes, walked from all places of a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_SLICE = 1 << 18  # tokens of texts that are walked together


class TokenTrie:
    """Each level's edges are one sorted array of (node, token) numbers, so a step of all open places is one binary search."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        """hashes: the entries' token hashes, one entry after the other; sizes: how many belong to each."""
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        self.width = len(self.vocabulary) + 1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.cumsum(sizes) - sizes
        open_, node = np.flatnonzero(sizes > 0), np.zeros(len(sizes), np.int64)
        depth = 0
        while len(open_):
            steps = node[open_] * self.width + codes[starts[open_] + depth]
            edges, node_of = np.unique(steps, return_inverse=True)
            node[open_] = node_of
            depth += 1
            ends = np.zeros(len(edges), bool)
            ends[node_of[sizes[open_] == depth]] = True
            self.levels.append((edges, ends))
            open_ = open_[sizes[open_] > depth]

    def hits(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, start, end of every stretch of a text that is an entry, by row and start. Texts come as the entries do."""
        stops = np.repeat(np.cumsum(sizes), sizes)
        codes = np.full(len(hashes), -1)
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            codes = np.where(self.vocabulary[at] == hashes, at, -1)
        place, node = np.flatnonzero(codes >= 0), np.zeros(len(hashes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for depth, (edges, ends) in enumerate(self.levels):
            place = place[place + depth < stops[place]]
            place = place[codes[place + depth] >= 0]
            step = node[place] * self.width + codes[place + depth]
            to = np.minimum(np.searchsorted(edges, step), len(edges) - 1)
            there = edges[to] == step
            place, to = place[there], to[there]
            node[place] = to
            found.append((place[ends[to]], np.full(int(ends[to].sum()), depth + 1)))
        first, n = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        order = np.lexsort((n, first))
        first, n = first[order], n[order]
        row = np.repeat(np.arange(len(sizes)), sizes)[first] if len(first) else first
        start = first - (np.cumsum(sizes) - sizes)[row] if len(first) else first
        return row, start, start + n


def in_slices(trie: TokenTrie, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hits``, some texts at a time: what is held beside the texts and their hits grows with the longest of them, not with a batch."""
    stops, low = np.cumsum(sizes), 0
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    while low < len(sizes):
        begin = int(stops[low] - sizes[low])
        high = max(low + 1, int(np.searchsorted(stops, begin + _SLICE, side="right")))
        row, s, e = trie.hits(hashes[begin : stops[high - 1]].astype(np.int64), sizes[low:high])
        parts.append((row + low, s.astype(np.int32), e.astype(np.int32)))
        low = high
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def matcher(entries: DataFrame, tokens: str):
    """A function of a column of token hashes: array<struct<s, e>> of the stretches that are entries (column ``tokens``: hashes of each).

    The entries pass through the driver, so callers check their size first.
    """
    held = entries.select(tokens).toArrow()[tokens].combine_chunks()
    if isinstance(held, pa.ChunkedArray):
        held = pa.concat_arrays(held.chunks) if held.num_chunks else pa.array([], pa.list_(pa.int64()))
    trie = TokenTrie(held.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(held.offsets.to_numpy()).astype(np.int64))
    sent = entries.sparkSession.sparkContext.broadcast(trie)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    @F.arrow_udf("array<struct<s:int,e:int>>")
    def stretches(hashes: pa.Array) -> pa.Array:
        hashes = hashes.fill_null([]) if hashes.null_count else hashes
        sizes = np.diff(hashes.offsets.to_numpy()).astype(np.int64)
        row, s, e = in_slices(sent.value, hashes.flatten().to_numpy(zero_copy_only=False), sizes)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["s", "e"])
        return pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(kind)

    return stretches


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))
