"""Language-model scoring by online logistic context mixing.

A token is spelled in bits: its bytes and a space, or one newline byte for the end of a document. Five predictors give each
bit a probability from its context: the last two, three or four bytes of the word, all of the word so far, and all of it
together with the kind of token before (start of text, sign at its end, short, other). The first three are hashed tables of counts
of zeros and ones, summed over the whole training corpus, with slots in proportion to the root of the number of distinct tokens. The
last two count exactly, however many words there are: tokens are sorted by their spelling into groups, so that a prefix is a run of
neighbours, and the few prefixes that reach over a group's ends get what lies in other groups added. Their log odds are mixed by weights that are gated by the place in
the word, by how sure the four bytes before are, and by how often the predictor has seen its context and whether always with
the same bit. The weights are learned online, token after token, with a token's own occurrence taken out of the counts. An
adaptive map over (how sure the word so far is, mixed log odds) refines the result. The bits' log
probabilities add up to the token's, the tokens' to the text's; ``bits_per_byte`` is that per byte of text.

The spelling sees one word; the word before it is mixed in afterwards, along each text. Where that word w occurred c times in training, c2 times
with this token behind it, the token's probability is (c2 + s p) / (c + s), with p its spelled probability and s = a c^b. The text's start
stands before its first token. These are probabilities again: they add up to what p adds up to. a and b are the ones of CHOICES under
which training texts are likeliest when each pair's own occurrence is taken out.

The model is learned from documents that are not held out and then fixed, so scores do not depend on the order of rows.
A token's spelled probability depends only on its letters and the kind of the token before it. It is therefore computed once for each
distinct token of the corpus, and a bit that neighbouring tokens share, in their order by spelling, once for all of them: such bits are the
edges of the tokens' tree of prefixes, with the occurrences of all tokens behind them. Tasks cut their documents into blocks of some million
tokens, with each block's distinct tokens in order. These go to buckets, which are ranges of spellings, and counts and probabilities come back
in the same order. Pairs of tokens are counted exactly and alike: each block sends its distinct pairs as sorted hashes to buckets of the range of
hashes. A hot token or pair is one number for each block.

Defined results: a null text is empty, and an empty text is its end alone (bits_per_byte null); null ids are never held out; repeated
rows are counted and scored as often as they occur; without training documents c, N and V are 0 and every bit has probability
1/2; an empty table gives no rows. Pairs meet by a hash of 14 bits more than their number has.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_blocks, blocks_of, collect_blocks, held_out, materialise, small_batches

END = b"\n"
KINDS = 4
#: Bits of each hashed predictor's table in a small corpus.
TABLES = (18, 19, 19)
#: The hashed predictors and the two exact ones: the word so far, alone and with the kind before.
PREDICTORS = len(TABLES) + 2
STARTS = np.concatenate([[0], np.cumsum([1 << b for b in TABLES])]).astype(np.int64)
PLACES, LEVELS, STEPS = 4, 16, 33
#: Bounds of how often a context was seen; a level is that and whether all bits were equal.
SEEN = np.array([0.5, 1.5, 2.5, 5.5, 15.5, 100.5, 2000.5], np.float32)
#: The predictors of four bytes, which gates, and of the word so far, which refines.
GATE, WORD = 2, 3
#: (a, b) of the weight a c^b that the spelled probability has after a token seen c times.
CHOICES = tuple((a, b) for b in (0.5, 0.75, 1.0) for a in (0.25, 1.0, 4.0, 16.0))
_PUNCTUATION = frozenset(b".!?,;:")


class Codes(dict):
    """Numbers for tokens in order of appearance."""

    def __missing__(self, token: bytes) -> int:
        n = self[token] = len(self)
        return n


def kind_of(token: bytes) -> int:
    """What the next token sees of this one."""
    return 1 if token[-1] in _PUNCTUATION else 2 if len(token) <= 3 else 3


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spelling(token: bytes) -> bytes:
    return token if token == END else token + b" "


@dataclass
class Edges:
    """Every bit of some tokens that the token before doesn't share, token by token: its value, table slots (edges x hashed predictors), place, token and the end of the run of tokens behind it.

    inside: occurrences of these tokens (edges x kinds) behind the edge. own, other: occurrences of all tokens behind it, and behind the opposite bit.
    first, start: where a token's edges begin, and at which depth. above: the token on whose path this one's begins, and how many such steps lie above.
    """

    y: np.ndarray
    slots: np.ndarray
    place: np.ndarray
    token: np.ndarray
    end: np.ndarray
    inside: np.ndarray
    own: np.ndarray
    other: np.ndarray
    first: np.ndarray
    start: np.ndarray
    above: np.ndarray
    level: np.ndarray

    def along_paths(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (edges x ..) over all bits of each token."""
        total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
        before = np.zeros((len(self.first), *values.shape[1:]))  # what lies above a token's own edges
        for k in range(1, int(self.level.max(initial=0)) + 1):
            i = np.flatnonzero(self.level == k)
            j = self.above[i]
            before[i] = before[j] + total[self.first[j] + self.start[i] - self.start[j]] - total[self.first[j]]
        return before + total[np.append(self.first[1:], len(values))] - total[self.first]


def slots_of(raw: list[bytes], byte: np.ndarray, bit: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of bits (of this byte of all spellings' bytes), and their slots in the tables. ``more``: bits beyond TABLES."""
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    at = np.arange(len(b)) - np.repeat(np.cumsum(length) - length, length)

    def back(k: int) -> np.ndarray:
        """The byte k before, a space before the word's start."""
        out = np.full(len(b), 32, np.uint64)
        out[k:] = np.where(at[k:] >= k, b[:-k], np.uint64(32)) if k < len(b) else out[k:]
        return out

    one, two, three, four = back(1), back(2), back(3), back(4)
    pair = one | two << np.uint64(8)
    contexts = (pair, pair | three << np.uint64(16), pair | three << np.uint64(16) | four << np.uint64(24))
    bit, own = bit.astype(np.uint64), b[byte]
    node = (np.uint64(1) << bit) | (own >> (np.uint64(8) - bit))
    slots = np.empty((len(byte), len(TABLES)), np.int32)
    for i, (c, size) in enumerate(zip(contexts, TABLES, strict=True)):
        h = (finish((c + np.uint64(i)) * np.uint64(0xA0761D6478BD642F))[byte] ^ node) * np.uint64(0x165667B19E3779F9)
        slots[:, i] = h >> np.uint64(64 - size - more)
    slots += (STARTS[:-1] << more).astype(np.int32)
    return ((own >> (np.uint64(7) - bit)) & np.uint64(1)).astype(np.int8), slots


def common_bits(a: bytes, b: bytes) -> int:
    """How many first bits two spellings share."""
    n = len(os.path.commonprefix([a, b]))
    return 8 * n + (8 - (a[n] ^ b[n]).bit_length() if n < min(len(a), len(b)) else 0)


class Prefixes:
    """How often every bit prefix of a group of tokens occurs in training, by the kind before.

    raw: spellings, sorted and distinct. n: occurrences (tokens x kinds). left, right: for 0, 1, .. bits, the occurrences in other groups of
    tokens that share so many with the first and the last token here.
    """

    def __init__(self, raw: list[bytes], n: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None):
        nothing = np.zeros((1, KINDS), np.int64)
        self.raw = raw
        self.n, self.left, self.right = n, nothing if left is None else left, nothing if right is None else right
        self.upto = np.concatenate([nothing, np.cumsum(n, 0)])
        # bits shared with the token before
        self.shared = np.zeros(len(raw), np.int64)
        head = np.array(raw, "S32").view(np.uint8).reshape(len(raw), 32)
        x = head[1:] ^ head[:-1]
        byte = (x != 0).argmax(1)
        value = x[np.arange(len(x)), byte]
        self.shared[1:] = 8 * byte + 8 - np.ceil(np.log2(value + 1.0)).astype(np.int64)
        for i in np.flatnonzero(value == 0) + 1:  # longer than the head
            self.shared[i] = common_bits(raw[i - 1], raw[i])

    def around(self, a: int, b: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences before token a that share 0 .. depth bits with it, and behind token b - 1 with that."""
        bits = np.arange(depth + 1)
        left = np.searchsorted(-np.minimum.accumulate(self.shared[a:0:-1]), -bits, side="right")
        right = np.searchsorted(-np.minimum.accumulate(self.shared[b:]), -bits, side="right")
        before, behind = self.upto[a] - self.upto[a - left], self.upto[b + right] - self.upto[b]
        for out, whole, beyond in ((before, left == a, self.left), (behind, right == len(self.n) - b, self.right)):
            k = min(depth + 1, len(beyond))
            out[:k] += np.where(whole[:k, None], beyond[:k], 0)
        return before, behind

    def around_far(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, int]:
        """:meth:`around` up to the first depth at which all of tokens a .. b - 1 are alone, and that depth."""
        deepest = int(max(self.shared[a + 1 : b].max(initial=0), self.shared[a] if a else len(self.left) - 1, self.shared[b] if b < len(self.n) else len(self.right) - 1))
        return *self.around(a, b, deepest + 1), deepest + 1

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences (depth x kinds) of the prefixes of the first and of the last token."""
        out = []
        for a in (0, len(self.n) - 1):
            before, behind, _ = self.around_far(a, a + 1)
            out.append(self.n[a] + before + behind)
        return out[0], out[1]

    def edges(self, a: int, b: int, more: int = 0) -> Edges:
        """The edges of tokens a .. b - 1 as if they had no other neighbours, with the occurrences of all tokens."""
        t, raw = b - a, self.raw[a:b]
        shared = self.shared[a:b].copy()
        shared[0] = -1
        start, length = np.maximum(shared, 0), 8 * np.fromiter(map(len, raw), np.int64, t)
        size = length - start
        first = np.cumsum(size) - size
        token = np.repeat(np.arange(t), size)
        depth = np.arange(len(token)) - np.repeat(first - start, size)
        # the tokens behind an edge are a run: up to the next one that shares no more than its depth
        end = token + 1
        if t > 1:
            d, i = np.nonzero(shared <= np.arange(int(shared.max()) + 1)[:, None])
            stop = np.append(i[1:], t)
            stop[np.append(d[1:] != d[:-1], True)] = t
            there = d < length[i]
            d, i = d[there], i[there]
            end[first[i] + d - start[i]] = stop[there]
        above, behind, level = nearest_smaller(shared.tolist())
        # the run of the prefix that an edge goes on from
        up, up_end = token.copy(), np.append(0, end[:-1])
        up[first], up_end[first] = above, behind
        sums = np.concatenate([np.zeros((1, KINDS), np.int64), np.cumsum(self.n[a:b], 0)])
        inside = sums[end] - sums[token]
        own, prefix = inside.copy(), sums[up_end] - sums[up]
        left, right, last = self.around_far(a, b)
        for runs, edge, outer in ((own, token == 0, left), (own, end == t, right)):
            runs[edge] += outer[np.minimum(depth[edge] + 1, last)]
        for edge, outer in ((up == 0, left), (up_end == t, right)):
            prefix[edge] += outer[np.minimum(depth[edge], last)]
        y, slots = slots_of(raw, np.repeat((np.cumsum(length) - length) // 8, size) + (depth >> 3), depth & 7, more)
        return Edges(y, slots, np.minimum(depth >> 3, PLACES - 1).astype(np.int32), token, end, inside, own, prefix - own, first, start, above, level)

    def parts(self, size: int, deep: int = 2000) -> Iterator[slice]:
        """Runs of tokens; those with very long common prefixes come one by one."""
        for s in chunks(len(self.n), size):
            yield from chunks_of(s, 1 if self.shared[s.start : s.stop + 1].max() > deep else size)


def nearest_smaller(x: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each number the index of the last smaller one before it (0 for the first) and of the next smaller one (or the length), and how many such steps back there are."""
    before, behind, level = [0] * len(x), [len(x)] * len(x), [0] * len(x)
    stack: list[int] = []
    for i, v in enumerate(x):
        while stack and x[stack[-1]] >= v:
            stack.pop()
        if stack:
            before[i], level[i] = stack[-1], level[stack[-1]] + 1
        stack.append(i)
    stack = []
    for i in range(len(x) - 1, -1, -1):
        while stack and x[stack[-1]] >= x[i]:
            stack.pop()
        if stack:
            behind[i] = stack[-1]
        stack.append(i)
    return np.array(before), np.array(behind), np.array(level)


def chunks_of(s: slice, size: int) -> Iterator[slice]:
    for i in range(s.start, s.stop, size):
        yield slice(i, min(s.stop, i + size))


def outer_counts(ends: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """left and right of :class:`Prefixes` for each group, from (first and last spelling, occurrences by depth of these inside the group), in order."""

    def carry(groups: list[tuple]) -> list[np.ndarray]:
        out = [np.zeros((1, KINDS), np.int64)]
        for (first, last, inside), (near, _, _) in zip(groups, groups[1:], strict=False):
            depth = common_bits(last, near) + 1
            here = inside[np.minimum(np.arange(depth), len(inside) - 1)].copy()
            k = min(depth, len(out[-1]), common_bits(first, last) + 1)
            here[:k] += out[-1][:k]
            out.append(here)
        return out

    left = carry([(first, last, tail) for first, last, _, tail in ends])
    right = carry([(last, first, head) for first, last, head, _ in reversed(ends)])
    return list(zip(left, reversed(right), strict=True))


def chunks(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))


def scale_of(largest: float) -> np.ndarray:
    """The counts that 256 codes stand for: whole numbers up to 16, then equal steps of the logarithm (4 % apart up to 10^9)."""
    step = max(1.08, (max(largest, 16.0) / 16) ** (1 / 239))
    return np.concatenate([np.arange(17.0), 16 * step ** np.arange(1, 240)]).astype(np.float32)


def coded(counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.searchsorted((scale[1:] + scale[:-1]) / 2, counts).astype(np.uint8)


@dataclass
class MixingModel:
    pairs: np.ndarray  # for each slot the codes of its zeros (high byte) and ones (low byte)
    scale: np.ndarray
    weights: np.ndarray  # (place, level of the gate, predictor, level), flat
    refine: np.ndarray  # level x step: log odds

    def tables(self) -> tuple[np.ndarray, ...]:
        """What is broadcast: plain arrays need no class of ours on the executors."""
        return self.pairs, self.scale

    def __post_init__(self) -> None:
        """What a pair of codes means: its log odds and level."""
        zeros, ones = self.scale[:, None], self.scale[None, :]
        self.odds = np.clip(np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3))), -12, 12).astype(np.float32).reshape(-1)
        self.levels = (np.searchsorted(SEEN, zeros + ones) * 2 + (np.minimum(zeros, ones) == 0)).astype(np.int32).reshape(-1)

    def hashed(self, edges: Edges, without_own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and levels of confidence, edges x hashed predictors.

        without_own: a bit's own occurrence is taken out of the counts that are exact; in larger ones it doesn't show.
        """
        pair = self.pairs.take(edges.slots).astype(np.int32)
        if without_own:
            own = edges.y[:, None] == 1
            code = np.where(own, pair & 255, pair >> 8)
            pair -= ((code > 0) & (code <= 16)) * np.where(own, np.int32(1), np.int32(256))
        return self.odds.take(pair), self.levels.take(pair)

    def inputs(self, edges: Edges, need: np.ndarray, without_own: bool) -> tuple[np.ndarray, ...]:
        """stretch and level (edges x predictors but the last); edge, kind, stretch and level of the last one where ``need`` (edges x kinds) asks for it."""
        stretch, level = self.hashed(edges, without_own)
        whole, whole_level = exact(edges.own.sum(1), edges.other.sum(1), edges.y, without_own)
        e, k = np.nonzero(need)
        last, last_level = exact(edges.own[e, k], edges.other[e, k], edges.y[e], without_own)
        return np.column_stack([stretch, whole]), np.column_stack([level, whole_level]), e, k, last, last_level

    def mix(self, edges: Edges, need: np.ndarray, without_own: bool) -> tuple[np.ndarray, ...]:
        """Mixed log odds for each (edge, kind) asked for, and what they come from: stretch, weights' places, edge, kind, and both of the last predictor."""
        stretch, level, e, k, last, last_level = self.inputs(edges, need, without_own)
        gate = (edges.place * LEVELS + level[:, GATE]) * (PREDICTORS * LEVELS)
        at = gate[:, None] + (_OFFSETS[:-1] + level)
        at_last = gate[e] + (_OFFSETS[-1] + last_level)
        m = np.einsum("ij,ij->i", self.weights.take(at), stretch)[e] + self.weights.take(at_last) * last
        return np.clip(m, -14, 14), stretch, level, at, e, k, last, at_last

    def refined(self, m: np.ndarray, level: np.ndarray) -> np.ndarray:
        return 0.75 * m + 0.25 * self.refine[level, step_of(m)]

    def log10(self, edges: Edges, need: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token (tokens x kinds) after a token of each kind asked for; need: edges x kinds."""
        m, _, level, _, e, k, _, _ = self.mix(edges, need, False)
        final = self.refined(m, level[e, WORD])
        nats = np.zeros((len(edges.y), KINDS), np.float32)
        nats[e, k] = -np.log1p(np.exp(np.where(edges.y[e] == 1, -final, final)))  # |final| stays far from overflow
        return edges.along_paths(nats) / np.log(10)


#: The level of each number of times that a context was seen, up to where it no longer changes.
_SEEN = np.searchsorted(SEEN, np.arange(int(SEEN[-1]) + 2)).astype(np.int32) * 2


def exact(own: np.ndarray, other: np.ndarray, y: np.ndarray, without_own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a one and level, from the counts of this bit (own) and of its opposite."""
    if without_own:
        own = np.maximum(own - 1, 0)
    odds = np.clip(np.log((own.astype(np.float32) + np.float32(0.3)) / (other.astype(np.float32) + np.float32(0.3))), -12, 12)
    return odds * (2 * y - 1).astype(np.float32), _SEEN.take(np.minimum(own + other, len(_SEEN) - 1)) + (np.minimum(own, other) == 0)


_OFFSETS = np.arange(PREDICTORS, dtype=np.int32) * LEVELS
N_WEIGHTS = PLACES * LEVELS * PREDICTORS * LEVELS


def step_of(m: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((m + 12) * (STEPS - 1) / 24), 0, STEPS - 1).astype(np.int64)


def splitters(blocks: DataFrame, group: int, each: int = 64) -> list[bytes]:
    """Spellings that cut the blocks' distinct tokens into buckets of about ``group``: quantiles of ``each`` samples a bucket."""
    total = blocks.agg(F.sum(F.size("tokens"))).first()[0] or 0
    buckets = -(-total // group)
    if buckets < 2:
        return []
    stride = max(1, total // (each * buckets))

    def some(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokens.values[xxhash.xxh64_intdigest(str(block)) % stride :: stride] if len(tokens) else tokens.values
                yield pa.RecordBatch.from_arrays([pa.array([spelling(w) for w in words.to_pylist()], pa.binary())], names=["raw"])

    found = sorted(bytes(r["raw"]) for r in blocks.select("block", "tokens").mapInArrow(some, "raw binary").collect())  # ``each`` spellings a bucket
    return sorted(set(found[each::each]))


def in_order(blocks: DataFrame, cuts: list[bytes]) -> DataFrame:
    """One row for each bucket: its tokens in the order of their spelling with their training occurrences, what its ends share inside it, and which tokens each block has."""
    sent = "block long, bucket int, tokens binary, counts binary, seen binary"
    schema = "g int, tokens array<binary>, counts binary, head binary, tail binary, blocks array<long>, at array<binary>, seen array<binary>"

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                tokens = row["tokens"].as_py()
                counts, seen = from_planes(zlib.decompress(row["counts"].as_py()), np.int64).reshape(-1, KINDS), row["seen"].as_py()
                raw = [spelling(t) for t in tokens] if cuts else []
                at = [0, *[bisect_left(raw, c) for c in cuts], len(tokens)]
                for g, (x, y) in enumerate(zip(at, at[1:], strict=False)):
                    if x < y:
                        values = [row["block"].as_py(), g, zlib.compress(b" ".join(tokens[x:y]), 1), zlib.compress(planes(counts[x:y].reshape(-1)), 1), zlib.compress(seen[x:y], 1)]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=[x.split()[0] for x in sent.split(", ")])

    def merge(t: pa.Table) -> pa.Table:
        numbers = Codes()
        at = [np.fromiter(map(numbers.__getitem__, zlib.decompress(x).split(b" ")), np.int32) for x in t["tokens"].to_pylist()]
        words = list(numbers)
        raw = [spelling(w) for w in words]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        at = [rank[x] for x in at]
        n = np.zeros((len(words), KINDS), np.int64)
        for x, c in zip(at, t["counts"].to_pylist(), strict=True):  # a block's tokens are distinct
            n[x] += from_planes(zlib.decompress(c), np.int64).reshape(-1, KINDS)
        p = Prefixes([raw[i] for i in order], n)
        head, tail = p.ends()
        values = [t["bucket"][0].as_py(), [words[i] for i in order], n.tobytes(), head.tobytes(), tail.tobytes(), t["block"].to_pylist(), [zlib.compress(planes(x), 1) for x in at], t["seen"].to_pylist()]
        types = [pa.int32(), pa.list_(pa.binary()), *[pa.binary()] * 3, pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 2]
        return pa.Table.from_arrays([pa.array([v], kind) for v, kind in zip(values, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return blocks.select("block", "tokens", "counts", "seen").mapInArrow(send, sent).groupBy("bucket").applyInArrow(merge, schema)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray, dict]]:
    """g, spellings, their counts (tokens x kinds), and the row, of each row of :func:`in_order`."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
            yield row["g"].as_py(), [spelling(t) for t in row["tokens"].as_py()], np.frombuffer(row["counts"].as_py(), np.int64).reshape(-1, KINDS), row


def cut_blocks(docs: DataFrame, folds: int, held: int, most: int) -> DataFrame:
    """Documents as their tokens' codes, in blocks of about ``most`` tokens with the blocks' own token lists, in the order of their spelling."""
    schema = "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_bytes array<long>, codes binary, kinds binary, seen binary, tokens array<binary>, counts binary"

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def start() -> dict:
            return {"numbers": Codes(), "ids": [], "held": [], "n": [], "bytes": [], "codes": [], "total": 0}

        def block(s: dict) -> pa.RecordBatch:
            tokens = list(s["numbers"])
            raw = [spelling(t) for t in tokens]
            order = sorted(range(len(raw)), key=raw.__getitem__)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            codes, tokens = rank[np.concatenate(s["codes"])], [tokens[i] for i in order]
            # what a token is to the next one; behind an end a text starts
            kinds = np.fromiter((0 if t == END else kind_of(t) for t in tokens), np.uint8, len(tokens))
            slot = codes.astype(np.int64) * KINDS + kinds[before(codes)]
            train = np.repeat(~np.array(s["held"], bool), s["n"])
            counts = np.bincount(slot[train], minlength=KINDS * len(tokens))
            seen = ((np.bincount(slot, minlength=KINDS * len(tokens)) > 0).reshape(-1, KINDS) << np.arange(KINDS)).sum(1).astype(np.uint8)
            values = [
                pa.array([(part << 24) + made], pa.int64()), pa.array([s["ids"]], pa.list_(pa.int64())), pa.array([s["held"]], pa.list_(pa.bool_())), pa.array([s["n"]], pa.list_(pa.int64())), pa.array([s["bytes"]], pa.list_(pa.int64())),
                pa.array([zlib.compress(planes(codes), 1)], pa.binary()), pa.array([kinds.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary()), pa.array([tokens], pa.list_(pa.binary())), pa.array([zlib.compress(planes(counts), 1)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in schema.split(", ")])

        s = start()
        for batch in it:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                tokens = raw.lower().split()
                tokens.append(END)
                c = np.fromiter(map(s["numbers"].__getitem__, tokens), np.int32, len(tokens))
                for name, v in zip(("ids", "held", "n", "bytes", "codes"), (doc_id, out, len(c), len(raw), c), strict=True):
                    s[name].append(v)
                s["total"] += len(c)
                if s["total"] >= most:
                    yield block(s)
                    s, made = start(), made + 1
        if s["ids"]:
            yield block(s)

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, schema)


def before(codes: np.ndarray) -> np.ndarray:
    """The code before each in a block: every text ends in END, which so stands before its successor, and the last one before the first."""
    return np.roll(codes, 1)


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, which packs better."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def hashes(tokens: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens.to_pylist()), np.uint64, len(tokens))


def codes_of(data: bytes) -> np.ndarray:
    return from_planes(zlib.decompress(data), np.int32)


def pairs_in(codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct pairs (code before, code), in the order of their hashes; these; and the pair at each place. h: of the tokens."""
    key, at = np.unique(before(codes) * np.int64(len(h)) + codes, return_inverse=True)
    a, b = key // len(h), key % len(h)
    hashed = finish(finish(h[a]) * np.uint64(0x9E3779B97F4A7C15) + h[b])
    order = np.argsort(hashed, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return a[order], b[order], hashed[order], place[at.reshape(-1)]


def pair_counts(blocks: DataFrame, buckets: int, bits: int = 64) -> DataFrame:
    """block, bucket, times: how often each pair of a block occurs in training, in the order of :func:`pairs_in`, cut by buckets. Pairs are alike by ``bits`` of their hash."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                _, _, hashed, at = pairs_in(codes_of(row["codes"].as_py()), hashes(row["tokens"].values))
                train = np.repeat(~np.array(row["held_out"].as_py(), bool), row["n_tokens"].as_py())
                times = np.bincount(at[train], minlength=len(hashed))
                bucket = (hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                hashed = hashed >> np.uint64(64 - bits)
                cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(hashed)]
                rows = [(int(bucket[x]), planes(np.diff(hashed[x:y], prepend=np.uint64(0))), zlib.compress(planes(times[x:y]), 1)) for x, y in zip(cut, cut[1:], strict=False)]
                for s in chunks(len(rows), 200):
                    b, p, t = zip(*rows[s], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), row["block"].as_py())), pa.array(b, pa.int32()), pa.array(p, pa.binary()), pa.array(t, pa.binary())], names=["block", "bucket", "pairs", "times"])

    def add(t: pa.Table) -> pa.Table:
        pairs = [np.cumsum(from_planes(x, np.uint64), dtype=np.uint64) for x in t["pairs"].to_pylist()]
        times = np.concatenate([from_planes(zlib.decompress(x), np.int64) for x in t["times"].to_pylist()])
        cut = np.cumsum([len(x) for x in pairs])[:-1]
        _, at = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.bincount(at.reshape(-1), times).astype(np.int64)[at.reshape(-1)]
        return pa.table({"block": t["block"], "bucket": t["bucket"], "times": pa.array([zlib.compress(planes(x), 1) for x in np.split(total, cut)], pa.binary())})

    rows = blocks.select("block", "held_out", "n_tokens", "codes", "tokens").mapInArrow(send, "block long, bucket int, pairs binary, times binary")
    return rows.groupBy("bucket").applyInArrow(add, "block long, bucket int, times binary")


def after_word(p: np.ndarray, pair: np.ndarray, first: np.ndarray, a: float, b: float) -> np.ndarray:
    """Log probability of tokens whose spelled one has the logarithm p, after a token that was seen ``first`` times, ``pair`` of them before the same token."""
    return WordMixer(p, pair, np.arange(len(p)), first).nats(a, b)


class WordMixer:
    """Mixes the spelled probabilities of tokens (their logarithm p) with those after the word before.

    word: which word that is; first: how often each word was seen; pair: how often before the same token.
    """

    def __init__(self, p: np.ndarray, pair: np.ndarray, word: np.ndarray, first: np.ndarray):
        self.p, self.word, self.first = p, word, first.astype(np.float64)
        self.met = np.flatnonzero(pair > 0)
        self.pair, self.spelled, self.met_word = pair[self.met].astype(np.float64), np.exp(p[self.met]), word[self.met]

    def nats(self, a: float, b: float) -> np.ndarray:
        weight = a * np.maximum(self.first, 1.0) ** b
        whole = np.log(self.first + weight)
        out = self.p + (np.log(weight) - whole)[self.word]
        out[self.met] = np.log(self.pair + weight[self.met_word] * self.spelled) - whole[self.met_word]
        return out


def learn(ordered: DataFrame, v: int, *, rate: float = 0.02, turn_size: int = 500) -> tuple:
    """From rows of :func:`in_order` with v distinct training tokens: the broadcast tables and counts outside groups, the bits that tables have more,
    the weights and the refining map. ``ordered`` is read three times."""
    spark = ordered.sparkSession
    more = max(0, round(np.log2(max(v, 1) / (1 << 19)) / 2))
    size = int(STARTS[-1]) << more
    ends = ordered.select("g", F.col("tokens")[0].alias("first"), F.element_at("tokens", -1).alias("last"), "head", "tail").orderBy("g").collect()
    outside = outer_counts([(spelling(bytes(r["first"])), spelling(bytes(r["last"])), *[np.frombuffer(r[x], np.int64).reshape(-1, KINDS) for x in ("head", "tail")]) for r in ends])
    outside = {r["g"]: x for r, x in zip(ends, outside, strict=True)} if ends else {}
    packed = ordered.select("g", "tokens", "counts")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.float32)
        for _, raw, n, _ in groups_of(it):
            p = Prefixes(raw, n)
            for s in p.parts(2000):
                edges = p.edges(s.start, s.stop, more)
                w = edges.inside.sum(1).astype(np.float32)
                for y in (0, 1):
                    own = np.flatnonzero((edges.y == y) & (w > 0))
                    np.add.at(total[y], edges.slots[own].reshape(-1), np.repeat(w[own], len(TABLES)))
        yield from blocks_of(total.reshape(-1), 65_536, packed=True)

    sums = collect_blocks(add_blocks(packed.mapInArrow(count, "block int, data binary"), "f4", packed=True), 2 * size, 65_536, "f4").reshape(2, size)
    scale = scale_of(float(sums.max()))
    # two bytes for each slot, and for each group what its two ends share with others
    shared = spark.sparkContext.broadcast((coded(sums[0], scale).astype(np.uint16) * 256 + coded(sums[1], scale), scale, outside))

    def mix(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, scale, outside = shared.value
        for g, raw, counts, _ in groups_of(it):
            m = MixingModel(pairs, scale, np.full(N_WEIGHTS, 0.3, np.float32), np.zeros((LEVELS, STEPS), np.float32))
            first, second, average = np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS)
            steps = np.zeros((2, LEVELS, STEPS))
            turn, kept = 0, 0.0
            p = Prefixes(raw, counts, *outside[g])
            runs = list(p.parts(turn_size))
            for i in np.random.default_rng(g).permutation(len(runs)):
                s = runs[i]
                if not counts[s].any():
                    continue
                turn += 1
                edges = p.edges(s.start, s.stop, more)
                mixed, stretch, level, at, e, k, last, at_last = m.mix(edges, edges.inside > 0, True)
                w = edges.inside[e, k].astype(np.float64)
                y = edges.y[e]
                error = (y - 1 / (1 + np.exp(-mixed))) * w / w.sum()
                each = np.bincount(e, error, minlength=len(edges.y))
                slope = np.bincount(at.reshape(-1), (each[:, None] * stretch).reshape(-1), minlength=N_WEIGHTS) + np.bincount(at_last, error * last, minlength=N_WEIGHTS)
                first = 0.9 * first + 0.1 * slope
                second = 0.99 * second + 0.01 * slope * slope
                m.weights += (rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
                # later turns weigh more, since the weights start far from where they end
                kept += turn
                average += turn * m.weights
                cell = (y * LEVELS + level[e, WORD]) * STEPS + step_of(mixed)
                steps += np.bincount(cell, w * turn, minlength=steps.size).reshape(steps.shape)
            if kept:
                yield from blocks_of(np.concatenate([[kept], average, steps.reshape(-1)]), 4096)

    k = 1 + N_WEIGHTS + 2 * LEVELS * STEPS
    got = collect_blocks(add_blocks(packed.mapInArrow(mix, "block int, data binary")), k, 4096)
    centre = np.linspace(-12, 12, STEPS)
    steps = got[1 + N_WEIGHTS : k].reshape(2, LEVELS, STEPS)
    p = 1 / (1 + np.exp(-centre))
    refine = np.log((steps[1] + 4 * p) / (steps[0] + 4 * (1 - p))).astype(np.float32)
    weights = (got[1 : 1 + N_WEIGHTS] / got[0]).astype(np.float32) if got[0] else np.full(N_WEIGHTS, 0.3, np.float32)
    return shared, more, weights, refine


def score(docs: DataFrame, *, folds: int = 7, held: int = 2, block: int = 3_000_000, group: int = 1_000_000, bucket: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    blocks = materialise(cut_blocks(docs, folds, held, block))
    ordered = materialise(in_order(blocks, splitters(blocks, group)))

    def totals(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            c = [np.frombuffer(x, np.int64).reshape(-1, KINDS).sum(1) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in c], pa.int64()), pa.array([int((x > 0).sum()) for x in c], pa.int64())], names=["n", "v"])

    total = ordered.select("counts").mapInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = int(total[0]), int(total[1])
    shared, more, weights, refine = learn(ordered, v)

    def rate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, part, c, p: the occurrences of each token of a block, and its log10 probability after each kind that the block has before it."""
        pairs, scale, outside = shared.value
        m = MixingModel(pairs, scale, weights, refine)
        for g, raw, counts, row in groups_of(it):
            p = Prefixes(raw, counts, *outside[g])
            at = [codes_of(x) for x in row["at"].as_py()]
            seen = [np.frombuffer(zlib.decompress(x), np.uint8)[:, None] >> np.arange(KINDS) & 1 > 0 for x in row["seen"].as_py()]
            asked = np.zeros((len(raw), KINDS), bool)
            for x, k in zip(at, seen, strict=True):
                asked[x] |= k
            lp = np.zeros((len(raw), KINDS), np.float32)
            for s in p.parts(2000):
                edges = p.edges(s.start, s.stop, more)
                lp[s] = m.log10(edges, behind(asked[s], edges))
            c = counts.sum(1)
            for b, x, k in zip(row["blocks"].as_py(), at, seen, strict=True):
                values = (b, g, zlib.compress(planes(c[x]), 1), zlib.compress(planes(lp[x][k]), 1))
                yield pa.RecordBatch.from_arrays([pa.array([z], t) for z, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "c", "p"])

    words = ordered.select("g", "tokens", "counts", "blocks", "at", "seen").mapInArrow(rate, "block long, part int, c binary, p binary")
    placed = blocks.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    back = words.unionByName(pair_counts(blocks, -(-placed // bucket) or 1, min(64, int(placed).bit_length() + 14)), allowMissingColumns=True)
    schema = "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, train_tokens long, base_score double, scores array<double>, without_own array<double>"

    def add(documents: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        met = known.filter(known["times"].is_valid()).sort_by("bucket")
        known = known.filter(known["c"].is_valid()).sort_by("part")
        counts = np.concatenate([np.zeros(0, np.int64), *[from_planes(zlib.decompress(x), np.int64) for x in known["c"].to_pylist()]])
        spelled = np.concatenate([np.zeros(0, np.float32), *[from_planes(zlib.decompress(x), np.float32) for x in known["p"].to_pylist()]])
        base = np.log10((counts + 1) / (n + 1 * (v + 1)))
        for i in range(documents.num_rows):
            row = {name: documents[name][i].as_py() for name in documents.column_names if name != "tokens"}
            sizes = np.array(row["n_tokens"], np.int64)
            first = np.cumsum(sizes) - sizes
            codes = codes_of(row["codes"])
            a, b, _, at = pairs_in(codes, hashes(documents["tokens"][i].values))
            times = np.concatenate([from_planes(zlib.decompress(x), np.int64) for x in met["times"].to_pylist()])
            lp = np.zeros((len(counts), KINDS), np.float32)
            lp[np.frombuffer(row["seen"], np.uint8)[:, None] >> np.arange(KINDS) & 1 > 0] = spelled
            nats = lp[b, np.frombuffer(row["kinds"], np.uint8)[a]] * np.log(10)
            # pairs of training texts without their own occurrence; tokens that occur once have no other to be learned from
            train = np.bincount(at[np.repeat(~np.array(row["held_out"], bool), sizes)], minlength=len(a))
            ask = np.flatnonzero((train > 0) & (counts[b] > 1))
            every = WordMixer(nats, times, a, counts)
            alone = WordMixer(nats[ask] + np.log1p(-1 / counts[b[ask]]), times[ask] - 1, a[ask], np.maximum(counts - 1, 0))
            scores, gains = np.empty((len(sizes), len(CHOICES))), []
            for j, choice in enumerate(CHOICES):
                scores[:, j] = np.add.reduceat(every.nats(*choice)[at], first) / np.log(10)
                gains.append(float(train[ask] @ alone.nats(*choice)))
            columns = [
                pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(sizes), pa.array(row["n_bytes"], pa.int64()), pa.array(np.add.reduceat((counts > 0)[codes].astype(np.int64), first)), pa.array(np.full(len(sizes), n)),
                pa.array(np.add.reduceat(base[codes], first)), pa.array(list(scores), pa.list_(pa.float64())), pa.array([gains] + [None] * (len(sizes) - 1), pa.list_(pa.float64())),
            ]
            out.append(pa.Table.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")]))
        return pa.concat_tables(out) if out else pa.schema([(x.split()[0], t) for x, t in zip(schema.split(", "), [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.float64(), *[pa.list_(pa.float64())] * 2], strict=True)]).empty_table()

    documents = blocks.select("block", "doc_id", "held_out", "n_tokens", "n_bytes", "codes", "kinds", "seen", "tokens")
    scored = materialise(documents.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(add, schema))
    gains = scored.where("without_own IS NOT NULL").agg(*[F.sum(F.col("without_own")[j]) for j in range(len(CHOICES))]).first()
    best = int(np.argmax([g or 0.0 for g in gains]))
    out = scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("scores")[best].alias("score"), "n_bytes")
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
    return out.withColumn("bits_per_byte", per_byte).drop("n_bytes")


def behind(asked: np.ndarray, edges: Edges) -> np.ndarray:
    """Which kinds (edges x kinds) any token behind an edge is asked for."""
    sums = np.concatenate([np.zeros((1, KINDS), np.int64), np.cumsum(asked, 0)])
    return sums[edges.end] > sums[edges.token]
