"""N-gram Jaccard self-join of documents by a prefix tree, and the components of its links.

A document is the set of its distinct word n-grams, as 64-bit hashes. Equal sets are one class from the start; a class has one
row, so hot texts never gather.

1. One global order holds for all sets. Hashes below a fixed bound are counted exactly over the corpus: those of one set alone
   come first, then the others, rare ones first; hashes above the bound come last, by value. A set's prefix is its first
   ``n - ceil(t n) + 1`` grams. Linked sets share a gram of their prefixes, and a gram of one set alone is shared with none:
   a set whose whole prefix is its own (most are) is done here, the others post the rest of their prefix.
2. In each posted gram's run, by set size, a leader is paired with those that follow within the size bound. Linked sets of sizes a and b
   share at least ``needed(a, b) - ceil(t max(a, b)) + 1`` grams of their prefixes; pairs that meet in as many runs are checked. The partners
   of a leader are stored in a prefix tree; the leader walks it. Paths that partners share are counted once, and a subtree
   ends where what remains of the sets can't lift the overlap to the bound. Found links join classes into components.
3. Twice, each class is paired with the class of another component that looks nearest by bitmap, so that components
   grow as in Boruvka's algorithm.
4. All pairs that are in different components by then are checked in the same way, unless places or bitmaps rule a link out. So pairs
   inside a group of near copies are not listed, yet every link between components is found: the result is exact.

The first gram that two linked sets share is among the first ``n - needed(a, b) + 1`` of each, so a pair counts only in runs of such places.
A class's bitmap holds the parities of its grams by hash value, in about as many bits as it has grams (256 to 4,096). Two bitmaps
differ in no more bits than the sets differ in grams, so a pair whose bitmaps differ in more than linked sets may is no link. Bitmaps are
sent only for rows that have a partner of another component left.

Only texts of classes in such pairs are read again. A bitmap of their keys, of 8 bits a key and at most 2^27, keeps the other texts out of
the shuffle (a collision sends a text in vain, no more).

A leader's partners are dealt into trees of at most ``tree`` sets.

Defined results: null and empty texts and texts without words have no grams (n_shingles 0) and link with nothing; texts of fewer
than ``n`` words have one gram; repeated rows are one class; rows without doc_id link, but name no component unless all are
without, then null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_blocks, blocks_of, collect_blocks, components, materialise, small_batches

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)  # any odd numbers


class WordHashes(dict):
    """64-bit hashes of words, the latest of them remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_set(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Ascending distinct hashes of the word n-grams; the whole text as one where it has fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += mixed(h[i : len(h) - k + 1 + i] + np.uint64(i)) * (_ODD[i % 5] + np.uint64(2 * (i // 5)))
    return np.unique(mixed(total))


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap of two linked sets of sizes a and b: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """Sets, each in one global order (by hash), as the paths of a prefix tree.

    Paths are kept sorted; what a path shares with the one before it is the depth of the node where it branches off, so
    the node's overlap with a probe is known when the next path is walked.
    """

    def __init__(self, paths: list[np.ndarray]):
        raw = [p.astype(">u8").tobytes() for p in paths]
        self.order = sorted(range(len(paths)), key=raw.__getitem__)
        self.paths = [paths[i] for i in self.order]
        self.shared = [0] * len(paths)
        for k in range(1, len(paths)):
            a, b = self.paths[k - 1], self.paths[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[k] = int(differ[0]) if len(differ) else m

    def linked(self, probe: np.ndarray, percent: int) -> list[int]:
        """Which of the given sets link with the probe."""
        inside = np.sort(probe)
        found: list[int] = []
        overlap = np.zeros(1, np.int64)  # overlap[d]: grams of the current path's first d that the probe holds
        walked = 0  # how deep the current path has been walked
        for k, path in enumerate(self.paths):
            walked = min(walked, self.shared[k])
            overlap = overlap[: walked + 1]
            n, least = len(path), needed(len(path), len(probe), percent)
            if min(n, len(probe)) < least:
                continue
            while walked < n:
                # at most what remains of the path can still be added
                if overlap[walked] + n - walked < least:
                    break
                stop = min(n, max(2 * walked, walked + 64))
                some = path[walked:stop]
                at = np.minimum(np.searchsorted(inside, some), len(inside) - 1)
                overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(inside[at] == some)])
                walked = stop
            if walked == n and overlap[n] >= least:
                found.append(self.order[k])
        return found


def as_long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), as_long(flat))


def runs(it: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole runs of equal ``gram``, many at a time, from batches sorted by it: the columns, and where runs start. Runs of one row are left out."""

    def many(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
        columns = {n: t.column(n).to_numpy() for n in t.column_names}
        gram = columns["gram"]
        same = gram[1:] == gram[:-1]
        inside = np.append(False, same) | np.append(same, False)
        columns = {n: c[inside] for n, c in columns.items()}
        gram = columns["gram"]
        return (columns, np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))) if len(gram) else None

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in it:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            change = np.flatnonzero(gram[1:] != gram[:-1])
            if len(change):
                last = int(change[-1]) + 1
                if found := many(t.slice(0, last)):
                    yield found
                held, n = t.slice(last).to_batches(), n - last
    if n and (found := many(pa.Table.from_batches(held))):
        yield found


def ends_of(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)


def leaders(size: np.ndarray, percent: int, starts: np.ndarray) -> np.ndarray:
    """For set sizes, ascending inside runs: the index of the first of the stretch within the size bound that each row belongs to."""
    ends = ends_of(starts, len(size))
    out = np.repeat(starts, ends - starts)
    for first, end in zip(starts[(wide := size[ends - 1] > size[starts] * 100 // percent)].tolist(), ends[wide].tolist(), strict=True):
        lead = first
        while lead < end:
            stop = lead + int(np.searchsorted(size[lead:end], size[lead] * 100 // percent, "right"))
            out[lead:stop] = lead
            lead = max(stop, lead + 1)
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def least_runs(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """In how many runs two linked sets of these sizes meet at least.

    With o shared grams at least, prefixes that leave out o - r grams share r. A prefix leaves out ceil(percent * n / 100) - 1.
    """
    o = -(-percent * (a + b) // (100 + percent))
    return o + 1 + np.maximum(percent * a, percent * b) // -100


COARSE, FINE = 256, 4096


def parities(grams: np.ndarray) -> bytes:
    """The parity of the number of grams at each hash value, in a power of two of bits that is no less than the number of grams (COARSE to FINE)."""
    bits = min(FINE, max(COARSE, 1 << max(0, len(grams) - 1).bit_length()))
    odd = np.bincount((grams >> np.uint64(40) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of some rows, by ascending set size."""

    def __init__(self, rows: np.ndarray):
        width = np.fromiter((len(r) // 8 for r in rows), np.int64, len(rows))
        self.width, self.at = width, np.zeros(len(rows), np.int64)  # in 64-bit words, and where a row is among those of its width
        self.coarse, self.fine = np.empty((len(rows), COARSE // 64), np.uint64), {}
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            self.at[own] = np.arange(len(own))
            self.fine[w] = np.frombuffer(b"".join(rows[own].tolist()), np.uint64).reshape(len(own), w)
            self.coarse[own] = np.bitwise_xor.reduce(self.fine[w].reshape(len(own), -1, COARSE // 64), 1)

    def folded(self, rows: np.ndarray, w: int) -> np.ndarray:
        """The rows' bitmaps at ``w`` words, which is theirs or less."""
        out = np.empty((len(rows), w), np.uint64)
        for own in np.unique(self.width[rows]).tolist():
            some = self.width[rows] == own
            out[some] = np.bitwise_xor.reduce(self.fine[own][self.at[rows[some]]].reshape(-1, own // w, w), 1)
        return out

    def far(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """In how many bits rows a and b (no smaller sets) differ, as far as that is no more than ``most``."""
        far = np.bitwise_count(self.coarse[a] ^ self.coarse[b]).sum(1, dtype=np.int64)
        for w in np.unique(self.width[a]).tolist():
            some = np.flatnonzero((self.width[a] == w) & (far <= most)) if w > COARSE // 64 else ()
            for i in range(0, len(some), 16_384):
                part = some[i : i + 16_384]
                far[part] = np.bitwise_count(self.folded(a[part], w) ^ self.folded(b[part], w)).sum(1, dtype=np.int64)
        return far


def apart(run: dict[str, np.ndarray], starts: np.ndarray, percent: int, small: int = 48, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a, b) of one run (each by ascending size) of different components that sizes and places allow."""
    size, comp, place = run["n"], run["comp"], run["place"]

    def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least = -(-percent * (size[a] + size[b]) // (100 + percent))
        return (size[b] * percent <= size[a] * 100) & (place[a] <= size[a] - least + 1) & (place[b] <= size[b] - least + 1)

    ends = ends_of(starts, len(size))
    # runs of one component have nothing to find
    differ = np.append(False, comp[1:] != comp[:-1])
    differ[starts] = False
    mixed = np.add.reduceat(differ, starts) > 0 if len(starts) else differ
    little = mixed & (ends - starts <= small)
    rows = np.repeat(starts[little], (ends - starts)[little]) + ranges((ends - starts)[little])
    after = np.repeat(ends[little], (ends - starts)[little]) - rows - 1
    for i in range(0, len(rows), 16_384):
        n = after[i : i + 16_384]
        a = np.repeat(rows[i : i + 16_384], n)
        b = a + 1 + ranges(n)
        ok = np.flatnonzero(comp[a] != comp[b])
        a, b = a[ok], b[ok]
        ok = allowed(a, b)
        if ok.any():
            yield a[ok], b[ok]
    for start, end in zip(starts[mixed & ~little].tolist(), ends[mixed & ~little].tolist(), strict=True):
        # of two rows one at least is not in the run's largest component: only such rows look for partners
        own, sizes = comp[start:end], size[start:end]
        _, number, counts = np.unique(own, return_inverse=True, return_counts=True)
        few = number.reshape(-1) != counts.argmax()
        # the sizes that b may have for a, and the other way round
        low, high = np.searchsorted(sizes, -(-sizes * percent // 100), "left"), np.searchsorted(sizes, sizes * 100 // percent, "right")
        look = np.flatnonzero(few)
        step = max(1, most // len(sizes))
        for i in range(0, len(look), step):
            some = look[i : i + step]
            first, last = int(low[some].min()), int(high[some].max())
            x, y = np.nonzero(own[some, None] != own[None, first:last])
            x, y = some[x], y + first
            ok = ~few[y] | (x < y)  # two such rows meet once
            x, y = x[ok], y[ok]
            a, b = start + np.minimum(x, y), start + np.maximum(x, y)
            ok = allowed(a, b)
            if ok.any():
                yield a[ok], b[ok]


def ranges(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of these numbers."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def across(run: dict[str, np.ndarray], starts: np.ndarray, percent: int, most: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """The pairs of :func:`apart` that bitmaps allow, with how far these differ."""
    size, cid = run["n"], run["cid"]
    bits = None
    for x, y in apart(run, starts, percent):
        bits = Bitmaps(run["bits"]) if bits is None else bits
        for i in range(0, len(x), most):
            a, b = x[i : i + most], y[i : i + most]
            total = size[a] + size[b]
            allowed = total - 2 * -(-percent * total // (100 + percent))
            far = bits.far(a, b, allowed)
            ok = far <= allowed
            if ok.any():
                yield {"a": cid[a[ok]], "b": cid[b[ok]], "far": far[ok]}


def together(found: Iterator[dict[str, np.ndarray]], names: list[str], batch, most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """``batch`` of the distinct rows of what was found, a bounded number of rows at a time."""
    held, n = [], 0
    for f in found:
        held.append(np.stack([f[c] for c in names], 1))
        n += len(held[-1])
        if n >= most:
            distinct = np.unique(np.concatenate(held), axis=0)
            held, n = [distinct], len(distinct)
            if n >= most // 2:
                yield batch(distinct)
                held, n = [], 0
    if n:
        yield batch(np.unique(np.concatenate(held), axis=0))


def nearest(rows: np.ndarray) -> pa.RecordBatch:
    """x, y, far: for each class of the pairs (a, b, far) its nearest partner."""
    a, b, far = rows.T
    x, y, far = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([far, far])
    order = np.lexsort((y, far, x))
    x, y, far = x[order], y[order], far[order]
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return pa.RecordBatch.from_arrays([pa.array(c[first]) for c in (x, y, far)], names=["x", "y", "far"])


def listed(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["a", "b"])


def led(run: dict[str, np.ndarray], starts: np.ndarray, percent: int) -> dict[str, np.ndarray]:
    """Each row of some runs with its leader."""
    lead = leaders(run["n"], percent, starts)
    row = np.flatnonzero(lead != np.arange(len(lead)))
    return {"a": run["cid"][lead[row]], "b": run["cid"][row], "least": least_runs(run["n"][lead[row]], run["n"][row], percent)}


def counted(found: Iterator[dict[str, np.ndarray]], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """a, b, least, met: how often each pair came up, a bounded number of them at a time."""

    def batch(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        three = np.stack([np.concatenate([h[c] for h in held]) for c in ("a", "b", "least")], 1)
        rows, met = np.unique(three, axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in rows.T], pa.array(met.astype(np.int64))], names=["a", "b", "least", "met"])

    held, n = [], 0
    for f in found:
        held.append(f)
        n += len(f["a"])
        if n >= most:
            yield batch(held)
            held, n = [], 0
    if n:
        yield batch(held)


def often(pairs: DataFrame) -> DataFrame:
    """The pairs that meet often enough to link."""
    return pairs.groupBy("a", "b").agg(F.sum("met").alias("met"), F.first("least").alias("least")).where("met >= least").select("a", "b")


def check_pairs(pairs: DataFrame, paths: DataFrame, percent: int, tree: int) -> DataFrame:
    """The pairs (a, b) that link. ``paths``: cid, path (the set by ascending hash)."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / tree).cast("int").alias("trees"))
    dealt = pairs.join(many, "a").withColumn("t", F.pmod(F.xxhash64("b"), "trees").cast("int")).select("a", "t", "b")
    stored = dealt.join(paths.withColumnRenamed("cid", "b"), "b").select("a", "t", "b", "path")
    probes = dealt.select("a", "t").distinct().join(paths.withColumnRenamed("cid", "a"), "a").select("a", "t", F.col("a").alias("b"), "path")

    def walk(t: pa.Table) -> pa.Table:
        a, b = t["a"][0].as_py(), t["b"].to_pylist()
        column = t["path"].combine_chunks()
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        sets = [flat[offsets[i] : offsets[i + 1]] for i in range(len(b))]
        probe = sets[b.index(a)]
        others = [i for i in range(len(b)) if b[i] != a]
        hit = [b[others[k]] for k in PrefixTree([sets[i] for i in others]).linked(probe, percent)] if others else []
        return pa.table({"a": pa.array([a] * len(hit), pa.int64()), "b": pa.array(hit, pa.int64())})

    return stored.unionByName(probes).groupBy("a", "t").applyInArrow(walk, "a long, b long")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def key_filter(keys: DataFrame, most: int = 1 << 27) -> Callable[[str], Column]:
    """A test of a column of 64-bit keys: true for all of ``keys`` (one column), and for others now and then.

    The bitmap that is broadcast has 8 bits a key, at most ``most`` (16 MB).
    """
    bits = min(most, max(1 << 16, 1 << (8 * keys.count()).bit_length()))

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(bits // 8, np.uint8)
        for batch in it:
            at = batch.column(0).to_numpy() & (bits - 1)
            np.bitwise_or.at(marked, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield from blocks_of(marked, 65_536, packed=True)

    union = add_blocks(keys.mapInArrow(mark, "block int, data binary"), "u1", packed=True, add=np.bitwise_or)
    bitmap = keys.sparkSession.sparkContext.broadcast(collect_blocks(union, bits // 8, 65_536, "u1"))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        at = key.to_numpy() & (bits - 1)
        return pd.Series((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return maybe


def paths_of(keyed: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """cid, path (the set by ascending hash) of every class in ``pairs``."""
    active = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = materialise(classes.join(active, "cid", "left_semi").select("key", "cid"))
    maybe = key_filter(wanted.select("key"))

    def ordered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        for batch in it:
            ids, found = [], []
            for cid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if cid not in done:  # repeated rows
                    done.add(cid)
                    ids.append(cid)
                    found.append(gram_set(text.as_py(), n, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(found)], names=["cid", "path"])

    texts = keyed.where(maybe("key")).join(wanted, "key").select("cid", "text")
    return materialise(texts.mapInArrow(ordered, "cid long, path array<long>"))


def join(docs: DataFrame, *, n: int = 3, percent: int = 90, pool: float | None = None, tree: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, with ``group_id`` (one for each component; null without grams) and ``key`` (:func:`row_key`).

    pool: the share of hashes that are counted; by default a quarter more than a prefix takes.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    keyed = docs.withColumn("key", row_key())
    bound = np.uint64(min(2**64 - 1, int((1.25 * (1 - percent / 100) if pool is None else pool) * 2.0**64)))

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in it:
            ids, sizes, low, tails, bits = [], [], [], [], []
            for text in batch.column(1):
                grams = gram_set(text.as_py(), n, hashes)
                cid = xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None
                at = int(np.searchsorted(grams, bound))
                again = cid is None or cid in seen  # copies in one task count their grams once
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(cid)
                ids.append(cid)
                sizes.append(len(grams))
                low.append(grams[:0] if again else grams[:at])
                tails.append(grams[:0] if again else grams[at : at + max(0, prefix_size(len(grams), percent) - at)])
                bits.append(None if again else parities(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), lists(low), lists(tails), pa.array(bits, pa.binary())], names=["doc_id", "key", "n_shingles", "cid", "low", "tail", "bits"])

    signed = materialise(keyed.mapInArrow(sign, "doc_id long, key long, n_shingles long, cid long, low array<long>, tail array<long>, bits binary"))
    # one row for each class; the row whose text will stand for it is the one with the smallest key
    classes = signed.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.max(F.size("low")).cast("long").alias("pooled"), F.max("bits").alias("bits"))
    classes = materialise(classes)

    def shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Grams of two classes or more, with their number; a class that several tasks sent counts once."""
        for run, _ in runs(it):
            gram, cid = run["gram"], run["cid"]
            once = np.append(True, (gram[1:] != gram[:-1]) | (cid[1:] != cid[:-1]))
            gram, cid = gram[once], cid[once]
            starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            n = ends_of(starts, len(gram)) - starts
            df = np.repeat(n, n)
            yield pa.RecordBatch.from_arrays([pa.array(c[df > 1]) for c in (gram, cid, df)], names=["gram", "cid", "df"])

    counted_ = signed.select(F.explode("low").alias("gram"), "cid").repartition("gram").sortWithinPartitions("gram", "cid")
    common = materialise(counted_.mapInArrow(shared, "gram long, cid long, df long"))
    # how much of each prefix is left after the grams that no other class holds
    left = common.groupBy("cid").agg(F.count("*").alias("common"))
    p = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    left = classes.join(left, "cid", "left").select("cid", F.col("n").cast("long").alias("n"), F.coalesce("common", F.lit(0)).alias("common"), (p - F.col("pooled") + F.coalesce("common", F.lit(0))).cast("long").alias("want"), (F.col("pooled") - F.coalesce("common", F.lit(0))).alias("own")).where("want > 0")
    left = materialise(left)
    order = Window.partitionBy("cid").orderBy("df", "gram")
    posted = common.join(left, "cid").withColumn("nth", F.row_number().over(order)).where("nth <= want").select("gram", "n", "cid", (F.col("own") + F.col("nth")).alias("place"))
    # a class with fewer grams below the bound than its prefix takes has the rest in ``tail``
    tails = signed.where("size(tail) > 0").select("cid", F.col("n_shingles").alias("n"), F.size("low").alias("pooled"), F.posexplode("tail").alias("at", "gram")).distinct()
    posted = posted.unionByName(tails.select("gram", "n", "cid", (F.col("pooled") + F.col("at") + 1).cast("long").alias("place")))

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, _ in runs(it):
            yield pa.RecordBatch.from_arrays([pa.array(run[c]) for c in ("gram", "n", "cid", "place")], names=["gram", "n", "cid", "place"])

    def by_run(df: DataFrame) -> DataFrame:
        return df.repartition("gram").sortWithinPartitions("gram", "n", "cid")

    met = materialise(by_run(posted).mapInArrow(meet, "gram long, n long, cid long, place long"))

    def with_leaders(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(led(*run, percent) for run in runs(it))

    def open_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that may have a partner yet."""
        for run, starts in runs(it):
            open_ = np.zeros(len(run["gram"]), bool)
            for a, b in apart(run, starts, percent):
                open_[a] = True
                open_[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(run[c][open_]) for c in ("gram", "n", "cid", "place", "comp")], names=["gram", "n", "cid", "place", "comp"])

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together((x for run in runs(it) for x in across(*run, percent)), ["a", "b", "far"], nearest)

    def rest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together((x for run in runs(it) for x in across(*run, percent)), ["a", "b"], listed)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs)
        return materialise(check_pairs(pairs, paths_of(keyed, classes, pairs, n), percent, tree))

    def still_open(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows that may hold further links, with their components."""
        of = classes.join(components(links).withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("comp"))
        return materialise(by_run(rows.drop("comp").join(of, "cid").select("gram", "n", "cid", "place", "comp")).mapInArrow(open_runs, "gram long, n long, cid long, place long, comp long"))

    def mapped(rows: DataFrame) -> DataFrame:
        return by_run(rows.join(classes.select("cid", "bits"), "cid").select("gram", "n", "cid", "place", "comp", "bits"))

    links = linked(often(by_run(met.select("gram", "n", "cid")).mapInArrow(with_leaders, "a long, b long, least long, met long")))
    left_open = met
    for _ in range(2):
        left_open = still_open(left_open, links)
        best = mapped(left_open).mapInArrow(near, "x long, y long, far long").groupBy("x").agg(F.min(F.struct("far", "y")).alias("m"))
        links = links.union(linked(best.select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()))
    left_open = still_open(left_open, links)
    links = links.union(linked(mapped(left_open).mapInArrow(rest, "a long, b long").distinct()))
    roots = components(links)
    of = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "low", F.coalesce("root", "cid").alias("root"))
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "root").select("cid", "component_id", F.col("root").alias("group_id"))
    return signed.select("doc_id", "n_shingles", "cid", "key").join(of, "cid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group_id", "key")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The document with the smallest doc_id of each component, with its own columns. Documents without words all stay.

    Only rows that go, or that are alike in doc_id and text, meet their keys in a shuffle; all others pass. Of rows that are alike one stays.
    """
    rows = materialise(join(docs, **params).select("doc_id", "group_id", "key"))
    worded = rows.where("group_id IS NOT NULL").groupBy("group_id", "doc_id", "key").agg(F.count("*").alias("n"))
    lowest = worded.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("low"), F.sum("n").alias("n")).where("n > 1").select("group_id", F.col("low.key").alias("low"))
    # the keys of components of more than one row, and whether their rows stay
    judged = materialise(worded.join(lowest, "group_id").select("key", "n", (F.col("key") == F.col("low")).alias("stays")))
    gone, alike = judged.where("NOT stays").select(F.col("key").alias("__key")), judged.where("stays AND n > 1").select(F.col("key").alias("__key"))
    kept = docs.withColumn("__key", row_key())
    maybe = key_filter(gone)
    kept = kept.where(~maybe("__key")).unionByName(kept.where(maybe("__key")).join(gone, "__key", "left_anti"))
    if alike.limit(1).count():
        maybe = key_filter(alike)
        met = kept.where(maybe("__key"))
        once = met.join(alike, "__key", "left_semi").groupBy("__key").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
        return kept.where(~maybe("__key")).select(*docs.columns).unionByName(met.join(alike, "__key", "left_anti").select(*docs.columns)).unionByName(once)
    return kept.select(*docs.columns)
