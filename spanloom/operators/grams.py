"""Sets of character trigrams as numbers, and the texts nearest to broadcast queries by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = 1 << 21  # counts of keys by queries that are held together


def codes_of(text: str) -> np.ndarray:
    """The distinct trigrams of the text between two spaces and one, each its three code points in one number."""
    c = np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def trigram_codes():
    """A function of a text column: array<long>, its distinct trigrams."""

    @F.arrow_udf("array<long>")
    def codes(texts: pa.Array) -> pa.Array:
        made = [codes_of(t) for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *made])))

    return codes


def closest(queries: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """q, key, similarity: for each query (q) the best of a stretch of the keys (key) with at least ``least``; ties by key.

    The queries' trigrams pass through the driver, so callers check their size first. A key's trigrams are looked up in lists of the queries that
    have them, and shared ones counted; each batch gives one row for a query at most.
    """
    asked = sorted(r[0] for r in queries.collect())
    sets = [codes_of(q) for q in asked]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate([np.zeros(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    known, at, n = np.unique(flat[order], return_index=True, return_counts=True)
    sent = queries.sparkSession.sparkContext.broadcast((asked, sizes, known, at, n, owner[order]))

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sizes, known, at, n, owner = sent.value
        low, high = (int(sizes.min()) * least, int(sizes.max()) / least) if len(sizes) else (0, 0)
        for batch in it:
            found: dict[int, tuple[float, str]] = {}
            rows = min(256, max(1, _CELLS // max(1, len(asked))))
            texts = batch.column(0)
            for first in range(0, len(texts) if len(asked) else 0, rows):
                some = texts.slice(first, rows).to_pylist()
                made = [codes_of(t) for t in some]
                nk = np.array([len(m) for m in made], np.int64)
                # sizes alone rule out most long texts
                fit = np.flatnonzero((nk >= low - 1e-9) & (nk <= high + 1e-9))
                if not len(fit):
                    continue
                nk, codes = nk[fit], np.concatenate([made[i] for i in fit])
                row = np.repeat(np.arange(len(fit)), nk)
                place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                same = known[place] == codes
                place, row = place[same], row[same]
                shared, done, start = np.zeros(len(fit) * len(asked), np.int64), np.cumsum(n[place]), 0
                while start < len(place):
                    stop = max(start + 1, int(np.searchsorted(done, done[start] + _CELLS)))
                    k = n[place[start:stop]]
                    post = np.repeat(at[place[start:stop]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    shared += np.bincount(np.repeat(row[start:stop], k) * len(asked) + owner[post], minlength=len(shared))
                    start = stop
                shared = shared.reshape(len(fit), len(asked))
                s = shared / (nk[:, None] + sizes - shared)
                top = s.max(0)
                for q in np.flatnonzero(top >= least):
                    key = min(some[fit[i]] for i in np.flatnonzero(s[:, q] == top[q]))
                    found[q] = min(found.get(q, (0.0, "")), (-float(top[q]), key))
            if found:
                yield pa.RecordBatch.from_pydict({"q": pa.array([asked[q] for q in found], pa.string()), "key": pa.array([v[1] for v in found.values()], pa.string()), "similarity": pa.array([-v[0] for v in found.values()], pa.float64())})

    return keys.mapInArrow(best, "q string, key string, similarity double")
