import numpy as np
import pytest

from spanloom.operators import lexicon as lx
from spanloom.operators.trie import TokenTrie


def flat(rows):
    return np.array([x for r in rows for x in r], np.int64), np.array([len(r) for r in rows], np.int64)


def test_hits_by_trying_every_stretch():
    rng = np.random.default_rng(3)
    for _ in range(60):
        entries = [rng.integers(-3, 4, rng.integers(0, 5)).tolist() for _ in range(rng.integers(0, 12))]
        texts = [rng.integers(-4, 5, rng.integers(0, 15)).tolist() for _ in range(6)]
        row, s, e = TokenTrie(*flat(entries)).hits(*flat(texts))
        want = sorted({(r, i, j) for r, t in enumerate(texts) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if t[i:j] in entries})
        assert list(zip(row.tolist(), s.tolist(), e.tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_dictionary_join_both_ways(spark, most):
    texts = spark.createDataFrame([(1, "Renal Failure after 5 – FU".split()), (2, ["renal"]), (3, []), (4, None), (5, "a failure after renal failure".split())], "sid long, tokens array<string>")
    entries = spark.createDataFrame([("renal failure", "d"), ("renal", "o"), ("5 - fu", "c"), ("failure after renal failure x", "z"), ("-", "sign"), ("failure", "f"), ("failure", "g")], "key string, type string")
    got = sorted(map(tuple, lx.dictionary_join(texts, entries, 4, most_tokens=most).collect()))
    assert got == sorted(
        [(1, 0, 2, "renal failure", "d"), (1, 0, 1, "renal", "o"), (1, 1, 2, "failure", "f"), (1, 1, 2, "failure", "g"), (1, 3, 6, "5 - fu", "c"), (2, 0, 1, "renal", "o")]
        + [(5, 3, 5, "renal failure", "d"), (5, 3, 4, "renal", "o"), (5, 1, 2, "failure", "f"), (5, 1, 2, "failure", "g"), (5, 4, 5, "failure", "f"), (5, 4, 5, "failure", "g")]
    )
    assert lx.dictionary_join(texts, entries.limit(0), 4, most_tokens=most).collect() == []


def test_drop_rule_counts_what_lies_outside(spark):
    texts = spark.createDataFrame([(1, ["cold"] * 9 + ["flu"]), (2, ["flu", "Cold"])], "sid long, tokens array<string>")
    spans = spark.createDataFrame([(1, 0, 1, "d", "cold", 1), (1, 9, 10, "d", "flu", 2), (2, 0, 1, "d", "flu", 3)], "sid long, s int, e int, type string, surface string, pos long")
    index = lx.surface_index(spans, texts)
    assert {r.key: (r.total, r.o) for r in index.collect()} == {"cold": (1, 9), "flu": (2, 0)}
    assert {(r.surface, r.action) for r in lx.validate_spans(spans, index).collect()} == {("cold", "drop"), ("flu", "keep")}
    assert [r.key for r in lx.gazetteer(index).collect()] == ["flu"]
