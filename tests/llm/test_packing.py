import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm.packing import WordTokenizer, pack_documents, plan_bins
from spanloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def held(rows, texts, library, length=4096):
    want = Counter()
    for d, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, i in enumerate(range(0, len(ids), length)):
            want[d, k, i, len(ids[i : i + length]), zlib.crc32(ids[i : i + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by), sum(r.length for r in rows)


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack_documents(docs, tokenizer_path()).collect()
    used, tokens = held(rows, [(r.doc_id, r.text) for r in docs.collect()], library)
    assert used <= -(-tokens // 4096) + 1


def test_word_memory_equals_the_library(library):
    texts = ["It's 12 o'clock; don't 'RE-DO", "á é", "ΑΣ ΣΑΣ", "x\x1cy\x85z", "naïve café—dash “q”", "<|startoftext|>", "İ ǅ ẞ", "", "­ soft", "ñ" * 5000]
    mine = WordTokenizer(tokenizer_path(), most=3)
    for some in (texts, texts[:1], texts[5:7], [], texts):
        for t, ids in zip(some, mine.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_ids_equal_the_library_on_any_letters_below_u0250(library):
    rng = np.random.default_rng(3)
    pools = ["".join(map(chr, range(0x250))), "".join(map(chr, range(0xC0, 0x250))), "ȺȾɁƁabV ' sdtl'0 1", "abc étîüß's't .,;!"]
    mine = WordTokenizer(tokenizer_path(), most=2000)
    fast = 0
    for _ in range(300):
        texts = ["".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 12))) for pool in pools for _ in range(10)]
        fast += sum(mine.OTHER.search(t) is None for t in texts)
        for t, ids in zip(texts, mine.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert fast > 3000


def test_plan_uses_what_is_there_and_fills():
    rng = np.random.default_rng(5)
    for length in (8, 64, 512):
        counts = np.zeros(length + 1, np.int64)
        for s in rng.integers(1, length + 1, 4000):
            counts[s] += 1
        plan = plan_bins(counts, length)
        used = np.zeros_like(counts)
        for sizes, n in plan:
            assert n > 0 and sum(sizes) <= length
            for s in sizes:
                used[s] += n
        assert (used == counts).all()
        best = max(-(-int((counts * np.arange(length + 1)).sum()) // length), int(counts[length // 2 + 1 :].sum()))
        assert sum(n for _, n in plan) <= best * 1.02 + 1


def test_small_optima():
    counts = np.zeros(11, np.int64)
    counts[[6, 4, 5, 3, 2]] = [3, 3, 2, 2, 2]  # 6+4 three times, 5+5, 3+3+2+2
    assert sum(n for _, n in plan_bins(counts, 10)) == 5


def test_odd(odd, clashing, empty, library):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    rows = pack_documents(odd, tokenizer_path()).collect()
    held(rows, texts, library)
    held(pack_documents(clashing, tokenizer_path(), with_ids=True).collect(), texts, library)
    assert pack_documents(empty, tokenizer_path()).collect() == []
