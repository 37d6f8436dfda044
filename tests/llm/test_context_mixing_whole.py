import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from spanloom.llm.context_mixing import CHOICES, END, KINDS, LEVELS, N_WEIGHTS, PREDICTORS, SEEN, STARTS, STEPS, MixingModel, Prefixes, after_word, behind, chunks, codes_of, cut_blocks, from_planes, hashes, outer_counts, pair_counts, pairs_in, scale_of, score, slots_of, spelling, step_of


def test_prefixes_are_counted_exactly():
    """Over groups of any size, with long shared prefixes and bytes below the space."""
    rng = np.random.default_rng(5)
    words = {bytes(rng.choice(list(b"ab\x01\xc3"), rng.integers(1, 7)).tolist()) for _ in range(300)} | {END, b"x" * 700 + b"1", b"x" * 700 + b"2", b"y" * 40}
    raw = sorted(map(spelling, words))
    n = rng.integers(0, 4, (len(raw), KINDS))
    counts = Counter()
    for r, c in zip(raw, n, strict=True):
        text = "".join(f"{b:08b}" for b in r)
        for j in range(len(text) + 1):
            for k in range(KINDS):
                counts[text[:j], k] += int(c[k])
    for size in (1, 2, 50, 1000):
        groups = [(raw[s], n[s]) for s in chunks(len(raw), size)]
        inside = [Prefixes(*g) for g in groups]
        outside = outer_counts([(r[0], r[-1], *p.ends()) for (r, _), p in zip(groups, inside, strict=True)])
        for (r, c), sides in zip(groups, outside, strict=True):
            p = Prefixes(r, c, *sides)
            for s in p.parts(20):
                e = p.edges(s.start, s.stop)
                met = set()
                own = Counter()
                for i in range(s.start, s.stop):
                    text = "".join(f"{b:08b}" for b in r[i])
                    for j in range(1, len(text) + 1):
                        for k in range(KINDS):
                            own[text[:j], k] += int(c[i][k])
                first = [*e.first.tolist(), len(e.y)]
                for i in range(s.stop - s.start):
                    text = "".join(f"{b:08b}" for b in r[s.start + i])
                    for at in range(first[i], first[i + 1]):
                        d = int(e.start[i]) + at - first[i]
                        assert e.y[at] == int(text[d]) and text[: d + 1] not in met
                        met.add(text[: d + 1])
                        for k in range(KINDS):
                            assert e.inside[at, k] == own[text[: d + 1], k]
                            assert e.own[at, k] == counts[text[: d + 1], k] and e.other[at, k] == counts[text[:d], k] - counts[text[: d + 1], k]
                assert met == {t for t, _ in own}
                values = np.random.default_rng(1).random(len(e.y))
                by_edge = {}
                for i in range(s.stop - s.start):
                    text = "".join(f"{b:08b}" for b in r[s.start + i])
                    by_edge |= {text[: int(e.start[i]) + at - first[i] + 1]: values[at] for at in range(first[i], first[i + 1])}
                    assert abs(e.along_paths(values)[i] - sum(by_edge[text[:j]] for j in range(1, len(text) + 1))) < 1e-9


def test_spelled_probabilities_by_brute_force():
    """Bit by bit, with the formulas of the module's text."""
    rng = np.random.default_rng(6)
    words = sorted({bytes(rng.choice(list(b"abcd"), rng.integers(1, 6)).tolist()) for _ in range(80)} | {END}, key=spelling)
    raw, n = [spelling(w) for w in words], rng.integers(0, 5, (0, KINDS))
    n = rng.integers(0, 5, (len(raw), KINDS))
    scale = scale_of(1e6)
    codes = rng.integers(0, 60, (2, int(STARTS[-1])))
    m = MixingModel((codes[0] * 256 + codes[1]).astype(np.uint16), scale, rng.normal(0.3, 0.1, N_WEIGHTS).astype(np.float32), rng.normal(size=(LEVELS, STEPS)).astype(np.float32))
    p = Prefixes(raw, n)
    counts = Counter()
    for r, c in zip(raw, n, strict=True):
        text = "".join(f"{b:08b}" for b in r)
        for j in range(len(text) + 1):
            for k in range(KINDS):
                counts[text[:j], k] += int(c[k])

    def judge(zeros, ones):
        return min(12, max(-12, np.log((ones + 0.3) / (zeros + 0.3)))), int(np.searchsorted(SEEN, zeros + ones)) * 2 + int(min(zeros, ones) == 0)

    got = np.concatenate([m.log10(e := p.edges(s.start, s.stop), behind(np.ones((s.stop - s.start, KINDS), bool), e)) for s in p.parts(25)])
    for i in rng.choice(len(raw), 25, replace=False).tolist():
        text = "".join(f"{b:08b}" for b in raw[i])
        y, slots = slots_of([raw[i]], np.repeat(np.arange(len(raw[i])), 8), np.tile(np.arange(8), len(raw[i])), 0)
        for k in range(KINDS):
            total = 0.0
            for d in range(len(text)):
                zero, one = text[:d] + "0", text[:d] + "1"
                seen = [judge(scale[codes[0][s]], scale[codes[1][s]]) for s in slots[d]]
                seen += [judge(sum(counts[zero, x] for x in range(KINDS)), sum(counts[one, x] for x in range(KINDS))), judge(counts[zero, k], counts[one, k])]
                gate = min(d // 8, 3) * LEVELS + seen[2][1]
                mixed = sum(m.weights[(gate * PREDICTORS + x) * LEVELS + level] * odds for x, (odds, level) in enumerate(seen))
                mixed = min(14, max(-14, mixed))
                final = 0.75 * mixed + 0.25 * m.refine[seen[3][1], int(step_of(np.array(mixed)))]
                total -= np.log10(1 + np.exp(-final if text[d] == "1" else final))
            assert abs(total - got[i, k]) < 1e-3 * abs(total)


def test_word_before_counts(spark):
    """Held-out texts of known words in an order that training knows are likelier than the same words shuffled."""
    rng = np.random.default_rng(2)
    follow = {i: rng.permutation(200)[:3] for i in range(200)}

    def text(n):
        at, out = int(rng.integers(200)), []
        for _ in range(n):
            out.append(f"w{at * 7919 % 1000:03d}x")
            at = int(rng.choice(follow[at]))
        return out

    rows = [(i, text(60)) for i in range(600)]
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    shuffled = [(i + 1000 * k, rng.permutation(t).tolist()) for i, t in held for k in range(1, 30) if zlib.crc32(str(i + 1000 * k).encode()) % 7 == 2]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows + shuffled], "doc_id long, text string")
    got = {r.doc_id: r for r in score(docs, block=7000, bucket=900).collect()}
    own, other = ([got[i].score for i, _ in x] for x in (held, shuffled))
    assert np.mean(own) > 0.6 * np.mean(other) and np.mean(own) > 0.6 * np.mean([got[i].base_score for i, _ in held])
    again = {r.doc_id: r.score for r in score(docs.repartition(3), block=100_000).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 * abs(r.score) for i, r in got.items())


def test_pairs_are_counted_over_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd"], int(rng.integers(0, 9))).tolist())) for i in range(80)]
    blocks = cut_blocks(spark.createDataFrame(rows, "doc_id long, text string"), 7, 2, 50).cache()
    want = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words = ["\n", *t.split(), "\n"]
            want.update(zip(words, words[1:], strict=False))
    times = {}
    for r in pair_counts(blocks, 5).orderBy("bucket").collect():
        times.setdefault(r.block, []).append(from_planes(zlib.decompress(r.times), np.int64))
    for r in blocks.collect():
        tokens = [bytes(t) for t in r.tokens]
        a, b, _, _ = pairs_in(codes_of(r.codes), hashes(pa.array(tokens, pa.binary())))
        assert [want[tokens[x].decode(), tokens[y].decode()] for x, y in zip(a, b, strict=True)] == np.concatenate(times[r.block]).tolist()


def test_probabilities_after_a_word_add_up_to_one():
    for a, b in CHOICES:
        p = after_word(np.log([0.5, 0.3, 0.2]), np.array([3, 0, 1]), np.array([4, 4, 4]), a, b)
        assert abs(np.exp(p).sum() - 1) < 1e-12
