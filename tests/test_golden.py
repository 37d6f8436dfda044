"""Hand cases with known results."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as fs
from spanloom.functions import text as ft
from spanloom.operators import evaluate as ev
from spanloom.operators import learn
from spanloom.operators import lexicon as lx
from spanloom.operators import resampling as rs
from spanloom.operators import sampling as sm
from spanloom.operators import scorecard as sc
from spanloom.operators import similarity as si
from spanloom.operators import spans as sp
from spanloom.operators import stats as st
from spanloom.operators import vectors as vc

KEY = "sid int, s int, e int, type string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(spans):
    return F.expr("CAST(array(" + ",".join(f"named_struct('s',{s},'e',{e},'type','{t}')" for s, e, t in spans) + ") AS array<struct<s:int,e:int,type:string>>)")


def words(text):
    return F.array(*[F.lit(w) for w in text.split()])


@pytest.mark.parametrize(
    ("labels", "spans", "repaired"),
    [("B-X I-X O", [(0, 2, "X")], 0), ("I-X I-X", [(0, 2, "X")], 1), ("B-X I-Y", [(0, 1, "X"), (1, 2, "Y")], 1), ("B-X B-X", [(0, 1, "X"), (1, 2, "X")], 0), ("O B-X", [(1, 2, "X")], 0), ("O", [], 0)],
)
def test_bio(spark, labels, spans, repaired):
    got = one(spark, fs.bio_to_spans(words(labels)))
    assert [tuple(x) for x in got.spans] == spans and got.repaired == repaired
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels.split())], "sid int, pos int, label string")
    assert sorted((r.s, r.e, r.type) for r in sp.bio_spans(rows).collect()) == spans
    back = one(spark, fs.spans_to_bio(lit(spans) if spans else F.array().cast(fs.SPANS), F.lit(len(labels.split()))))
    again = one(spark, fs.bio_to_spans(F.array(*[F.lit(x) for x in back])))
    assert [tuple(x) for x in again.spans] == spans and again.repaired == 0


def test_error_labels(spark):
    gold = spark.createDataFrame([(1, 0, 2, "Disease"), (1, 5, 6, "Chemical")], KEY)
    pred = [(0, 2, "Disease"), (0, 2, "Chemical"), (1, 2, "Disease"), (1, 3, "Chemical"), (3, 4, "Disease")]
    got = {(r.s, r.e, r.type): r.label for r in ev.error_labels(gold, spark.createDataFrame([(1, *p) for p in pred], KEY)).collect()}
    assert [got[p] for p in pred] == ["correct", "type_error", "boundary_error", "boundary_type_error", "spurious"]


def test_prf(spark):
    r = spark.createDataFrame([(1198, 464, 767), (0, 0, 0)], "tp int, fp int, fn int").select("tp", *ev.prf()).collect()
    a = next(x for x in r if x.tp)
    assert (round(a.precision, 5), round(a.recall, 5), round(a.f1, 5)) == (0.72082, 0.60967, 0.6606)
    assert [tuple(x)[1:] for x in r if not x.tp] == [(0.0, 0.0, 0.0)]


def test_strata_and_index(spark):
    rows = [("aspirin", "Chemical")] * 3 + [("cold", "Disease")]
    index = lx.surface_index(spark.createDataFrame([(i, 0, 1, t, s, i) for i, (s, t) in enumerate(rows)], "sid int, s int, e int, type string, surface string, pos int"))
    q = spark.createDataFrame([("Aspirin", "Chemical"), ("cold", "Chemical"), ("ibuprofen", "Chemical"), ("the", "Disease")], "surface string, type string")
    assert [r.stratum[0] for r in sorted(lx.strata(q, index).collect(), key=lambda r: r.surface)] == ["A", "B", "C", "C"]


def test_entity_of_span(spark):
    tokens = words("Renal failure after 5-FU ( FU )")
    entities = F.expr("array(named_struct('text','renal failure','type','Disease','confidence',0.7D), named_struct('text','5-FU (FU)','type','Chemical','confidence',0.4D))")
    got = [one(spark, fs.entity_of(tokens, F.expr(f"named_struct('s',{s},'e',{e},'type','{t}')"), entities)) for s, e, t in [(0, 2, "Disease"), (3, 7, "Chemical"), (0, 2, "Chemical")]]
    assert [g and g.confidence for g in got] == [0.7, 0.4, None]


@pytest.mark.parametrize(("y", "s", "want"), [((1, 1, 0, 0), (0.9, 0.8, 0.2, 0.1), 1), ((1, 1, 0, 0), (0.1, 0.2, 0.8, 0.9), 0), ((1, 1, 0, 0), (0.5,) * 4, 0.5), ((1, 1, 0, 0), (0.9, 0.3, 0.3, 0.1), 0.875), ((1, 1), (0.1, 0.2), None)])
def test_auroc(spark, y, s, want):
    assert st.auroc(spark.createDataFrame(list(zip(y, s, strict=True)), "y int, score double")).first().auroc == want


def test_auroc_mirrors(spark):
    df = spark.range(200).select((F.hash("id") % 7 / 7.0).alias("score"), (F.hash(F.col("id") + 1) % 2 == 0).cast("int").alias("y"))
    a = st.auroc(df).first().auroc
    assert st.auroc(df.withColumn("score", -F.col("score"))).first().auroc == pytest.approx(1 - a)
    assert st.cliffs_delta(df).first().delta == pytest.approx(2 * a - 1)


def test_decisions_and_filter(spark):
    d = ["passed", "passed", "needs_review", "failed", "passed"]
    r = st.decision_metrics(spark.createDataFrame(list(zip(d, [1, 0, 1, 0, 1], strict=True)), "decision string, y int")).first()
    assert (r.p_correct_given_passed, r.false_acceptance, r.false_rejection, r.p_incorrect_given_failed) == (pytest.approx(2 / 3), 0.5, pytest.approx(1 / 3), 1)
    f = st.filter_effect(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "keep int, y int"), "keep", "y", 4).first()
    assert tuple(f)[:2] == (0.5, 0.5) and tuple(f)[3:5] == (0.5, 0.25)


def test_calibration(spark):
    r = st.calibration_summary(spark.createDataFrame([(0.05, 0), (0.05, 0), (0.95, 1), (0.95, 1)], "p double, y int")).first()
    assert (round(r.ece, 6), round(r.brier, 6)) == (0.05, 0.0025)


def test_cliffs_delta(spark):
    for a, b, want in (((3, 4), (1, 2), 1), ((1, 2), (1, 2), 0)):
        rows = [(float(x), 1) for x in a] + [(float(x), 0) for x in b]
        assert st.cliffs_delta(spark.createDataFrame(rows, "score double, y int")).first().delta == want


def test_decision_rules(spark):
    rows = [(0.8, 1.0, True), (0.6, 1.0, True), (0.3, 1.0, True), (0.9, 0.3, True), (0.9, 1.0, False)]
    df = spark.createDataFrame(rows, "o double, c double, t boolean").select(sc.decide(F.col("o"), F.col("c"), F.col("t")).alias("d"), sc.review(F.col("o"), F.col("c"), F.col("t"), F.lit(None).cast("boolean"), F.lit(0.5))["status"].alias("r"))
    assert [r.d for r in df.collect()] == ["passed", "needs_review", "failed", "failed", "failed"]
    assert [r.r for r in df.collect()] == ["passed", "needs_review", "needs_review", "failed", "failed"]


def test_simplex(spark):
    g = rs.simplex(spark, 0.25, 5).collect()
    assert len(g) == 70 and all(math.isclose(sum(r[1:]), 1) for r in g) and sorted(r.ord for r in g) == list(range(70))


def test_baselines(spark):
    df = spark.createDataFrame([(0.7, True, 0.9, "A_seen_same_type"), (None, False, 0.6, "B_seen_other_type"), (0.2, None, None, "C_unseen")], "c double, a boolean, p double, s string")
    got = df.select(*sc.baselines(*[F.col(x) for x in "caps"])).collect()
    assert [tuple(r) for r in got] == [(0.7, 0.9, 1.0), (0.5, -0.6, 0.0), (0.2, 0.0, 0.0)]


def test_holm(spark):
    p = [0.01, 0.04, 0.03, None]
    got = {r.i: r.p_holm for r in st.holm(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    assert [got[0], got[1], got[2], got[3]] == [pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.06), None]


def test_chi2_tail():
    assert st.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert st.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert st.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert st.chi2_tail(0, 3) == 1


def test_text(spark):
    assert one(spark, ft.tokenize(F.lit("Beta-blocker's (p<0.05), über‑alles."))) == ["Beta-blocker's", "(", "p", "<", "0", ".", "05", ")", ",", "über‑alles", "."]
    assert one(spark, ft.detokenize(words("A ( b ) , c ."))) == "A (b), c."
    assert one(spark, ft.detokenize(F.array().cast("array<string>"))) == ""
    assert one(spark, ft.normalize_mention(F.lit(" Non‑Small  CELL lung "))) == "non-small cell lung"
    assert one(spark, ft.normalize_label(F.lit("É-coli (O157)"))) == "coli o157"
    assert one(spark, ft.normalize_entity_type(F.lit("ImagingProcedure"))) == "imaging_procedure"
    assert one(spark, ft.normalize_entity_type(F.lit("drug"), {"drug": "substance"})) == "substance"
    assert one(spark, ft.normalize_iob_label(F.lit("b-Drug"))) == "B-substance"
    assert one(spark, ft.normalize_iob_label(F.lit("I-AdverseEvent"))) == "I-adverse_event"
    assert one(spark, ft.trigrams(F.lit("ab"))) == ["  a", " ab", "ab "]
    assert one(spark, ft.uri_local_name(F.lit("http://x/y#Z"))) == "Z"


def test_parse_response(spark):
    cases = {"": "empty", "none": "invalid_json", '{"a":1}': "no_entities_field", "{bad}": "invalid_json"}
    for content, error in cases.items():
        assert one(spark, ft.parse_response(F.lit(content))).error == error
    got = one(spark, ft.parse_response(F.lit('x {"entities":[{"text":"a","type":"T","confidence":1.7},{"text":"b","confidence":true},3]} y')))
    assert [(e.text, e.type, e.confidence) for e in got.entities] == [("a", "T", 1.0), ("b", None, None)]


def test_align_and_greedy(spark):
    tokens = words("The Renal failure and renal failure")
    assert [tuple(x) for x in one(spark, fs.align(tokens, F.lit("renal failure"), F.lit("D")))] == [(4, 6, "D")]
    assert [tuple(x) for x in one(spark, fs.align(tokens, F.lit("RENAL FAILURE"), F.lit("D")))] == [(1, 3, "D"), (4, 6, "D")]
    assert one(spark, fs.align(tokens, F.lit(" "), F.lit("D"))) == []
    got = one(spark, fs.non_overlapping(lit([(0, 2, "a"), (1, 4, "b"), (4, 5, "c"), (0, 2, "b"), (1, 4, "b")])))
    assert [tuple(x) for x in got] == [(1, 4, "b"), (4, 5, "c")]
    assert one(spark, fs.lenient_matches(lit([(0, 3, "X"), (5, 6, "X")]), lit([(1, 2, "X"), (2, 3, "X"), (5, 7, "Y")]))) == 1


def test_greedy_is_disjoint_and_maximal(spark):
    import random

    rng = random.Random(1)
    for _ in range(15):
        c = [(s := rng.randrange(20), s + rng.randint(1, 6), rng.choice("XY")) for _ in range(12)]
        got = [tuple(x) for x in one(spark, fs.non_overlapping(lit(c)))]
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        assert all(any(x[0] < g[1] and g[0] < x[1] for g in got) for x in c)


def test_source_of_unaligned(spark):
    entities = F.expr("array(named_struct('text',' x ','type','A'), named_struct('text','x','type','B'))")
    assert one(spark, fs.source_of(F.lit("x"), F.lit("B"), entities)).type == "B"
    assert one(spark, fs.source_of(F.lit("y"), F.lit("B"), entities)) is None


def test_chars_to_tokens(spark):
    tokens = words("ab cde f")
    assert tuple(one(spark, fs.chars_to_tokens(tokens, F.lit(1), F.lit(4)))) == (0, 2)
    assert one(spark, fs.chars_to_tokens(tokens, F.lit(2), F.lit(3))) is None


def test_pieces(spark):
    text = "Lung cancer-like pain"
    rows = [("Lung", 0, 4, "B-d", 0.9), ("can", 5, 8, "I-d", 0.8), ("##cer", 8, 11, "B-d", 0.7), ("-", 11, 12, "O", 0.9), ("like", 12, 16, "B-d", 0.5), ("pain", 17, 21, "B-s", 0.6)]
    df = spark.createDataFrame([("x", i, s, e, t, lb, p, text) for i, (t, s, e, lb, p) in enumerate(rows)], "sid string, i int, start int, end int, token string, label string, p double, text string")
    got = sorted((r.start, r.end, r.type, r.text, round(r.confidence, 6)) for r in sp.pieces_to_spans(df).collect())
    assert got == [(0, 16, "d", "Lung cancer-like", 0.725), (17, 21, "s", "pain", 0.6)]


def test_similarity(spark):
    from difflib import SequenceMatcher

    labels = spark.createDataFrame([("heart attack", "u1", ["disease"]), ("heart", "u2", ["organ"]), ("hart attack", "u1", ["disease"]), ("tide", "u3", ["x"])], "label string, uri string, kinds array<string>")
    q = spark.createDataFrame([("heart attack", "disease"), ("heart attac", None), ("diet", "x")], "q string, kind string")
    got = {(r.q, r.kind, r.uri): r.similarity for r in si.find_matches(q, labels, 10, 0.3).collect()}
    assert got["heart attack", "disease", "u1"] == 1.0
    assert got["heart attac", None, "u1"] == pytest.approx(SequenceMatcher(None, "heart attac", "heart attack").ratio())
    assert got["diet", "x", "u3"] == SequenceMatcher(None, "diet", "tide").ratio()
    words_ = ["".join(chr(97 + (i * j + j) % 5) for j in range(3 + i % 9)) for i in range(60)]
    many = spark.createDataFrame([(w, f"u{i}", ["x"]) for i, w in enumerate(words_)], labels.schema)
    asked = sorted(set(words_[:20]))
    want = {(a, f"u{i}") for a in asked for i, b in enumerate(words_) if max(SequenceMatcher(None, a, b).ratio(), min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0) >= 0.7}
    got = si.find_matches(spark.createDataFrame([(a, "x") for a in asked], "q string, kind string"), many, 1000, 0.7).collect()
    assert {(r.q, r.uri) for r in got} == want


def test_validation(spark):
    labels = spark.createDataFrame([("heart attack", "u1", ["disease"]), ("aspirin", "u2", ["substance"])], "label string, uri string, kinds array<string>")
    e = spark.createDataFrame([("Heart attack", "disease"), ("aspirins", "disease"), ("zzz", "disease"), ("Aspirin", None)], "text string, kind string")
    got = {r.text: r.status for r in si.validate_entities(e, labels).collect()}
    assert got == {"Heart attack": "matched", "aspirins": "partial", "zzz": "novel", "Aspirin": "matched"}
    assert {r.q: r.uri for r in si.search_entities(e, labels).where("rank = 1").collect()}["aspirins"] == "u2"


def test_quotas(spark):
    def quotas(sizes, n):
        return {r.stratum: r.quota for r in sm.allocate(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), n).collect()}

    q = quotas({"a": 50, "b": 30, "c": 1}, 10)
    assert sum(q.values()) == 10 and q["c"] == 1 and q["a"] >= q["b"]
    assert quotas({"a": 2}, 5) == {"a": 2}
    assert quotas({"a": 34, "b": 33, "c": 33}, 10) == {"a": 4, "b": 3, "c": 3}
    assert quotas({"a": 33, "b": 33, "c": 33}, 10) == {"a": 4, "b": 3, "c": 3}
    # one row for each small stratum; the two largest pay for it
    assert quotas({"a": 500, "b": 400, **{f"s{i}": 1 for i in range(6)}}, 10) == {"a": 2, "b": 2, **{f"s{i}": 1 for i in range(6)}}
    assert quotas({"a": 500, "b": 400, **{f"s{i}": 1 for i in range(5)}}, 10) == {"a": 2, "b": 3, **{f"s{i}": 1 for i in range(5)}}
    assert sum(quotas({f"s{i}": 1 for i in range(9)}, 4).values()) == 4
    rng = np.random.default_rng(5)
    for _ in range(6):
        sizes = {f"s{i:02d}": int(v) for i, v in enumerate(rng.integers(1, rng.choice([3, 50, 2000]), rng.integers(1, 25)))}
        total = sum(sizes.values())
        n = int(rng.integers(1, total + 2))
        q = quotas(sizes, n)
        assert sum(q.values()) == min(n, total) and all(0 <= q[k] <= sizes[k] for k in sizes)
        wanted = {k: max(1, n * v // total) for k, v in sizes.items()}
        if n < total and sum(wanted.values()) <= n:
            more = [k for k in sizes if q[k] > wanted[k]]
            rest = {k: (-(n * v % total), k) for k, v in sizes.items() if wanted[k] < v}
            assert all(q[k] - wanted[k] in (0, 1) for k in sizes) and set(more) == set(sorted(rest, key=rest.get)[: len(more)])
        elif n < total:
            cut = [q[k] for k in sizes if q[k] < wanted[k]]
            assert all(q[k] <= wanted[k] for k in sizes) and max(cut) - min(cut) <= 1 and max(q.values()) <= min(cut) + 1


def test_numbers_in_order(spark):
    from spanloom.operators.numbering import with_number

    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("n"))
    assert [(r.v, r.at) for r in with_number(df, "v", name="at").orderBy("v").collect()] == [(i, i) for i in range(5000)]
    rows = with_number(df, F.desc("n"), "v", name="at").orderBy("at").collect()
    assert [r.at for r in rows] == list(range(5000)) and rows == sorted(rows, key=lambda r: (-r.n, r.v))
    assert with_number(df.limit(0), "v").collect() == []


def test_stratified(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 < 7, "x").when(F.col("id") % 10 < 9, "y").alias("k"))
    rows = sm.stratified(df, "k", "id", 200).collect()
    kept = {}
    for r in rows:
        kept.setdefault(r.k, []).append(r.id)
    assert {k: len(v) for k, v in kept.items()} == {"x": 140, "y": 40, None: 20}
    every = {}
    for i in range(3000):
        every.setdefault("x" if i % 10 < 7 else "y" if i % 10 < 9 else None, []).append(i)
    for k, ids in kept.items():
        assert sorted(ids) == sorted(sorted(every[k], key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))[: len(ids)])
    assert sm.stratified(df.limit(0), "k", "id", 5).collect() == []


def test_vectors(spark):
    v = one(spark, vc.mean_pool(F.expr("array(array(3D,0D), array(0D,4D), array(9D,9D))"), F.expr("array(1,1,0)")))
    assert v == pytest.approx([0.6, 0.8])


def test_learned_scorers(spark):
    df = spark.range(300).select((F.col("id") % 10 / 10.0).alias("x"), (F.hash("id") % 5 / 5.0).alias("z"), (F.col("id") % 10 >= 5).cast("int").alias("y"), (F.col("id") % 30).alias("g"))
    p = learn.out_of_fold(df, ["x", "z"], "g", folds=3)
    assert p.count() == 300 and st.auroc(p, "p").first().auroc > 0.95
    iso = learn.apply_isotonic(learn.fit_isotonic(df, "x"), df, "x").groupBy("x").agg(F.min("calibrated").alias("c")).orderBy("x").collect()
    assert all(a.c <= b.c for a, b in zip(iso, iso[1:], strict=False))
    assert learn.same_predictions(p.select("g", "x", "p").limit(0).withColumn("k", F.lit(1)), p.limit(0).withColumn("k", F.lit(1)), "k").first().rows == 0


def test_config_checks():
    sc.check_config(sc.WEIGHTS, sc.THRESHOLDS, sc.SETTINGS)
    for w, t, s in (({**sc.WEIGHTS, "coverage": 0.5}, sc.THRESHOLDS, sc.SETTINGS), (sc.WEIGHTS, {"pass": 0.5, "review": 0.5}, sc.SETTINGS), (sc.WEIGHTS, sc.THRESHOLDS, {**sc.SETTINGS, "coverage_novelty_bonus": 0.6})):
        with pytest.raises(ValueError):
            sc.check_config(w, t, s)
    assert sc.with_defaults({"constraint_min_length": 5, "consistency_base_score": None})["consistency_base_score"] == 0.5
