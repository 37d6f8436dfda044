from collections import Counter

import corpus_pipeline
from spanloom.llm.mixing import with_copies
from spanloom.llm.quality import fit_quality, score_documents
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.toxicity import fit_toxicity, score_toxicity

from .test_ngram_join import brute
from .test_packing import held, library  # noqa: F401


def test_stages_do_what_their_operators_say(spark, sf, tmp_path, library):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == docs.columns
        before, after = [r.doc_id for r in docs.collect()], Counter(r[0] for r in out.collect())
        if name == "quality":
            want = {r.doc_id for r in score_documents(docs, fit_quality(docs, labels)).collect() if r.predicted}
            assert set(after) == want and len(after) < len(before)
        elif name == "toxicity":
            want = {r.doc_id for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect() if not r.predicted}
            assert set(after) == want
        elif name == "near_duplicates":
            groups = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert after == Counter({c for _, _, c in groups})
        elif name == "mixture":
            assert after == +Counter({r.doc_id: r.copies for r in with_copies(docs).collect()})
        else:
            held(out.collect(), [(r.doc_id, r.text) for r in docs.collect()], library)
        docs = out


def test_run_and_odd_rows(spark, sf, odd, empty, clashing):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for docs in (odd, clashing, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.collect()
            assert name == "packing" or out.columns == docs.columns
    assert tokenizer_path()


def test_near_duplicates_keep_one_of_repeated_rows(spark, odd):
    kept = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, "").collect())
    assert kept == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1})
