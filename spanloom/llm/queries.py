"""The queries of this subpackage and their SQL. Each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies; the file itself is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .threshold_search import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_cap_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cap_filters import link

    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_boundary_chain_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_ngram_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import score

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ring_sharding import shard_documents

    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def op10_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import with_copies

    return with_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_code_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .code_books import compress

    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import judge

    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def _rounds(n: int) -> str:
    """CTEs a0..an (each part's nearest entry and squared distance) and b1..bn (the codebooks after a round), from p (parts) and b0."""
    out = []
    for r in range(n + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT row, part, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'entry': entry}}) AS best FROM p JOIN b{r} USING (part) GROUP BY ALL),
        """)
        if r < n:
            out.append(f"""s{r} AS (SELECT part, entry, list(v ORDER BY i) AS c FROM (SELECT a.part, a.best.entry AS entry, i, floor(sum(x[i]) / count(*)) AS v FROM a{r} a JOIN p USING (row, part), unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL) GROUP BY ALL),
        b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.c, b.c) AS c FROM b{r} b LEFT JOIN s{r} s USING (part, entry)),
        """)
    return "".join(out)


ORACLES: dict[str, str] = {
    # integers below 2^53 are exact in doubles
    "op11_code_books": f"""
        WITH k AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (SELECT row, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] AS x FROM k, unnest(range(4)) t(part)),
        b0 AS MATERIALIZED (SELECT part, row AS entry, x AS c FROM p WHERE row < 256),
        {_rounds(4)}
        e AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY row),
        h AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b4, unnest(range(1, len(c) + 1)) t(i))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (row), h""",
    "op3_threshold_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_ngram_prefix_tree": """
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM t),
        n AS (SELECT t.doc_id, count(s) AS n FROM t LEFT JOIN g USING (doc_id) GROUP BY t.doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
        r(doc_id, there) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.there = l.a)
        SELECT doc_id, any_value(n) AS n_shingles, min(there) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id""",
    "op9_cap_filter_dedup": """
        WITH RECURSIVE u AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r(vec_id, there) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.there = l.a)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(there) AS component_id, vec_id = min(there) AS kept FROM r GROUP BY vec_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
