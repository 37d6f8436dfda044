"""The jobs as queries: each runs twice into a new folder, which stays, and returns the whole output as the second run leaves it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import annotate_texts, build_prompts

from ..sources.sinks import shared_folder
from .catalogue import TOKENS_SQL, greedy_sql, query

_NORM = "list_transform({0}, lambda x: trim(regexp_replace(translate(lower(x), '‑–', '--'), '\\s+', ' ', 'g')))".format(TOKENS_SQL)


@query(f"""WITH t AS MATERIALIZED (SELECT DISTINCT doc_id, coalesce(text, '') AS text, source, coalesce(nullif(lang, ''), 'unknown') AS lang FROM documents),
    w AS MATERIALIZED (SELECT doc_id, source, lang, {_NORM} AS w FROM t), b AS (SELECT item_id, {_NORM} AS w FROM benchmark),
    d AS (SELECT doc_id, i - 1 AS s, array_to_string(w[i:i + 5], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM w)),
    k AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS type, array_to_string(w[i:i + 5], ' ') AS key FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM b)),
    h AS (SELECT DISTINCT doc_id AS sid, type, s FROM d JOIN k USING (key) WHERE regexp_matches(key, '[\\p{{L}}\\p{{N}}]')),
    n AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY sid, type ORDER BY s) + 6 THEN 1 ELSE 0 END AS new FROM h),
    m AS (SELECT *, sum(new) OVER (PARTITION BY sid, type ORDER BY s) AS nth FROM n),
    u AS (SELECT sid, type, min(s) AS s, max(s) + 6 AS e FROM m GROUP BY sid, type, nth),
    g AS ({greedy_sql('u', 's - e, s, type')}),
    a AS (SELECT sid, CAST(sum(e - s) AS INTEGER) AS n_tagged, string_agg(s || '-' || e || ':' || type, ' ' ORDER BY s) AS spans FROM g GROUP BY sid)
    SELECT doc_id, source, lang, CAST(len(w) AS INTEGER) AS n_tokens, coalesce(n_tagged, 0) AS n_tagged, coalesce(spans, '') AS spans, coalesce(n_tagged, 0) > 0.05 * len(w) AS held_back FROM w LEFT JOIN a ON doc_id = sid""")
def job1_annotate_texts(spark, sf):
    at = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        annotate_texts.run(spark, documents=f"{sf}/documents.parquet", passages=f"{sf}/benchmark.parquet", output=f"{at}/output", checkpoint=f"{at}/checkpoint")
    rows = spark.read.schema(annotate_texts.RECORD).parquet(f"{at}/output/annotations")
    text = F.array_join(F.transform("spans", lambda x: F.format_string("%d-%d:%s", x["s"], x["e"], x["type"])), " ")
    return rows.select("doc_id", "source", "lang", "n_tokens", "n_tagged", text.alias("spans"), "held_back")


@query("""WITH t AS (SELECT doc_id, text, coalesce(lang, 'none') AS lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS k FROM documents WHERE doc_id IS NOT NULL AND trim(text) <> ''),
    j AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id),
    f AS MATERIALIZED (SELECT t.*, quality, toxic, j.doc_id IS NOT NULL AS known, count(*) OVER (PARTITION BY k) AS copies FROM t LEFT JOIN j USING (doc_id) QUALIFY row_number() OVER (PARTITION BY k ORDER BY j.doc_id IS NULL, t.doc_id) = 1),
    p AS (SELECT *, lang || '/' || quality || '/' || toxic AS kind, md5('7|' || doc_id) AS h FROM f WHERE known AND length(text) <= 800 AND quality IS NOT NULL AND toxic IS NOT NULL
        AND NOT EXISTS (FROM benchmark b WHERE trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(f.text), '\\s+', ' ', 'g')))),
    z AS (SELECT kind, count(*) AS size, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM p GROUP BY kind),
    b AS (SELECT *, greatest(1, 40 * size // total) AS q, 40 * size % total AS rest FROM z), m AS (SELECT 40 - sum(q) AS missing, max(q) AS most FROM b),
    r AS (SELECT *, row_number() OVER (ORDER BY q < size DESC, rest DESC, kind) AS rank FROM b), l AS (SELECT max(level) AS level FROM m, unnest(range(most + 1)) t(level) WHERE (SELECT sum(greatest(0, q - level)) FROM b) >= -missing AND missing < 0),
    c AS (SELECT r.*, missing, level, row_number() OVER (PARTITION BY q > level ORDER BY kind DESC) AS late, (SELECT sum(greatest(0, q - level)) FROM b) + missing AS back FROM r, m, l),
    a AS (SELECT kind, CASE WHEN total <= 40 THEN size WHEN missing >= 0 THEN q + CAST(q < size AND rank <= missing AS INTEGER) WHEN q > level THEN level + CAST(late <= back AS INTEGER) ELSE q END AS quota FROM c),
    x AS (SELECT p.*, quota FROM p JOIN a USING (kind) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY h, doc_id) <= quota),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) <= 3),
    s AS (SELECT lang, count(*) AS shown, string_agg('[USER]' || chr(10) || text || chr(10) || chr(10) || '[ASSISTANT]' || chr(10) || '{"quality":' || quality || ',"toxic":' || toxic || '}' || chr(10) || chr(10), '' ORDER BY h, doc_id) AS turns FROM y GROUP BY lang),
    n AS (SELECT *, row_number() OVER (ORDER BY lang, doc_id) - 1 AS n FROM f WHERE NOT known)
    SELECT doc_id, n.lang, copies, n // 100 AS batch, CAST(n % 100 AS INTEGER) AS position, CAST(coalesce(shown, 0) AS INTEGER) AS shown,
    md5('[SYSTEM]' || chr(10) || 'Judge the text. Answer with JSON: {"quality": 0 or 1, "toxic": 0 or 1}.' || chr(10) || chr(10) || coalesce(turns, '') || '[USER]' || chr(10) || text) AS prompt_md5, n // 5000 AS part FROM n LEFT JOIN s USING (lang)""")
def job2_build_prompts(spark, sf):
    at = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        build_prompts.run(spark, documents=f"{sf}/documents.parquet", labels=f"{sf}/labels.parquet", passages=f"{sf}/benchmark.parquet", output=at)
    return spark.read.schema(build_prompts.PROMPT).json(f"{at}/prompts").withColumn("prompt_md5", F.md5("prompt")).drop("prompt")
