"""Queries on similar names, and the matching-block ratio in SQL: a recursion over stretches of both texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import lexicon as lx
from ..operators import similarity as si
from ..operators.cells import nearest_in_cells
from .catalogue import KNN, TRI, labels_of, query, six, table


def ratio_sql(name: str, pairs: str) -> str:
    """CTEs of ``name`` (q, label, ratio) from ``pairs`` (q, label): m is the longest common stretch of a part of both, as [size, -start, -start]."""
    stretch = "list_max(list_filter(range(0, least(ah - i, bh - j) + 1), lambda n: q[i:i + n - 1] = label[j:j + n - 1]))"
    best = f"list_max(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j: [{stretch}, -i, -j]))))"
    return f"""{name}_s AS (SELECT q, label, {best} AS m, al, ah, bl, bh FROM (SELECT DISTINCT q, label, 1 AS al, length(q) + 1 AS ah, 1 AS bl, length(label) + 1 AS bh FROM {pairs})
        UNION ALL SELECT q, label, {best} AS m, al, ah, bl, bh FROM (SELECT q, label, unnest([{{'al': al, 'ah': -m[2], 'bl': bl, 'bh': -m[3]}}, {{'al': m[1] - m[2], 'ah': ah, 'bl': m[1] - m[3], 'bh': bh}}], recursive := true) FROM {name}_s WHERE m[1] > 0) WHERE ah > al AND bh > bl),
        {name} AS (SELECT q, label, 2.0 * sum(coalesce(m[1], 0)) / (length(q) + length(label)) AS ratio FROM {name}_s GROUP BY q, label)"""


def label_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def near_sql(queries: str, least: float) -> str:
    """CTEs up to ``s`` (q, label, similarity): pairs of ``queries`` and part names with at least this similarity."""
    return f"""RECURSIVE l AS (SELECT DISTINCT {label_sql('p_name')} AS label, 'urn:' || md5(p_name) AS uri FROM part), q AS ({queries}),
        p AS (SELECT q, label FROM q, (SELECT DISTINCT label FROM l) WHERE q <> '' AND label <> '' AND 2 * least(length(q), length(label)) >= {least} * (length(q) + length(label)) - 1e-9), {ratio_sql('r', 'p')},
        s AS (SELECT q, label, greatest(ratio, CASE WHEN contains(q, label) OR contains(label, q) THEN CAST(least(length(q), length(label)) AS DOUBLE) / greatest(length(q), length(label)) ELSE 0 END) AS similarity FROM r),
        t AS (SELECT q, uri, arg_min(s.label, (-similarity, s.label)) AS label, max(similarity) AS similarity FROM s JOIN l USING (label) WHERE similarity >= {least} GROUP BY q, uri),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY similarity DESC, label, uri) AS INTEGER) AS rank FROM t)"""


@query(f"""WITH {near_sql(f"SELECT DISTINCT {label_sql("split_part(p_name, ' ', 1) || ' ' || substr(p_type, 1, 5)")} AS q FROM part", 0.5)} SELECT q, 'part' AS kind, uri, label, round(similarity, 6) AS similarity, rank FROM k WHERE rank <= 3""")
def similarity_topk(spark, sf):
    q = table(spark, sf, "part").select(ft.normalize_label(F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), F.substring("p_type", 1, 5))).alias("q"), F.lit("part").alias("kind"))
    return six(si.find_matches(q.distinct(), labels_of(spark, sf), 3, 0.5))


@query(f"""WITH {near_sql(f"SELECT DISTINCT {label_sql('p_name || substr(p_type, 1, 1)')} AS q FROM part", 0.7)}, v AS (SELECT DISTINCT p_name || substr(p_type, 1, 1) AS text FROM part)
    SELECT text, CASE WHEN similarity >= 0.95 THEN 'matched' WHEN similarity >= 0.7 THEN 'partial' ELSE 'novel' END AS status, label, round(similarity, 6) AS similarity FROM v LEFT JOIN k ON k.q = {label_sql('text')} AND rank = 1""")
def entity_validation(spark, sf):
    rows = table(spark, sf, "part").select(F.concat(F.col("p_name"), F.substring("p_type", 1, 1)).alias("text"), F.lit("part").alias("kind")).distinct()
    return six(si.validate_entities(rows, labels_of(spark, sf)).select("text", "status", "label", "similarity"))


@query(f"""WITH {near_sql(f"SELECT DISTINCT {label_sql("split_part(p_name, ' ', 1)")} AS q FROM part UNION SELECT DISTINCT {label_sql('p_type')} FROM part UNION SELECT DISTINCT substr({label_sql('p_type')}, 1, 2) FROM part", 0.5)},
    h AS (SELECT q, uri, label, 1 + CAST(length(q) AS DOUBLE) / length(label) AS similarity FROM q JOIN l ON contains(label, q) WHERE q <> '' UNION ALL SELECT q, uri, label, similarity FROM k WHERE rank <= 10),
    b AS (SELECT q, uri, arg_min(label, (-similarity, label)) AS label, max(similarity) AS similarity FROM h GROUP BY q, uri)
    SELECT q, label, uri, round(CASE WHEN similarity > 1 THEN similarity - 1 ELSE similarity END, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q ORDER BY b.similarity DESC, label, uri) AS INTEGER) AS rank FROM b QUALIFY rank <= 10""")
def entity_search(spark, sf):
    part = table(spark, sf, "part")
    texts = part.select(F.element_at(F.split("p_name", " "), 1).alias("text")).union(part.select("p_type")).union(part.select(F.substring(ft.normalize_label(F.col("p_type")), 1, 2)))
    return six(si.search_entities(texts, labels_of(spark, sf)).drop("kind"))


@query(f"""WITH b AS (SELECT DISTINCT {label_sql('text')} AS q FROM benchmark), d AS (SELECT {label_sql('text')} AS label, doc_id FROM documents) SELECT md5(q) AS passage, doc_id FROM b JOIN d ON contains(label, q) WHERE q <> ''""")
def texts_that_hold(spark, sf):
    """Documents that hold a whole passage, once both are plain: whole texts as queries and labels."""
    q = table(spark, sf, "benchmark").select(ft.normalize_label(F.col("text")).alias("q"), F.lit(None).cast("string").alias("kind")).distinct()
    labels = table(spark, sf, "documents").select(ft.normalize_label(F.col("text")).alias("label"), F.col("doc_id").alias("uri"))
    return si.holding(q, labels).select(F.md5("q").alias("passage"), F.col("uri").alias("doc_id"))


@query(f"""WITH q AS (SELECT DISTINCT lower(text) AS q FROM benchmark WHERE text <> ''), k AS (SELECT DISTINCT lower(text) AS key FROM documents WHERE length(text) >= 5), a AS MATERIALIZED (SELECT q, {TRI.format('q')} AS g FROM q), b AS MATERIALIZED (SELECT key, {TRI.format('key')} AS g FROM k),
    n AS (SELECT q, key, count(*) AS n FROM (SELECT q, unnest(g) AS g FROM a) JOIN (SELECT key, unnest(g) AS g FROM b) USING (g) GROUP BY ALL), j AS (SELECT q, key, CAST(n AS DOUBLE) / (len(a.g) + len(b.g) - n) AS similarity FROM n JOIN a USING (q) JOIN b USING (key))
    SELECT md5(q) AS passage, md5(key) AS text, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY j.similarity DESC, key) = 1""")
def trigram_fuzzy_texts(spark, sf):
    """The document whose set of trigrams is nearest to each passage's: whole texts on both sides."""
    q, k = (table(spark, sf, t).where("text <> ''").select(F.lower("text").alias(c)) for t, c in (("benchmark", "q"), ("documents", "key")))
    return six(lx.trigram_join(q, k, 0.3).select(F.md5("q").alias("passage"), F.md5("key").alias("text"), "similarity"))


@query(f"WITH {KNN} SELECT qid, pid, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, pid) AS INTEGER) AS rank FROM n QUALIFY rank <= 5")
def knn_in_cells(spark, sf):
    """The neighbours of every fiftieth vector among all others, through cells with an exact bound."""
    e = table(spark, sf, "embeddings")
    found = nearest_in_cells(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("pid"), F.col("vec_id").alias("pos"), F.col("embedding").alias("v")), 6)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return six(found.where("qid <> pid").withColumn("rank", rank).where("rank <= 5"))
