"""Queries on dictionaries with the texts they are counted in: occurrences outside mentions, and the rules that rest on them.

Mentions are stretches of benchmark texts: from each fifth token one or two tokens, typed by position. Occurrences are counted in all benchmark
texts and documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import lexicon as lx
from .catalogue import TOKENS_SQL, query, sentences


def texts(spark, sf) -> DataFrame:
    return sentences(spark, sf, "benchmark", "item_id").withColumn("sid", F.concat(F.lit("b"), "sid")).union(sentences(spark, sf, "documents", "doc_id").withColumn("sid", F.concat(F.lit("d"), "sid")))


def marked(spark, sf) -> DataFrame:
    """sid, s, e, type, surface, pos."""
    rows = sentences(spark, sf, "benchmark", "item_id").select("sid", "tokens", F.explode(F.when(F.size("tokens") >= 2, F.sequence(F.lit(0), F.size("tokens") - 2, F.lit(5)))).alias("s"))
    rows = rows.withColumn("e", F.col("s") + 1 + (F.col("s") % 2))
    kind = F.when((F.col("sid") + F.col("s")) % 7 == 0, "b").otherwise("a")
    return rows.select(F.concat(F.lit("b"), "sid").alias("sid"), "s", "e", kind.alias("type"), ft.mention_text(F.col("tokens"), F.col("s"), F.col("e")).alias("surface"), (F.col("sid") * 100000 + F.col("s")).alias("pos"))


NORM = "list_transform({0}, lambda x: trim(regexp_replace(translate(lower(x), '‑–', '--'), '\\s+', ' ', 'g')))"
INDEX_SQL = f"""b AS MATERIALIZED (SELECT item_id, {NORM.format(TOKENS_SQL)} AS w FROM benchmark WHERE text IS NOT NULL),
    m AS MATERIALIZED (SELECT 'b' || item_id AS sid, s, s + 1 + s % 2 AS e, CASE WHEN (item_id + s) % 7 = 0 THEN 'b' ELSE 'a' END AS type, array_to_string(w[s + 1:s + 1 + s % 2], ' ') AS key, item_id * 100000 + s AS pos FROM (SELECT *, unnest(range(0, len(w) - 1, 5)) AS s FROM b)),
    a AS MATERIALIZED (SELECT 'b' || item_id AS sid, w FROM b UNION ALL SELECT 'd' || doc_id, {NORM.format(TOKENS_SQL)} FROM documents WHERE text IS NOT NULL),
    p AS (SELECT sid, w, unnest(range(len(w))) AS s FROM a),
    v AS MATERIALIZED (SELECT sid, s, s + 1 AS e, w[s + 1] AS key FROM p UNION ALL SELECT sid, s, s + 2, w[s + 1] || ' ' || w[s + 2] FROM p WHERE s + 2 <= len(w)),
    o AS (SELECT key, count(*) AS o FROM v ANTI JOIN m USING (sid, s, e) WHERE regexp_matches(key, '[\\p{{L}}\\p{{N}}]') GROUP BY key),
    t AS (SELECT key, type, count(*) AS n, min(pos) AS pos FROM m GROUP BY ALL),
    i AS MATERIALIZED (SELECT key, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, arg_min(type, (-n, pos)) AS best, coalesce(any_value(o.o), 0) AS o FROM t LEFT JOIN o USING (key) GROUP BY key)"""


@query(f"WITH {INDEX_SQL} SELECT key, total, best, o FROM i")
def index_with_occurrences(spark, sf):
    index = lx.surface_index(marked(spark, sf), texts(spark, sf))
    return index.select("key", "total", lx.best_type(F.col("types"), F.col("first"))["t"].alias("best"), "o")


@query(f"""WITH {INDEX_SQL} SELECT sid, s, e, type, CASE WHEN o + total >= 5 AND o >= 0.9 * (o + total) THEN 'drop' WHEN best <> type AND total >= 3 AND most >= 0.9 * total THEN 'retype' ELSE 'keep' END AS action FROM m JOIN i USING (key)""")
def validator_with_occurrences(spark, sf):
    return lx.validate_spans(marked(spark, sf), lx.surface_index(marked(spark, sf), texts(spark, sf))).select("sid", "s", "e", "type", "action")


@query(f"WITH {INDEX_SQL} SELECT key, best AS type FROM i WHERE total >= 2 AND most >= 0.9 * total AND o < 0.5 * (o + total)")
def gazetteer_with_occurrences(spark, sf):
    return lx.gazetteer(lx.surface_index(marked(spark, sf), texts(spark, sf)))


_RANKED = f"""WITH {INDEX_SQL}, f AS (SELECT sid, s, e, key AS entry, total, o, row_number() OVER (PARTITION BY sid ORDER BY s - e, -total, -(most / total), s, e) AS r FROM v JOIN i USING (key)
        WHERE sid[1] = 'b' AND regexp_matches(key, '[\\p{{L}}\\p{{N}}]')),
    l AS (SELECT sid, list(struct_pack(s := s, e := e, entry := entry, total := total, o := o) ORDER BY r) AS l FROM f GROUP BY sid),
    g AS (SELECT sid, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN len(a) >= 10 OR len(list_filter(a, lambda y: y.s < b[1].e AND b[1].s < y.e)) > 0 THEN a ELSE list_concat(a, b) END)) AS x FROM l)
    SELECT sid, CAST(x.s AS INTEGER) AS s, CAST(x.e AS INTEGER) AS e, x.entry AS entry, x.total AS total, x.o AS o FROM g"""


@query(_RANKED)
def facts_with_occurrences(spark, sf):
    index = lx.surface_index(marked(spark, sf), texts(spark, sf))
    rows = sentences(spark, sf, "benchmark", "item_id").withColumn("sid", F.concat(F.lit("b"), "sid"))
    return lx.retrieve_facts(rows, index).select("sid", F.inline("facts")).drop("similarity")
