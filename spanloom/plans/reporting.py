"""Queries on what runs and reports leave behind: tables, graphs with their manifests, subsets, derived runs, means of scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as sm
from ..operators import scorecard as sc
from ..operators.reports import build_index
from ..sources import readers, sinks
from .catalogue import SCORE_SQL, SCORED_SQL, query, reviewed, scored, six, table
from .dictionaries import INDEX_SQL, marked, texts
from .exchange import IOB, IOB_READ, tokens_in_order


@query("SELECT coalesce(lang, 'none') AS lang, CAST(count(*) AS VARCHAR) AS texts, printf('%.4f', sum(n_chars) / 1000.0) AS thousands, CASE WHEN count(quality) > 0 THEN CAST(sum(quality) AS VARCHAR) ELSE '' END AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def report_table(spark, sf):
    """A report table as CSV, read back as text."""
    at = sinks.scratch(spark)
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy(F.coalesce("lang", F.lit("none")).alias("lang"))
    made = rows.agg(F.count("*").alias("texts"), (F.sum("n_chars") / 1000).alias("thousands"), F.sum("quality").alias("good"))
    sinks.write_table(made, at, ["lang", "texts", "thousands", "good"], "texts by language")
    return spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(at).na.fill("")


@query(f"WITH {INDEX_SQL} SELECT count(*) AS keys, CAST(sum(total) AS BIGINT) AS mentions, CAST(sum(o) AS BIGINT) AS outside, (SELECT 2 * count(*) + 3 * (SELECT count(*) FROM t) FROM i) AS triples FROM i")
def graph_build(spark, sf):
    """Index, triples and manifest of a graph: two triples for each key and three for each of its types."""
    at = sinks.scratch(spark)
    made = build_index(marked(spark, sf), texts(spark, sf), at)
    triples = spark.read.text(f"{at}/triples").agg(F.count("*").alias("triples"))
    return triples.select(*[F.lit(v).cast("long").alias(k) for k, v in made.items()], "triples")


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS pos, CAST(doc_id AS VARCHAR) AS sid FROM (SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 60)")
def subset_manifest(spark, sf):
    at = sinks.scratch(spark)
    sinks.write_subset(sm.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 60).select("doc_id", F.col("doc_id").alias("sid")), at, "doc_id")
    return readers.read_subset(spark, at)


@query(f"""WITH {SCORED_SQL} SELECT run, 'record' AS part, doc_id, CAST(CASE WHEN run = 'raw' OR p >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS kept FROM d, (VALUES ('raw'), ('checked')) r(run)
    UNION ALL SELECT run, 'failure', doc_id, NULL FROM d, (VALUES ('raw'), ('checked')) r(run) WHERE kg_best IS NULL""")
def derived_run(spark, sf):
    """A run that validation made from a stored one, beside it: records changed, failures copied. Made twice, it is the same."""
    at, rows = sinks.scratch(spark), scored(spark, sf)
    sinks.write_scored(rows.select("doc_id", "p", F.lit(1).alias("kept")), f"{at}/records", "raw")
    sinks.write_scored(rows.where("kg_best IS NULL").select("doc_id"), f"{at}/failures", "raw")
    for _ in range(2):
        sinks.derive_run(spark, at, "raw", "checked", lambda df: df.withColumn("kept", (F.col("p") >= 0.5).cast("int")))
    records, failures = (spark.read.parquet(f"{at}/{n}") for n in ("records", "failures"))
    return records.select("run", F.lit("record").alias("part"), "doc_id", "kept").union(failures.select("run", F.lit("failure"), "doc_id", F.lit(None).cast("int")))


_W = sc.WEIGHTS
_MEANS = ", ".join(f'avg("{c}") AS "{c}"' for c in sc.CRITERIA)
_VALUE = " + ".join(f'coalesce("{c}" * {_W[c]}, 0)' for c in sc.CRITERIA)
_TOTAL = " + ".join(f'CASE WHEN "{c}" IS NULL THEN 0 ELSE {_W[c]} END' for c in sc.CRITERIA)


@query(f"""WITH {SCORE_SQL},
    m AS (SELECT lang, count(*) AS n, {_MEANS}, avg(CAST(decision = 'passed' AS INTEGER)) AS passed, avg(CAST(decision = 'needs_review' AS INTEGER)) AS needs_review, avg(CAST(decision = 'failed' AS INTEGER)) AS failed FROM z GROUP BY lang)
    SELECT lang, n, {', '.join(f'round("{c}", 6) AS "{c}"' for c in sc.CRITERIA)}, round(passed, 6) AS passed, round(needs_review, 6) AS needs_review, round(failed, 6) AS failed, round(({_VALUE}) / ({_TOTAL}), 6) AS overall FROM m""")
def mean_scorecards(spark, sf):
    return six(sc.mean_scorecard(reviewed(spark, sf), ["lang"]))


@query(f"SELECT CAST(user_id AS VARCHAR) AS sid, CAST(event_id AS VARCHAR) AS token, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i, {IOB_READ} AS label FROM events")
def labelled_csv(spark, sf):
    """Labels from a CSV that is told from IOB lines by its head."""
    at = sinks.scratch(spark)
    label = F.nullif(F.expr(IOB.format("b-Click", "B-ImagingProcedure", "I-adverseevent", "O")), F.lit("O"))
    rows = tokens_in_order(spark, sf).select(F.col("event_id").alias("words"), F.col("user_id").alias("sentence_id"), label.alias("labels"))
    rows.write.option("header", True).csv(at)
    cells = readers.read_labelled(spark, at).select("sid", F.posexplode(F.arrays_zip("tokens", "labels")).alias("i", "c"))
    return cells.select("sid", F.col("c.tokens").alias("token"), "i", F.col("c.labels").alias("label"))


@query(f"WITH {SCORED_SQL} SELECT doc_id, round(s, 6) AS s, CASE WHEN doc_id % 2 = 0 THEN kind END AS kind FROM d WHERE kg_best IS NOT NULL")
def scored_lines(spark, sf):
    """Scored rows as JSON lines of two runs; fields without a value are left out of their lines."""
    at, rows = sinks.scratch(spark), scored(spark, sf).withColumn("span", F.when(F.col("kg_best").isNotNull(), F.array(F.lit(0), F.lit(1))))
    for k in (0, 1):
        sinks.append_records(rows.where(F.col("doc_id") % 2 == k).select("doc_id", "s", "span", *(["kind"] if k == 0 else [])), f"{at}/{k}")
    return six(readers.read_scored(spark, [f"{at}/0", f"{at}/1"], lines="doc_id long, s double, span array<int>, kind string").drop("span"))
