"""Queries over the driver's tables, one for each operator, with the same in SQL where SQL can say it.

Events give tag sequences: a user's events in order, click and view open a span, error continues one, other events are outside.
A second tagging of the same events stands for predictions. Documents with labels give scores and outcomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans as fs
from ..functions import text as ft
from ..operators import evaluate as ev
from ..operators import lexicon as lx
from ..operators import resampling as rs
from ..operators import sampling as sm
from ..operators import scorecard as sc
from ..operators import similarity as si
from ..operators import spans as sp
from ..operators import stats as st
from ..operators import vectors as vc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- what the queries share, in both languages

GOLD = "CASE WHEN event_type IN ('click', 'view') THEN 'B-' || event_type WHEN event_type = 'error' THEN 'I-error' ELSE 'O' END"
PRED = f"CASE WHEN event_id % 7 = 0 THEN 'O' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'B-click' WHEN event_type = 'click' AND event_id % 6 = 0 THEN 'I-click' ELSE {GOLD} END"


def tags(spark: SparkSession, sf: str, label: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("sid"), F.struct("ts", "event_id").alias("pos"), F.expr(label).alias("label"))
    return rows


def spans(spark: SparkSession, sf: str, label: str) -> DataFrame:
    return sp.bio_spans(tags(spark, sf, label))


def spans_sql(name: str, label: str) -> str:
    return f"""{name}_t AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, {label} AS label FROM events),
        {name}_k AS (SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS kind FROM {name}_t),
        {name}_o AS (SELECT *, kind IS NOT NULL AND NOT (label LIKE 'I-%' AND coalesce(lag(kind) OVER (PARTITION BY sid ORDER BY i) = kind, false)) AS opens FROM {name}_k),
        {name}_n AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY sid ORDER BY i) AS nth FROM {name}_o),
        {name} AS (SELECT sid, CAST(min(i) AS INTEGER) AS s, CAST(max(i) + 1 AS INTEGER) AS e, min(kind) AS type, bool_or(opens AND label LIKE 'I-%') AS repaired FROM {name}_n WHERE kind IS NOT NULL GROUP BY sid, nth)"""


BOTH = f"WITH {spans_sql('g', GOLD)}, {spans_sql('p', PRED)}"
MATCHED = f"""{BOTH}, m AS (SELECT sid, s, e, type, max(g) * max(p) AS tp, max(p) * (1 - max(g)) AS fp, max(g) * (1 - max(p)) AS fn
        FROM (SELECT sid, s, e, type, 1 AS g, 0 AS p FROM g UNION ALL SELECT sid, s, e, type, 0, 1 FROM p) GROUP BY ALL)"""


def six(df: DataFrame) -> DataFrame:
    """Doubles at six digits, since engines add in different orders."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return spans(spark, sf, GOLD), spans(spark, sf, PRED)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with scores and reviewer inputs made from their ids and lengths."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.select(*[F.expr(f"{e} AS {n}") for n, e in SCORED.items()])


# Valid in both languages.
SCORED = {
    "doc_id": "doc_id",
    "lang": "lang",
    "source": "source",
    "y": "quality",
    "s": "CAST(n_chars AS DOUBLE) / (n_chars + 1000)",
    "t": "CAST((doc_id * 7919) % 1009 AS DOUBLE) / 1009",
    "text": "text",
    "kind": "CASE lang WHEN 'en' THEN 'disease' WHEN 'fr' THEN 'finding' WHEN 'de' THEN 'substance' END",
    "kg_matches": "CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 5 AS INTEGER) END",
    "kg_best": "CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 101 AS DOUBLE) / 100 END",
    "confidence": "CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 97 AS DOUBLE) / 96 END",
    "agreed": "CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END",
    "p": "CAST(doc_id % 89 AS DOUBLE) / 88",
    "context": "source",
    "normalized_form": "CASE WHEN doc_id % 4 <> 0 THEN lang END",
}
SCORED_SQL = "d AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SCORED.items()) + " FROM documents JOIN labels USING (doc_id))"
AUROC = """sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))"""

#: Five criteria of labelled documents, valid in both languages, and how far their weights are from equal ones.
CRITERIA = {"a": "s", "b": "t", "c": "p", "d": "coalesce(kg_best, 0.0)", "e": "coalesce(confidence, 0.5)"}
FAR = " + ".join(f"abs(w{i} - 0.2)" for i in range(1, 6))


def auroc_sql(source: str, keys: str, score: str, label: str, weight: str = "1") -> str:
    """CTEs c (counts) and b (with the negatives below)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""c AS (SELECT {k}{score} AS s, sum(CASE WHEN {label} = 1 THEN {weight} ELSE 0 END) AS pos, sum(CASE WHEN {label} = 1 THEN 0 ELSE {weight} END) AS neg FROM {source} GROUP BY ALL),
        b AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)"""


# ---- text

TOKENS_SQL = f"regexp_extract_all(text, '{ft.TOKEN.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT doc_id, CAST(len({TOKENS_SQL}) AS INTEGER) AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS digest FROM documents")
def tokenize(spark, sf):
    t = ft.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("""SELECT DISTINCT p_type, trim(regexp_replace(translate(lower(p_type), '‑–', '--'), '\\s+', ' ', 'g')) AS mention,
    trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS label,
    lower(regexp_replace(regexp_replace(trim(p_type), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g')) AS snake FROM part""")
def normalizers(spark, sf):
    c = F.col("p_type")
    return table(spark, sf, "part").select("p_type", ft.normalize_mention(c).alias("mention"), ft.normalize_label(c).alias("label"), ft.snake_case(c).alias("snake")).distinct()


def texts_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""WITH t AS (SELECT item_id, {TOKENS_SQL} AS w FROM benchmark) SELECT item_id, CASE WHEN len(w) > 0 THEN list_reduce(w, lambda a, b:
    CASE WHEN list_contains({texts_sql(ft.TIGHT_BEFORE)}, b) OR list_contains({texts_sql(ft.TIGHT_AFTER)}, right(a, 1)) THEN a || b ELSE a || ' ' || b END) ELSE '' END AS text FROM t""")
def detokenize(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", ft.detokenize(ft.tokenize(F.col("text"))).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) THEN 1 END AS n, CASE event_id % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'no_entities_field' END AS error,
    CASE WHEN event_id % 5 IN (0, 4) THEN least(1.0, CAST(event_id % 13 AS DOUBLE) / 10) END AS confidence FROM events""")
def json_rescue(spark, sf):
    body = F.format_string('{"entities": [{"text": "x", "type": "%s", "confidence": %s}, 7]}', "event_type", (F.col("event_id") % 13 / 10).cast("string"))
    k = F.col("event_id") % 5
    content = F.when(k == 0, body).when(k == 1, "").when(k == 2, "no braces").when(k == 3, F.lit('{"other": 1}')).otherwise(F.concat(F.lit("Answer: "), body, F.lit(" done")))
    rows = table(spark, sf, "events").select("event_id", ft.parse_response(content).alias("r"))
    return rows.select("event_id", F.when(F.col("r.entities").isNotNull(), F.size("r.entities")).alias("n"), "r.error", F.try_element_at("r.entities", F.lit(1))["confidence"].alias("confidence"))


@query("SELECT conv_id, sha256(string_agg(role || chr(0) || text, chr(0) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id")
def conversation_hash(spark, sf):
    rows = table(spark, sf, "conversations").where("role IS NOT NULL AND text IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["role"], F.lit("\u0000"), x["text"])), "\u0000")
    return rows.groupBy("conv_id").agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("turns"))


# ---- spans and their evaluation


@query(f"WITH {spans_sql('g', GOLD)} SELECT * FROM g")
def bio_spans(spark, sf):
    return spans(spark, sf, GOLD)


@query(f"WITH {spans_sql('g', GOLD)} SELECT sid, count(*) AS n, sum(CAST(repaired AS INTEGER)) AS repaired FROM g GROUP BY sid")
def bio_fold(spark, sf):
    rows = tags(spark, sf, GOLD).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("r"))
    folded = rows.select("sid", fs.bio_to_spans(F.transform("r", lambda x: x["label"])).alias("b")).where(F.size("b.spans") > 0)
    return folded.select("sid", F.size("b.spans").cast("long").alias("n"), F.col("b.repaired").cast("long").alias("repaired"))


@query(f"""{MATCHED}, c AS (SELECT type, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m GROUP BY GROUPING SETS ((type), ()))
    SELECT type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp + fn AS BIGINT) AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def span_scores(spark, sf):
    return six(ev.scores_by_type(*sides(spark, sf)))


@query(f"{MATCHED}, c AS (SELECT type, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM m GROUP BY type HAVING sum(tp) + sum(fn) > 0) SELECT round(avg(f1), 6) AS macro_f1, count(*) AS macro_types FROM c")
def macro_f1(spark, sf):
    return six(ev.macro_f1(ev.scores_by_type(*sides(spark, sf))))


@query(f"""{BOTH}, x AS (SELECT p.sid, p.s, p.e, p.type, max(CASE WHEN g.sid IS NULL THEN 0 WHEN p.s = g.s AND p.e = g.e AND p.type = g.type THEN 4 WHEN p.s = g.s AND p.e = g.e THEN 3 WHEN p.type = g.type THEN 2 ELSE 1 END) AS c
    FROM p LEFT JOIN g ON p.sid = g.sid AND g.s < p.e AND p.s < g.e GROUP BY ALL)
    SELECT sid, s, e, type, ['spurious', 'boundary_type_error', 'boundary_error', 'type_error', 'correct'][c + 1] AS label FROM x""")
def error_labels(spark, sf):
    return ev.error_labels(*sides(spark, sf))


@query(f"""{MATCHED}, g1 AS (SELECT * FROM m WHERE fn = 1), p1 AS (SELECT * FROM m WHERE fp = 1),
    met AS (SELECT p1.sid, p1.s, p1.e, p1.type, g1.s AS gs, g1.e AS ge, g1.type AS gt, CASE WHEN p1.s = g1.s AND p1.e = g1.e THEN 0 WHEN p1.type = g1.type THEN 1 ELSE 2 END AS k FROM p1 JOIN g1 ON p1.sid = g1.sid AND g1.s < p1.e AND p1.s < g1.e),
    taken AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY sid, s, e, type ORDER BY k, gs, ge, gt) = 1),
    l AS (SELECT 'correct' AS label FROM m WHERE tp = 1 UNION ALL SELECT ['type_error', 'boundary_error', 'boundary_type_error'][k + 1] FROM taken
      UNION ALL SELECT 'spurious' FROM p1 ANTI JOIN taken USING (sid, s, e, type) UNION ALL SELECT 'missed' FROM g1 ANTI JOIN taken ON g1.sid = taken.sid AND g1.s = taken.gs AND g1.e = taken.ge AND g1.type = taken.gt)
    SELECT label, count(*) AS n FROM l GROUP BY label""")
def error_taxonomy(spark, sf):
    return ev.error_taxonomy(*sides(spark, sf))


@query(f"""{BOTH} SELECT coalesce(a.type, 'O') AS gold_type, coalesce(b.type, 'O') AS pred_type, count(*) AS n FROM (SELECT sid, s, e, max(type) AS type FROM g GROUP BY ALL) a
    FULL JOIN (SELECT sid, s, e, max(type) AS type FROM p GROUP BY ALL) b USING (sid, s, e) GROUP BY ALL""")
def confusion(spark, sf):
    return ev.confusion(*sides(spark, sf))


@query(f"""{BOTH}, a AS (SELECT DISTINCT sid, unnest(range(s, e)) AS i, type FROM g), b AS (SELECT DISTINCT sid, unnest(range(s, e)) AS i, type FROM p), n AS (SELECT count(*) AS tp FROM a JOIN b USING (sid, i, type))
    SELECT tp, (SELECT count(*) FROM b) - tp AS fp, (SELECT count(*) FROM a) - tp AS fn FROM n""")
def token_counts(spark, sf):
    return ev.token_counts(*sides(spark, sf))


@query(f"{MATCHED} SELECT sid, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM m GROUP BY sid")
def sentence_counts(spark, sf):
    return ev.sentence_counts(*sides(spark, sf))


LENIENT = """g1 AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY s, e, type) AS i FROM g), p1 AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY s, e, type) AS i FROM p),
    met AS (SELECT p1.sid, p1.i, list(g1.i ORDER BY g1.i) AS c FROM p1 JOIN g1 ON p1.sid = g1.sid AND p1.type = g1.type AND g1.s < p1.e AND p1.s < g1.e GROUP BY ALL),
    taken AS (SELECT sid, len(list_reduce(list_concat([CAST([] AS BIGINT[])], list(c ORDER BY i)), lambda a, c: list_concat(a, list_slice(list_filter(c, lambda x: NOT list_contains(a, x)), 1, 1)))) AS n FROM met GROUP BY sid),
    lenient AS (SELECT CAST(coalesce((SELECT sum(n) FROM taken), 0) AS BIGINT) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)"""


@query(f"{BOTH}, {LENIENT} SELECT tp, np - tp AS fp, ng - tp AS fn FROM lenient")
def overlap_counts(spark, sf):
    return ev.overlap_counts(*sides(spark, sf))


@query(f"""{MATCHED}, {LENIENT}, c AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM m),
    t AS (SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM m GROUP BY type HAVING sum(tp) + sum(fn) > 0), a AS (SELECT avg(f1) AS macro_f1, count(*) AS macro_types FROM t),
    x AS (SELECT DISTINCT sid, unnest(range(s, e)) AS i, type FROM g), y AS (SELECT DISTINCT sid, unnest(range(s, e)) AS i, type FROM p), k AS (SELECT (SELECT count(*) FROM x JOIN y USING (sid, i, type)) AS tp, (SELECT count(*) FROM x) + (SELECT count(*) FROM y) AS n)
    SELECT c.tp, c.fp, c.fn, c.tp + c.fn AS support, round(coalesce(c.tp / nullif(c.tp + c.fp, 0), 0), 6) AS "precision", round(coalesce(c.tp / nullif(c.tp + c.fn, 0), 0), 6) AS recall, round(coalesce(2 * c.tp / nullif(2 * c.tp + c.fp + c.fn, 0), 0), 6) AS f1,
    round(macro_f1, 6) AS macro_f1, macro_types, round(coalesce(2 * lenient.tp / nullif(np + ng, 0), 0), 6) AS overlap_f1, round(coalesce(2 * k.tp / nullif(k.n, 0), 0), 6) AS token_f1 FROM c, a, lenient, k""")
def evaluation(spark, sf):
    return six(ev.evaluation(*sides(spark, sf)))


@query("""WITH r AS (SELECT *, event_type = 'error' AND event_id % 4 = 0 AS abandoned FROM events)
    SELECT count(*) AS n_sentences, count_if(abandoned) AS n_abandoned, CAST(sum(CASE WHEN NOT abandoned THEN event_id % 3 ELSE 0 END) AS BIGINT) AS unaligned, round(avg(CASE WHEN NOT abandoned THEN nullif(value, 0) END), 6) AS mean_latency_s,
    CAST(sum(CASE WHEN NOT abandoned AND event_id % 6 > 0 THEN length(props) ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN NOT abandoned THEN event_id % 50 ELSE 0 END) AS BIGINT) AS completion_tokens,
    CAST(sum(CASE WHEN NOT abandoned THEN event_id % 2 ELSE 0 END) AS BIGINT) AS validator_actions, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_attempts FROM r""")
def run_totals(spark, sf):
    e, c = table(spark, sf, "events"), F.col
    n = c("event_id")
    usage = F.when(n % 6 > 0, F.length("props"))
    records = e.select(
        n.alias("sid"), F.when((c("event_type") == "error") & (n % 4 == 0), True).alias("abandoned"), c("value").alias("latency_s"), usage.alias("prompt_tokens"), (n % 50).alias("completion_tokens"),
        F.when(n % 3 > 0, F.array_repeat(F.lit("x"), (n % 3).cast("int"))).alias("unaligned"), F.array_repeat(F.lit("drop"), (n % 2).cast("int")).alias("validator_actions"),
    )
    return six(ev.run_totals(records, e.where("event_type = 'error'")))


def greedy_sql(rows: str, order: str) -> str:
    """Rows (sid, s, e, type) that a greedy choice in this order takes."""
    taken = "list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda y: y.s < b[1].e AND b[1].s < y.e)) > 0 THEN a ELSE list_concat(a, b) END)"
    return f"SELECT sid, x.s AS s, x.e AS e, x.type AS type FROM (SELECT sid, unnest({taken}) AS x FROM (SELECT sid, list(struct_pack(s := s, e := e, type := type) ORDER BY {order}) AS l FROM {rows} GROUP BY sid))"


@query(f"{BOTH}, u AS (SELECT sid, s, e, type FROM g UNION SELECT sid, s, e, type FROM p) {greedy_sql('u', 's - e, s, type')}")
def greedy_nonoverlap(spark, sf):
    g, p = sides(spark, sf)
    both = sp.collect_spans(g.union(p))
    return both.select("sid", F.inline(fs.non_overlapping(F.col("spans"))))


@query(f"""{BOTH}, u AS (SELECT sid, 0 AS layer, s AS k, s, e, type FROM g SEMI JOIN p USING (sid) UNION ALL SELECT sid, 1, s - e, s, e, type FROM (SELECT DISTINCT sid, s, e, type FROM p) SEMI JOIN g USING (sid))
    {greedy_sql('u', 'layer, k, s, e, type')}""")
def silver_merge(spark, sf):
    g, p = (sp.collect_spans(x) for x in sides(spark, sf))
    rows = g.withColumnRenamed("spans", "a").join(p.withColumnRenamed("spans", "b"), "sid")
    return rows.select("sid", F.inline(fs.merge_layers(F.col("a"), F.col("b"))))


@query(f"WITH {spans_sql('g', GOLD)}, t AS (SELECT user_id AS sid, count(*) AS n FROM events GROUP BY user_id) SELECT t.sid, CAST(n AS INTEGER) AS n, coalesce(sum(e - s), 0) AS inside FROM t LEFT JOIN g USING (sid) GROUP BY ALL")
def spans_to_tags(spark, sf):
    n = tags(spark, sf, GOLD).groupBy("sid").agg(F.count("*").cast("int").alias("n"))
    rows = n.join(sp.collect_spans(spans(spark, sf, GOLD)), "sid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(fs.SPANS)))
    return rows.select("sid", "n", F.size(F.filter(fs.spans_to_bio(F.col("spans"), F.col("n")), lambda x: x != "O")).cast("long").alias("inside"))


# ---- lexicon


def mentions(spark, sf) -> DataFrame:
    """Part names as surfaces, brands as their types."""
    rows = table(spark, sf, "part")
    return rows.select(F.col("p_partkey").alias("sid"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.col("p_brand").alias("type"), F.col("p_name").alias("surface"), F.col("p_partkey").alias("pos"))


KEY_SQL = "trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g'))"


NAMED_SQL = "trim(regexp_replace(lower(concat_ws(' ', source, CAST(n_chars // 100 AS VARCHAR))), '\\s+', ' ', 'g')) AS key, coalesce(lang, 'none') AS type"
LABELLED = "documents SEMI JOIN labels USING (doc_id)"


def named(spark, sf, labelled: bool = False) -> DataFrame:
    """Sources with lengths in hundreds as the surfaces of documents, languages as their types; only of labelled documents if asked."""
    rows = table(spark, sf, "documents")
    if labelled:
        rows = rows.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    surface = F.concat_ws(" ", "source", F.expr("n_chars div 100").cast("string"))
    return rows.select(F.col("doc_id").alias("sid"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.coalesce("lang", F.lit("none")).alias("type"), surface.alias("surface"), F.col("doc_id").alias("pos"))


@query(f"""WITH k AS (SELECT {KEY_SQL} AS key, p_brand AS type, count(*) AS n, min(p_partkey) AS pos FROM part GROUP BY ALL)
    SELECT k.key, (SELECT p_name FROM part WHERE p_partkey = min(k.pos)) AS label, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS n_types, arg_min(type, (-n, pos)) AS best FROM k GROUP BY k.key""")
def surface_index(spark, sf):
    index = lx.surface_index(mentions(spark, sf))
    return index.select("key", "label", "total", F.size("types").alias("n_types"), lx.best_type(F.col("types"), F.col("first"))["t"].alias("best"))


@query(f"""WITH k AS (SELECT DISTINCT {NAMED_SQL} FROM {LABELLED}), t AS (SELECT {NAMED_SQL} FROM documents)
    SELECT CASE WHEN NOT EXISTS (FROM k WHERE k.key = t.key) THEN 'C_unseen' WHEN EXISTS (FROM k WHERE k.key = t.key AND k.type = t.type) THEN 'A_seen_same_type' ELSE 'B_seen_other_type' END AS stratum, count(*) AS n FROM t GROUP BY stratum""")
def strata(spark, sf):
    return lx.strata(named(spark, sf), lx.surface_index(named(spark, sf, labelled=True))).groupBy("stratum").agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT {NAMED_SQL}, count(*) AS n, min(doc_id) AS pos FROM {LABELLED} GROUP BY ALL),
    i AS (SELECT key, sum(n) AS total, arg_min(type, (-n, pos)) AS best, max(n) AS most FROM k GROUP BY key), t AS (SELECT {NAMED_SQL} FROM documents)
    SELECT CASE WHEN best <> type AND total >= 3 AND 10 * most >= 9 * total THEN 'retype' ELSE 'keep' END AS action, count(*) AS n FROM t LEFT JOIN i USING (key) GROUP BY action""")
def validator(spark, sf):
    return lx.validate_spans(named(spark, sf), lx.surface_index(named(spark, sf, labelled=True))).groupBy("action").agg(F.count("*").alias("n"))


def sentences(spark, sf, name: str, id_: str) -> DataFrame:
    return table(spark, sf, name).select(F.col(id_).alias("sid"), ft.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(f"""WITH t AS (SELECT doc_id, list_transform({TOKENS_SQL}, lambda x: translate(lower(x), '‑–', '--')) AS w FROM documents), b AS (SELECT list_transform({TOKENS_SQL}, lambda x: translate(lower(x), '‑–', '--')) AS w FROM benchmark),
    d AS (SELECT doc_id, array_to_string(w[i:i + 5], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM t)), k AS (SELECT DISTINCT array_to_string(w[i:i + 5], ' ') AS key FROM (SELECT w, unnest(range(1, len(w) - 4)) AS i FROM b))
    SELECT doc_id AS sid, count(*) AS hits, count(DISTINCT key) AS keys FROM d JOIN k USING (key) WHERE regexp_matches(key, '[\\p{{L}}\\p{{N}}]') GROUP BY doc_id""")
def ngram_hits(spark, sf):
    entries = lx.windows(sentences(spark, sf, "benchmark", "item_id"), 6, shortest=6).select("key").distinct()
    return lx.dictionary_join(sentences(spark, sf, "documents", "doc_id"), entries, 6, shortest=6).groupBy("sid").agg(F.count("*").alias("hits"), F.countDistinct("key").alias("keys"))


@query("""WITH n AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS k FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM n GROUP BY k""")
def dedup_copies(spark, sf):
    return lx.dedup_with_counts(table(spark, sf, "documents").select("doc_id", "text"), order="doc_id").select("doc_id", "copies")


@query("""WITH n AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM benchmark), d AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM documents) SELECT item_id FROM n ANTI JOIN d USING (k)""")
def decontaminated_pool(spark, sf):
    return lx.decontaminate(table(spark, sf, "benchmark").select("item_id", "text"), table(spark, sf, "documents").select("text")).select("item_id")


TRI = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"


@query(f"""WITH q AS (SELECT DISTINCT p_type AS q FROM part), k AS (SELECT DISTINCT lower(p_type) || ' ' || lower(p_brand) AS key FROM part), a AS (SELECT lower(q) AS q, unnest({TRI.format('lower(q)')}) AS g FROM q), b AS (SELECT key, unnest({TRI.format('key')}) AS g FROM k WHERE length(key) >= 5),
    n AS (SELECT q, key, count(*) AS n FROM a JOIN b USING (g) GROUP BY ALL), j AS (SELECT q, key, CAST(n AS DOUBLE) / (len({TRI.format('q')}) + len({TRI.format('key')}) - n) AS similarity FROM n)
    SELECT q, key, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, key) = 1""")
def trigram_fuzzy(spark, sf):
    part = table(spark, sf, "part")
    return six(lx.trigram_join(part.select(F.lower("p_type").alias("q")), part.select(F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")).alias("key"))))


@query(f"""WITH i AS (SELECT key, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM (SELECT {KEY_SQL} AS key, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY key),
    t AS (SELECT p_partkey AS sid, list_transform(regexp_extract_all(p_type || ' ' || p_name, '{ft.TOKEN.replace(chr(39), chr(39) * 2)}'), lambda x: translate(lower(x), '‑–', '--')) AS w FROM part),
    v AS (SELECT sid, s, s + n AS e, array_to_string(w[s + 1:s + n], ' ') AS key FROM (SELECT sid, w, unnest(range(len(w))) AS s FROM t), unnest(range(1, 7)) k(n) WHERE s + n <= len(w)),
    l AS (SELECT sid, list(struct_pack(s := s, e := e, entry := key, total := total) ORDER BY s - e, -total, -(most / total), s, e) AS l FROM v JOIN i USING (key) WHERE regexp_matches(key, '[\\p{{L}}\\p{{N}}]') GROUP BY sid),
    g AS (SELECT sid, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN len(a) >= 3 OR len(list_filter(a, lambda y: y.s < b[1].e AND b[1].s < y.e)) > 0 THEN a ELSE list_concat(a, b) END)) AS x FROM l)
    SELECT sid, CAST(x.s AS INTEGER) AS s, CAST(x.e AS INTEGER) AS e, x.entry AS entry, CAST(1 AS DOUBLE) AS similarity, x.total AS total, CAST(0 AS BIGINT) AS o FROM g""")
def retrieved_facts(spark, sf):
    index = lx.surface_index(mentions(spark, sf))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("sid"), ft.tokenize(F.concat_ws(" ", "p_type", "p_name")).alias("tokens"))
    return lx.retrieve_facts(rows, index, 3).select("sid", F.inline("facts"))


# ---- similarity and vectors


def labels_of(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(ft.normalize_label(F.col("p_name")).alias("label"), F.concat(F.lit("urn:"), F.md5("p_name")).alias("uri"), F.array(F.lit("part")).alias("kinds")).distinct()


@query("""WITH q AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS q FROM part), l AS (SELECT DISTINCT lower(p_name) AS label FROM part)
    SELECT q, label, round(CAST(least(length(q), length(label)) AS DOUBLE) / greatest(length(q), length(label)), 6) AS similarity FROM q JOIN l ON contains(label, q) OR contains(q, label) WHERE CAST(least(length(q), length(label)) AS DOUBLE) / greatest(length(q), length(label)) >= 0.4""")
def containment(spark, sf):
    q = table(spark, sf, "part").select(ft.normalize_label(F.element_at(F.split("p_name", " "), 1)).alias("q"), F.lit("part").alias("kind"))
    return six(si.contained(q, labels_of(spark, sf), 0.4))


KNN = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT q.vec_id AS qid, x.vec_id AS pid, x.label % 2 AS side, list_inner_product(q.v, x.v) AS similarity FROM e q JOIN e x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)"""


def neighbours(spark, sf, k: int, rest: str = "true") -> DataFrame:
    """The k nearest of all vectors but the query's own: one more is drawn, since its own may be among them."""
    e = table(spark, sf, "embeddings")
    found = vc.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), e.where(rest).select(F.col("vec_id").alias("pid"), F.col("vec_id").alias("pos"), F.col("embedding").alias("v")), k + 1)
    w = Window.partitionBy("qid").orderBy("rank")
    return found.where("qid <> pid").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query(f"WITH {KNN} SELECT qid, pid, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, pid) AS INTEGER) AS rank FROM n QUALIFY rank <= 5")
def knn_demos(spark, sf):
    return six(neighbours(spark, sf, 5))


@query(f"""WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, side ORDER BY similarity DESC, pid) AS rank FROM n), m AS (SELECT * FROM r WHERE rank <= CASE side WHEN 0 THEN 2 ELSE 3 END)
    SELECT qid, pid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank DESC, 1 - side DESC) AS INTEGER) AS place FROM m""")
def mixed_demos(spark, sf):
    return vc.mix_demonstrations(neighbours(spark, sf, 5, "label % 2 = 0"), neighbours(spark, sf, 5, "label % 2 = 1"), 5)


# ---- statistics


@query(f"WITH {SCORED_SQL}, {auroc_sql('d', '', 's', 'y')} SELECT round({AUROC}, 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b")
def auroc(spark, sf):
    return six(st.auroc(scored(spark, sf), "s"))


@query(f"""WITH {SCORED_SQL}, {auroc_sql('d', '', 's', 'y')}, w AS (SELECT pos, sum(pos) OVER o AS tp, sum(pos + neg) OVER o AS seen FROM c WINDOW o AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS pr_auc FROM w""")
def pr_auc(spark, sf):
    return six(st.average_precision(scored(spark, sf), "s"))


@query(f"""WITH {SCORED_SQL}, x AS (SELECT 'pooled' AS slice, 'all' AS value, s, y FROM d UNION ALL SELECT 'lang', lang, s, y FROM d UNION ALL SELECT 'source', source, s, y FROM d), {auroc_sql('x', 'slice, value', 's', 'y')}
    SELECT slice, value, round(CASE WHEN sum(pos) * sum(neg) > 0 THEN {AUROC.replace('/ (', '/ nullif(').replace('sum(neg))', 'sum(neg), 0)')} END, 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b GROUP BY slice, value""")
def slices(spark, sf):
    return six(st.auroc(st.slices(scored(spark, sf), ["lang", "source"]), "s", "y", ["slice", "value"]))


EDGES = "[" + ", ".join(repr(i / 10) for i in range(1, 10)) + "]"


@query(f"WITH {SCORED_SQL}, k AS (SELECT *, CAST(len(list_filter({EDGES}, lambda e: s >= e)) AS INTEGER) AS bin FROM d) SELECT bin, count(*) AS n, round(avg(s), 6) AS mean_p, round(avg(y), 6) AS rate FROM k GROUP BY bin")
def calibration(spark, sf):
    return six(st.calibration(scored(spark, sf), "s"))


@query(f"WITH {SCORED_SQL}, k AS (SELECT len(list_filter({EDGES}, lambda e: s >= e)) AS bin, count(*) AS n, abs(avg(s) - avg(y)) AS gap FROM d GROUP BY bin) SELECT round(sum(n * gap) / sum(n), 6) AS ece, (SELECT round(avg((s - y) * (s - y)), 6) FROM d) AS brier FROM k")
def calibration_summary(spark, sf):
    return six(st.calibration_summary(scored(spark, sf), "s"))


@query(f"WITH {SCORED_SQL} SELECT lang, count(s) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.1), 6) AS q10, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.75), 6) AS q75, round(quantile_cont(s, 0.9), 6) AS q90 FROM d GROUP BY lang")
def score_summary(spark, sf):
    return six(st.score_summary(scored(spark, sf), "s", ["lang"]))


RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"WITH {SCORED_SQL}, r AS (SELECT {RANKS.format('s')} AS a, {RANKS.format('t')} AS b FROM d) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, sf):
    return six(st.spearman(scored(spark, sf), "s", "t"))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT lang, {RANKS.format('s')} AS r, s FROM d), g AS (SELECT sum(r) AS r, count(*) AS n FROM r GROUP BY lang), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY s)), n AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS q, count(*) AS k FROM g)
    SELECT round((12 * q / (n * (n + 1)) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, k - 1 AS df FROM n, t""")
def kruskal(spark, sf):
    return six(st.kruskal(scored(spark, sf), "s", "lang"))


@query(f"WITH {SCORED_SQL}, {auroc_sql('d', 'lang', 't', 'y')} SELECT lang, round(2 * ({AUROC.replace('/ (', '/ nullif(').replace('sum(neg))', 'sum(neg), 0)')}) - 1, 6) AS delta FROM b GROUP BY lang")
def cliffs_delta(spark, sf):
    return six(st.cliffs_delta(scored(spark, sf), "t", "y", ["lang"]))


@query("WITH p AS (SELECT source, CAST((count(*) * 37 + min(doc_id) * 11) % 97 + 1 AS DOUBLE) / 400 AS p FROM documents GROUP BY source), r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, source) + 1) * p AS a FROM p) SELECT source, round(p, 6) AS p, round(least(1, max(a) OVER (ORDER BY p, source ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r")
def holm(spark, sf):
    p = table(spark, sf, "documents").groupBy("source").agg((((F.count("*") * 37 + F.min("doc_id") * 11) % 97 + 1).cast("double") / 400).alias("p"))
    return six(st.holm(p, order="source"))


# ---- the scorecard

BAD = "[<>{}|\\[\\]\\\\]"
WORDS_SQL = "list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda w: w <> '')"
SCORE_SQL = f"""{SCORED_SQL}, w AS (SELECT *, {WORDS_SQL} AS words FROM d),
    v AS (SELECT *, len(list_filter(words, lambda w: w IN ({', '.join(repr(x) for x in sc.POPULATION)}))) AS people FROM w),
    k AS (SELECT *, CASE WHEN kg_matches IS NULL THEN NULL WHEN kg_best >= 0.7 THEN CASE WHEN kg_best >= 0.95 THEN least(1.0, kg_best + 0.2) ELSE kg_best END ELSE 0.5 END AS congruence,
      CASE WHEN kg_matches IS NULL THEN NULL WHEN kg_matches = 0 THEN 0.8 WHEN kg_matches < 3 AND coalesce(kg_best, 0) < 0.8 THEN 0.71 WHEN kg_matches < 3 THEN 0.5 ELSE greatest(0.3, 0.6 - 0.3 * coalesce(kg_best, 0)) END AS coverage,
      greatest(0.0, least(1.0, CAST(1 AS DOUBLE) - CASE WHEN kind IS NULL THEN 0.3 ELSE 0 END - CASE WHEN length(trim(text)) < 2 THEN 0.2 + 0.6 * (1 - length(trim(text)) / 2) ELSE 0 END
        - CASE WHEN length(trim(text)) > 200 THEN 0.1 ELSE 0 END - CASE WHEN length(trim(text)) <= 2 AND NOT regexp_matches(trim(text), '^[\\p{{L}}\\p{{N}}]+$') THEN 0.5 ELSE 0 END - CASE WHEN regexp_matches(text, '{BAD}') THEN 0.25 ELSE 0 END - CASE WHEN regexp_matches(trim(text), '^[\\d\\s.,-]+$') THEN 0.2 ELSE 0 END
        - 0.25 * (CASE WHEN kind IS NOT NULL AND (people >= 2 OR (len(words) > 5 AND people >= 1)) THEN 1 ELSE 0 END + CASE WHEN kind IS NOT NULL AND len(words) > 8 THEN 1 ELSE 0 END
          + CASE WHEN kind = 'finding' AND len(words) > 4 AND NOT regexp_matches(lower(trim(text)), '{'|'.join(sc.FINDING)}') AND contains(lower(trim(text)), 'with') THEN 1 ELSE 0 END
          + CASE WHEN kind = 'substance' AND lower(trim(text)) IN ('the', 'a', 'an', 'this', 'that') THEN 1 ELSE 0 END + CASE WHEN kind = 'disease' AND regexp_matches(lower(trim(text)), 'patient|subject') THEN 1 ELSE 0 END))) AS "constraint",
      CAST(0.85 AS DOUBLE) * (CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN length(trim(text)) >= 2 THEN 1 ELSE 0 END) / 2 + CAST(0.15 AS DOUBLE) * (CASE WHEN coalesce(context, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(normalized_form, '') <> '' THEN 1 ELSE 0 END + CASE WHEN confidence IS NOT NULL THEN 1 ELSE 0 END) / 3 AS completeness,
      greatest(0.0, least(1.0, CASE WHEN agreed THEN least(1.0, coalesce(confidence, 0.5) + 0.3 * p) WHEN NOT agreed THEN greatest(0.0, least(0.8, coalesce(confidence, 0.5)) - 0.225 * p) ELSE least(0.8, coalesce(confidence, 0.5)) END)) AS consistency FROM v),
    o AS (SELECT *, CAST(round(CAST(greatest(0.0, least(1.0, (coalesce(0.25 * congruence, 0) + coalesce(0.15 * coverage, 0) + 0.25 * "constraint" + 0.15 * completeness + 0.2 * consistency) / (CASE WHEN kg_matches IS NULL THEN CAST(0.6 AS DOUBLE) ELSE 1.0 END))) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS overall FROM k),
    z AS (SELECT *, CASE WHEN "constraint" < 0.4 OR kind IS NULL THEN 'failed' WHEN overall >= 0.75 THEN 'passed' WHEN overall >= 0.5 THEN 'needs_review' WHEN overall < 0.25 THEN 'failed' ELSE 'needs_review' END AS status,
      CASE WHEN "constraint" < 0.4 OR kind IS NULL THEN 'reject' WHEN overall >= 0.75 THEN 'approve' WHEN overall >= 0.5 AND NOT agreed THEN 'verify_type' WHEN overall >= 0.5 AND congruence > 0.95 THEN 'check_duplicate' WHEN overall >= 0.5 THEN 'manual_review' WHEN overall < 0.25 THEN 'reject' ELSE 'manual_review' END AS recommendation,
      CASE WHEN "constraint" < 0.4 OR kind IS NULL THEN 'failed' WHEN overall >= 0.75 THEN 'passed' WHEN overall >= 0.5 THEN 'needs_review' ELSE 'failed' END AS decision FROM o)"""


def reviewed(spark, sf) -> DataFrame:
    rows = sc.scorecard(scored(spark, sf))
    return rows.withColumn("decision", sc.decide(F.col("overall"), F.col("constraint"), F.col("type_valid")))


@query(f'WITH {SCORE_SQL} SELECT doc_id, round(congruence, 6) AS congruence, round(coverage, 6) AS coverage, round("constraint", 6) AS "constraint", round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, overall, status, recommendation FROM z')
def scorecard(spark, sf):
    return six(reviewed(spark, sf).select("doc_id", *sc.CRITERIA, "overall", "status", "recommendation"))


def rate_sql(part: str, whole: str, name: str) -> str:
    return f"round(CAST(count_if({part} AND {whole}) AS DOUBLE) / nullif(count_if({whole}), 0), 6) AS {name}"


@query(f"""WITH {SCORE_SQL} SELECT lang, {rate_sql("decision = 'passed'", 'true', 'share_passed')}, {rate_sql("decision = 'needs_review'", 'true', 'share_review')}, {rate_sql("decision = 'failed'", 'true', 'share_failed')}, {rate_sql('y = 1', "decision = 'passed'", 'p_correct_given_passed')},
    {rate_sql("decision = 'passed'", 'y <> 1', 'false_acceptance')}, {rate_sql("decision <> 'passed'", 'y = 1', 'false_rejection')}, {rate_sql('y <> 1', "decision = 'failed'", 'p_incorrect_given_failed')} FROM z GROUP BY lang""")
def decisions(spark, sf):
    return six(st.decision_metrics(reviewed(spark, sf), group=["lang"]))


@query(f"""WITH {SCORE_SQL}, f AS (SELECT count(*) AS n, count_if(y = 1) AS tp, count_if(decision = 'passed') AS kn, count_if(decision = 'passed' AND y = 1) AS ktp, 500.0 AS gold FROM z)
    SELECT round(tp / n, 6) AS unfiltered_precision, round(tp / CAST(gold AS DOUBLE), 6) AS unfiltered_recall, round(2 * tp / (n + CAST(gold AS DOUBLE)), 6) AS unfiltered_f1, round(ktp / kn, 6) AS filtered_precision, round(ktp / CAST(gold AS DOUBLE), 6) AS filtered_recall, round(2 * ktp / (kn + CAST(gold AS DOUBLE)), 6) AS filtered_f1 FROM f""")
def filter_effect(spark, sf):
    return six(st.filter_effect(reviewed(spark, sf).withColumn("keep", F.col("decision") == "passed"), "keep", "y", 500))


@query(f"""WITH {SCORE_SQL}, l AS (UNPIVOT (SELECT y, congruence, coverage, "constraint", completeness, consistency FROM z) ON congruence, coverage, "constraint", completeness, consistency INTO NAME criterion VALUE v)
    SELECT criterion, y, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM l GROUP BY criterion, y""")
def criterion_by_label(spark, sf):
    return six(st.criterion_by_label(reviewed(spark, sf), sc.CRITERIA, "y"))


def overall_sql(drop: str) -> str:
    kept = [(f'"{c}"', f"CAST({sc.WEIGHTS[c]} AS DOUBLE)") for c in sc.CRITERIA if c != drop]
    total = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in kept)
    return f"CAST(round(CAST(greatest(0.0, least(1.0, ({' + '.join(f'coalesce({c} * {w}, 0)' for c, w in kept)}) / nullif({total}, 0))) AS DECIMAL(18, 9)), 3) AS DOUBLE)"


NO_ZERO = AUROC.replace("/ (", "/ nullif(").replace("sum(neg))", "sum(neg), 0)")


@query(f"""WITH {SCORE_SQL}, x AS ({' UNION ALL '.join(f"SELECT '{c}' AS dropped, {overall_sql(c)} AS s, y FROM z" for c in ('none', *sc.CRITERIA))}), {auroc_sql('x', 'dropped', 's', 'y')}
    SELECT dropped, round({NO_ZERO}, 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b GROUP BY dropped""")
def ablation(spark, sf):
    return six(sc.ablation(reviewed(spark, sf)))


@query(f"""WITH {SCORE_SQL}, l AS (SELECT lang, y, 'overall' AS scorer, overall AS v FROM z UNION ALL SELECT lang, y, 'b0', coalesce(confidence, 0.5) FROM z UNION ALL SELECT lang, y, 'b1', CASE WHEN agreed THEN coalesce(p, 0) WHEN NOT agreed THEN -coalesce(p, 0) ELSE 0 END FROM z
      UNION ALL SELECT lang, y, 'b2', CAST(doc_id % 2 = 0 AS INTEGER) FROM z), {auroc_sql('l', 'lang, scorer', 'v', 'y')}, a AS (SELECT lang, scorer, {NO_ZERO} AS auroc, sum(pos) AS n_pos, sum(neg) AS n_neg FROM b GROUP BY ALL),
    n AS (SELECT lang, scorer, pos, sum(pos) OVER o AS tp, sum(pos + neg) OVER o AS seen FROM c WINDOW o AS (PARTITION BY lang, scorer ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), r AS (SELECT lang, scorer, sum(pos * tp / seen) / nullif(sum(pos), 0) AS pr_auc FROM n GROUP BY ALL)
    SELECT lang, scorer, round(auroc, 6) AS auroc, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(pr_auc, 6) AS pr_auc FROM a JOIN r USING (lang, scorer)""")
def scorers(spark, sf):
    rows = reviewed(spark, sf).withColumn("stratum", F.when(F.col("doc_id") % 2 == 0, "A_seen_same_type").otherwise("C_unseen"))
    rows = rows.select("lang", "y", "overall", *sc.baselines(F.col("confidence"), F.col("agreed"), F.col("p"), F.col("stratum")))
    return six(sc.compare_scorers(rows, ["overall", "b0", "b1", "b2"], "y", ["lang"]))


# ---- resampling


def draws_sql(seed: int, n: str, rep: str = "rep", i: str = "i") -> str:
    hexa = f"substr(md5('{seed}|' || {rep} || '|' || {i}), 1, 12)"
    return f"CAST('0x' || {hexa} AS BIGINT) % {n}"


def weights_sql(units: str, unit: str, reps: int, seed: int = 7) -> str:
    return f"""u AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS u FROM (SELECT DISTINCT {unit} FROM {units})), nn AS (SELECT count(*) AS n FROM u),
        hits AS (SELECT rep, {draws_sql(seed, 'n')} AS u FROM range({reps}) r(rep), (SELECT u AS i FROM u), nn), ww AS (SELECT rep, {unit}, count(*) AS w FROM hits JOIN u USING (u) GROUP BY ALL)"""


@query(f"""{MATCHED}, k AS (SELECT sid, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m GROUP BY sid), {weights_sql('k', 'sid', 50)},
    f AS (SELECT rep, 2 * sum(w * tp) / greatest(2 * sum(w * tp) + sum(w * fp) + sum(w * fn), 1) AS f1 FROM ww JOIN k USING (sid) GROUP BY rep) SELECT round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high, count(*) AS replicates FROM f""")
def bootstrap_ci(spark, sf):
    return six(rs.bootstrap_f1(ev.sentence_counts(*sides(spark, sf)), 50))


@query(f"""WITH {SCORED_SQL}, {weights_sql('d', 'source', 20)}, x AS (SELECT rep, s, y, w FROM d JOIN ww USING (source)), {auroc_sql('x', 'rep', 's', 'y', 'w')} SELECT rep, round({AUROC}, 6) AS auroc FROM b GROUP BY rep""")
def cluster_bootstrap(spark, sf):
    return six(rs.cluster_bootstrap_auroc(scored(spark, sf), "source", "s", reps=20).select("rep", "auroc"))


def two_runs(spark, sf) -> DataFrame:
    g, p = sides(spark, sf)
    return ev.paired(ev.sentence_counts(g, p), ev.sentence_counts(g, g))


@query(f"""{MATCHED}, k AS (SELECT sid, sum(tp) AS tp_a, sum(fp) AS fp_a, sum(fn) AS fn_a, sum(tp + fn) AS tp_b, 0 AS fp_b, 0 AS fn_b FROM m GROUP BY sid), {weights_sql('k', 'sid', 50)},
    f AS (SELECT rep, 2 * sum(w * tp_b) / greatest(2 * sum(w * tp_b) + sum(w * fp_b) + sum(w * fn_b), 1) - 2 * sum(w * tp_a) / greatest(2 * sum(w * tp_a) + sum(w * fp_a) + sum(w * fn_a), 1) AS d FROM ww JOIN k USING (sid) GROUP BY rep)
    SELECT round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(*) AS replicates FROM f""")
def paired_bootstrap(spark, sf):
    return six(rs.paired_bootstrap(two_runs(spark, sf), 50))


@query(f"""{MATCHED}, k AS (SELECT sid, sum(tp) AS ta, sum(fp) AS fa, sum(fn) AS na, sum(tp + fn) AS tb FROM m GROUP BY sid), o AS (SELECT 2 * sum(tb) / greatest(2 * sum(tb), 1) - 2 * sum(ta) / greatest(2 * sum(ta) + sum(fa) + sum(na), 1) AS delta FROM k),
    z AS (SELECT rep, k.*, {draws_sql(7, '2', 'rep', 'sid')} = 1 AS swap FROM range(50) r(rep), k),
    f AS (SELECT rep, 2 * sum(if(swap, ta, tb)) / greatest(2 * sum(if(swap, ta, tb)) + sum(if(swap, fa + na, 0)), 1) - 2 * sum(if(swap, tb, ta)) / greatest(2 * sum(if(swap, tb, ta)) + sum(if(swap, 0, fa + na)), 1) AS d FROM z GROUP BY rep)
    SELECT round(delta, 6) AS delta, round((count_if(abs(d) >= abs(delta) - 1e-12) + 1) / 51.0, 6) AS p FROM f, o GROUP BY delta""")
def randomization(spark, sf):
    return six(rs.approximate_randomization(two_runs(spark, sf), 50))


@query(f"""WITH {SCORED_SQL}, k AS (SELECT {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in CRITERIA.items())}, y FROM d),
    g AS (SELECT row_number() OVER (ORDER BY i, j, k, l) - 1 AS ord, i / 20.0 AS w1, j / 20.0 AS w2, k / 20.0 AS w3, l / 20.0 AS w4, (20 - i - j - k - l) / 20.0 AS w5 FROM range(21) a(i), range(21) b(j), range(21) c(k), range(21) d(l) WHERE i + j + k + l <= 20),
    x AS (SELECT ord, round(w1 * a + w2 * b + w3 * c + w4 * d + w5 * e, 10) AS s, y FROM k, g), {auroc_sql('x', 'ord', 's', 'y').replace('b AS (', 'bb AS (')}, r AS (SELECT ord, {AUROC} AS auroc FROM bb GROUP BY ord)
    SELECT ord, {', '.join(f'CAST(w{i} AS DOUBLE) AS w{i}' for i in range(1, 6))}, round(auroc, 6) AS auroc FROM r JOIN g USING (ord) ORDER BY round(r.auroc, 6) DESC, round({FAR}, 9), ord LIMIT 1""")
def weight_grid(spark, sf):
    """All 10,626 vectors of five criteria, on scores of ten digits."""
    rows = scored(spark, sf).select(*[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in CRITERIA.items()], "y")
    return six(rs.best_weights(rows, list(CRITERIA), step=0.05, digits=10))


# ---- samples, queues, relations


@query("""WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS k, md5('7|' || doc_id) AS h FROM documents), z AS (SELECT k, count(*) AS size, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM d GROUP BY k),
    b AS (SELECT *, greatest(1, 100 * size // total) AS q, 100 * size % total AS rest FROM z), m AS (SELECT 100 - sum(q) AS missing, max(q) AS most FROM b),
    r AS (SELECT *, row_number() OVER (ORDER BY q < size DESC, rest DESC, k) AS rank FROM b), l AS (SELECT max(level) AS level FROM m, unnest(range(most + 1)) t(level) WHERE (SELECT sum(greatest(0, q - level)) FROM b) >= -missing AND missing < 0),
    c AS (SELECT r.*, missing, level, row_number() OVER (PARTITION BY q > level ORDER BY k DESC) AS late, (SELECT sum(greatest(0, q - level)) FROM b) + missing AS back FROM r, m, l),
    a AS (SELECT k, CASE WHEN total <= 100 THEN size WHEN missing >= 0 THEN q + CAST(q < size AND rank <= missing AS INTEGER) WHEN q > level THEN level + CAST(late <= back AS INTEGER) ELSE q END AS quota FROM c)
    SELECT d.doc_id, d.k AS stratum FROM d JOIN a USING (k) QUALIFY row_number() OVER (PARTITION BY d.k ORDER BY h, doc_id) <= any_value(quota) OVER (PARTITION BY d.k)""")
def stratified_sample(spark, sf):
    return sm.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", F.coalesce("lang", F.lit("none")).alias("stratum"))


@query("""WITH d AS (SELECT doc_id, coalesce(lang, 'none') || '/' || coalesce(source, 'none') AS k, md5('7|' || doc_id) AS h FROM documents), z AS (SELECT k, count(*) AS size, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM d GROUP BY k),
    b AS (SELECT *, greatest(1, 90 * size // total) AS q, 90 * size % total AS rest FROM z), m AS (SELECT 90 - sum(q) AS missing, max(q) AS most FROM b),
    r AS (SELECT *, row_number() OVER (ORDER BY q < size DESC, rest DESC, k) AS rank FROM b), l AS (SELECT max(level) AS level FROM m, unnest(range(most + 1)) t(level) WHERE (SELECT sum(greatest(0, q - level)) FROM b) >= -missing AND missing < 0),
    c AS (SELECT r.*, missing, level, row_number() OVER (PARTITION BY q > level ORDER BY k DESC) AS late, (SELECT sum(greatest(0, q - level)) FROM b) + missing AS back FROM r, m, l)
    SELECT k AS stratum, size, CAST(CASE WHEN total <= 90 THEN size WHEN missing >= 0 THEN q + CAST(q < size AND rank <= missing AS INTEGER) WHEN q > level THEN level + CAST(late <= back AS INTEGER) ELSE q END AS BIGINT) AS quota FROM c""")
def stratum_quotas(spark, sf):
    """More strata than the sample can hold in proportion: the quotas of the largest are levelled."""
    key = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")))
    return sm.allocate(table(spark, sf, "documents").groupBy(key.alias("stratum")).agg(F.count("*").alias("size")), 90)


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return sm.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (ORDER BY conv_id, turn) - 1) / 100) AS BIGINT) AS batch FROM conversations")
def prompt_batches(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("k"))
    return sm.batches(rows, "k", 100).select("conv_id", "turn", "batch")


@query("""WITH f AS (SELECT user_id AS key, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL), d AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'purchase' AND value > 90)
    SELECT count(*) AS total, count(d.key) AS completed, count_if(d.key IS NULL AND n >= 12) AS abandoned, count_if(d.key IS NULL AND coalesce(n, 0) < 12) AS remaining, CASE WHEN count_if(d.key IS NULL AND coalesce(n, 0) < 12) > 0 THEN 'partial' WHEN count_if(d.key IS NULL AND n >= 12) > 0 THEN 'complete_with_failures' ELSE 'complete' END AS state
    FROM (SELECT DISTINCT user_id AS key FROM events) i LEFT JOIN d USING (key) LEFT JOIN f USING (key)""")
def queue_status(spark, sf):
    from ..streaming.queue import status

    e = table(spark, sf, "events").withColumn("key", F.col("user_id"))
    return status(e, e.where("event_type = 'purchase' AND value > 90"), e.where("event_type = 'error'"), 12)


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def revenue_by_nation(spark, sf):
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---- more of evaluation, statistics and reports


@query(f"""{MATCHED}, l AS (SELECT DISTINCT type AS key FROM g WHERE type <> 'error'), h AS (SELECT g.sid, g.s, g.e, g.type, EXISTS (FROM p WHERE p.sid = g.sid AND p.s = g.s AND p.e = g.e AND p.type = g.type) AS hit FROM g)
    SELECT CASE WHEN type IN (SELECT key FROM l) THEN 'seen' ELSE 'unseen' END AS grp, round(CAST(count_if(hit) AS DOUBLE) / count(*), 6) AS recall, count(*) AS gold FROM h GROUP BY grp""")
def seen_unseen(spark, sf):
    g, p = sides(spark, sf)
    lexicon = g.where("type <> 'error'").select(F.col("type").alias("key")).distinct()
    return six(ev.seen_unseen_recall(g.withColumn("key", F.col("type")), p, lexicon))


@query(f"""{MATCHED}, h AS (SELECT g.type, EXISTS (FROM p WHERE p.sid = g.sid AND p.s = g.s AND p.e = g.e AND p.type = g.type) AS hit FROM g)
    SELECT CASE type WHEN 'click' THEN 'both' WHEN 'view' THEN 'train' ELSE 'none' END AS grp, round(CAST(count_if(hit) AS DOUBLE) / count(*), 6) AS recall, count(*) AS gold FROM h GROUP BY grp""")
def exposure(spark, sf):
    g, p = sides(spark, sf)
    keys = g.select(F.col("type").alias("key")).distinct()
    return six(ev.exposure_recall(g.withColumn("key", F.col("type")), p, keys.where("key IN ('click', 'view')"), keys.where("key = 'click'")))


@query(f"""{BOTH} SELECT (SELECT count(*) FROM g) AS first, (SELECT count(*) FROM p) AS second, count(*) AS found FROM (SELECT sid, s, e, type FROM g INTERSECT SELECT sid, s, e, type FROM p)""")
def layer_agreement(spark, sf):
    from ..operators.reports import agreement

    return agreement(*sides(spark, sf))


@query(f"WITH {spans_sql('g', GOLD)} SELECT type, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM g) AS DOUBLE), 6) AS share FROM g GROUP BY type")
def type_distribution(spark, sf):
    from ..operators.reports import type_distribution as distribution

    return six(distribution(spans(spark, sf, GOLD)))


@query(f"""WITH s AS (SELECT {NAMED_SQL} FROM documents), l AS (SELECT {NAMED_SQL} FROM {LABELLED})
    SELECT (SELECT count(*) FROM part) AS sentences, (SELECT count(DISTINCT {TOKENS_SQL.replace('text', 'p_name')}) FROM part) AS unique_sentences, (SELECT round(avg(len({TOKENS_SQL.replace('text', 'p_name')})), 6) FROM part) AS mean_tokens,
    count(*) AS mentions, count(DISTINCT key) AS distinct_mentions, count(DISTINCT type) AS types, (SELECT count(*) FROM (SELECT DISTINCT key FROM s WHERE key NOT IN (SELECT key FROM l))) AS novel FROM s""")
def corpus_description(spark, sf):
    from ..operators.reports import corpus_description as describe

    s = table(spark, sf, "part").select(ft.tokenize(F.col("p_name")).alias("tokens"))
    m, t = (named(spark, sf, labelled).withColumn("key", ft.normalize_mention(F.col("surface"))) for labelled in (False, True))
    return six(describe(m, s, t))


@query(f"""WITH {SCORE_SQL}, r AS (SELECT lang, source, avg(overall) AS mean_score, min(overall) AS min_score, avg(CAST(overall >= 0.75 AS INTEGER)) AS share_passed, avg(completeness) AS mean_completeness FROM z GROUP BY ALL)
    SELECT lang AS run, source AS sid, round(mean_score, 6) AS mean_score, round(min_score, 6) AS min_score, round(share_passed, 6) AS share_passed, round(mean_completeness, 6) AS mean_completeness FROM r""")
def sentence_rollup(spark, sf):
    from ..operators.reports import sentence_rollup as rollup

    return six(rollup(reviewed(spark, sf).withColumn("run", F.col("lang")).withColumn("sid", F.col("source"))))


@query()
def sentence_correlations(spark, sf):
    from ..operators.reports import sentence_correlations as correlations

    rows = reviewed(spark, sf).withColumn("run", F.col("lang")).withColumn("sid", F.col("source"))
    return six(correlations(rows, rows.groupBy("run", "sid").agg(F.avg("y").alias("f1"))))


@query(f"""{MATCHED}, k AS (SELECT sid, sum(tp) AS ta, sum(fp) AS fa, sum(fn) AS na, sum(tp + fn) AS tb FROM m GROUP BY sid), {weights_sql('k', 'sid', 30)},
    o AS (SELECT 2 * sum(tb) / greatest(2 * sum(tb), 1) - 2 * sum(ta) / greatest(2 * sum(ta) + sum(fa) + sum(na), 1) AS delta FROM k), z AS (SELECT rep, k.*, {draws_sql(7, '2', 'rep', 'sid')} = 1 AS swap FROM range(30) r(rep), k),
    f AS (SELECT rep, 2 * sum(if(swap, ta, tb)) / greatest(2 * sum(if(swap, ta, tb)) + sum(if(swap, fa + na, 0)), 1) - 2 * sum(if(swap, tb, ta)) / greatest(2 * sum(if(swap, tb, ta)) + sum(if(swap, 0, fa + na)), 1) AS d FROM z GROUP BY rep),
    b AS (SELECT rep, 2 * sum(w * tb) / greatest(2 * sum(w * tb), 1) - 2 * sum(w * ta) / greatest(2 * sum(w * ta) + sum(w * fa) + sum(w * na), 1) AS d FROM ww JOIN k USING (sid) GROUP BY rep),
    c AS (SELECT 'gold against tagging' AS name, delta, (SELECT quantile_cont(d, 0.025) FROM b) AS low, (SELECT quantile_cont(d, 0.975) FROM b) AS high, (SELECT count_if(abs(d) >= abs(delta) - 1e-12) + 1 FROM f) / 31.0 AS p FROM o UNION ALL SELECT 'tagging against itself', 0, 0, 0, 1),
    h AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i FROM c)
    SELECT name, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(least(1, max((3 - i) * p) OVER (ORDER BY i)), 6) AS p_holm FROM h""")
def run_comparisons(spark, sf):
    from ..operators.reports import comparisons

    g, p = sides(spark, sf)
    a, b = ev.sentence_counts(g, p), ev.sentence_counts(g, g)
    return six(comparisons({"gold against tagging": ev.paired(a, b), "tagging against itself": ev.paired(a, a)}, 30))


@query(f"""WITH {SCORE_SQL}, l AS (UNPIVOT (SELECT y, congruence, coverage, "constraint", completeness, consistency FROM z) ON congruence, coverage, "constraint", completeness, consistency INTO NAME criterion VALUE v), {auroc_sql('l', 'criterion', 'v', 'y')}
    SELECT criterion, round(CASE WHEN sum(pos) >= 30 AND sum(neg) >= 30 THEN {AUROC} END, 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b GROUP BY criterion""")
def discrimination(spark, sf):
    return six(st.discrimination(reviewed(spark, sf), sc.CRITERIA))


TWO_SIDED = "round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(d) AS replicates, round(least(1.0, 2 * least(avg(CAST(d <= 0 AS INTEGER)), avg(CAST(d >= 0 AS INTEGER)))), 6) AS p"


@query(f"""WITH {SCORED_SQL}, {weights_sql('d', 'source', 20)}, l AS (SELECT rep, 's' AS k, s AS v, y, w FROM d JOIN ww USING (source) UNION ALL SELECT rep, 't', t, y, w FROM d JOIN ww USING (source)), {auroc_sql('l', 'rep, k', 'v', 'y', 'w')},
    r AS (SELECT rep, k, {NO_ZERO} AS a FROM b GROUP BY ALL), f AS (SELECT max(a) FILTER (k = 't') - max(a) FILTER (k = 's') AS d FROM r GROUP BY rep) SELECT {TWO_SIDED} FROM f""")
def paired_auroc_difference(spark, sf):
    return six(rs.paired_auroc_difference(scored(spark, sf), "source", "s", "t", reps=20))


@query(f"""WITH {SCORED_SQL}, {weights_sql('documents', 'source', 50)}, m AS (SELECT source, lang, sum(s) AS v, count(s) AS n FROM d GROUP BY ALL),
    f AS (SELECT sum(w * v) FILTER (lang = 'fr') / nullif(sum(w * n) FILTER (lang = 'fr'), 0) - sum(w * v) FILTER (lang = 'en') / nullif(sum(w * n) FILTER (lang = 'en'), 0) AS d FROM ww LEFT JOIN m USING (source) GROUP BY rep) SELECT {TWO_SIDED} FROM f""")
def condition_contrast(spark, sf):
    rows = scored(spark, sf)
    return six(rs.contrast(rows, table(spark, sf, "documents").select("source"), "source", "lang", "s", "en", "fr", 50))


@query()
def learned_scorer(spark, sf):
    from ..operators.learn import out_of_fold

    rows = scored(spark, sf).select("doc_id", "source", "s", "t", "p", "y")
    return six(out_of_fold(rows.withColumnRenamed("p", "q"), ["s", "t", "q"], "source", folds=2).select("doc_id", "p"))


@query("""WITH e AS (SELECT DISTINCT user_id AS key FROM events), d AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'purchase' AND value > 90), f AS (SELECT user_id AS key FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 12)
    SELECT key FROM e WHERE key NOT IN (SELECT key FROM d) AND key NOT IN (SELECT key FROM f)""")
def queue_pending(spark, sf):
    from ..streaming.queue import pending

    e = table(spark, sf, "events").withColumn("key", F.col("user_id"))
    return pending(e.select("key").distinct(), e.where("event_type = 'purchase' AND value > 90"), e.where("event_type = 'error'"), 12)


@query("SELECT DISTINCT sha256('m' || chr(0) || d.text) AS key FROM documents d ANTI JOIN benchmark b ON d.text = b.text")
def missing_embeddings(spark, sf):
    cache = table(spark, sf, "benchmark").select(F.sha2(F.concat(F.lit("m\u0000"), "text"), 256).alias("key"))
    return vc.missing_embeddings(table(spark, sf, "documents").select("text"), cache, "m").select("key")


INTEGER_SQL = "'http://www.w3.org/2001/XMLSchema#integer'"


@query(f"""WITH k AS (SELECT {KEY_SQL} AS key, p_brand AS type, count(*) AS n, min(p_partkey) AS pos FROM part GROUP BY ALL), f AS (SELECT key, min(pos) AS pos FROM k GROUP BY key),
    i AS (SELECT key, p_name AS label, 'urn:lexicon:entry/' || row_number() OVER (ORDER BY key) AS node FROM f JOIN part ON p_partkey = pos), t AS (SELECT node, node || '/type/' || (row_number() OVER (PARTITION BY key ORDER BY type) - 1) AS link, type, n FROM k JOIN i USING (key))
    SELECT node AS s, 'urn:lexicon:label' AS p, label AS o, NULL AS datatype FROM i UNION ALL SELECT node, 'urn:lexicon:outside', '0', {INTEGER_SQL} FROM i UNION ALL SELECT node, 'urn:lexicon:annotatedAs', link, 'uri' FROM t
    UNION ALL SELECT link, 'urn:lexicon:type', 'urn:lexicon:class/' || type, 'uri' FROM t UNION ALL SELECT link, 'urn:lexicon:frequency', CAST(n AS VARCHAR), {INTEGER_SQL} FROM t""")
def index_triples(spark, sf):
    from ..sources.sinks import index_triples as triples

    return triples(lx.surface_index(mentions(spark, sf)))


