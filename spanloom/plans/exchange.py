"""More queries over the driver's tables: files written and read back, alignment, graphs, selections, and resumed work.

They register beside those of :mod:`spanloom.plans.catalogue`. What a query writes lies below the shared folder (:func:`spanloom.sources.sinks.scratch`).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as fs
from ..functions import text as ft
from ..operators import evaluate as ev
from ..operators import learn as ln
from ..operators import lexicon as lx
from ..operators import reports as rp
from ..operators import resampling as rs
from ..operators import sampling as sm
from ..operators import scorecard as sc
from ..operators import similarity as si
from ..operators import spans as sp
from ..operators import stats as st
from ..operators import vectors as vc
from ..sources import readers, sinks
from ..streaming import queue
from .catalogue import BOTH, GOLD, KEY_SQL, MATCHED, NO_ZERO, PRED, SCORED_SQL, TOKENS_SQL, TWO_SIDED, auroc_sql, mentions, query, scored, sides, six, spans, spans_sql, table, two_runs, weights_sql

# ---- files written and read back


@query("SELECT doc_id, lang, source, md5(text) AS digest FROM documents")
def jsonl_records(spark, sf):
    """Appended JSON lines, and a later append that broke off in its first line."""
    path = sinks.scratch(spark)
    sinks.append_records(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), path)
    spark.range(1).select(F.lit('{"doc_id": 7, "lang": "e').alias("value")).write.mode("append").text(path)
    return readers.read_jsonl(spark, path, "doc_id long, lang string, source string, text string").select("doc_id", "lang", "source", F.md5("text").alias("digest"))


def tokens_in_order(spark, sf) -> DataFrame:
    """Events as tokens: a user's events lie together, in order."""
    return table(spark, sf, "events").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")


@query(f"WITH {spans_sql('g', GOLD)} SELECT 'events:train:' || sid AS sid, s, e, type FROM g")
def bio_csv(spark, sf):
    path = sinks.scratch(spark)
    rows = tokens_in_order(spark, sf).select(F.col("event_type").alias("words"), F.col("user_id").cast("string").alias("sentence_id"), F.expr(GOLD).alias("labels"))
    rows.write.option("header", True).csv(path)
    return readers.read_bio_csv(spark, path, "events", "train", ["click", "view", "error"]).select("sid", F.inline("spans"))


IOB = "CASE event_type WHEN 'click' THEN '{}' WHEN 'view' THEN '{}' WHEN 'error' THEN '{}' ELSE '{}' END"
IOB_READ = IOB.format("B-click", "B-imaging_procedure", "I-adverse_event", "O")


@query(f"SELECT CAST(event_id AS VARCHAR) AS token, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i, {IOB_READ} AS label FROM events")
def iob_lines(spark, sf):
    path = sinks.scratch(spark)
    rows = tokens_in_order(spark, sf).withColumn("first", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"))
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.lit("_"), F.expr(IOB.format("b-Click", "B-ImagingProcedure", "I-adverseevent", "o")))
    rows.select(F.concat(F.when(F.col("first"), "\n").otherwise(""), line).alias("value")).write.text(path)
    cells = readers.read_iob(spark, path).select(F.posexplode(F.arrays_zip("tokens", "labels")).alias("i", "c"))
    return cells.select(F.col("c.tokens").alias("token"), "i", F.col("c.labels").alias("label"))


# Valid in both languages: a name with signs that N-Triples writes behind a backslash.
ODD = "p_name || chr(92) || 'new' || chr(9) || chr(34) || chr(10) || chr(13) || chr(92)"


@query(f"SELECT 'urn:part:' || p_partkey AS s, 'urn:name' AS p, {ODD} AS o, true AS literal FROM part UNION ALL SELECT 'urn:part:' || p_partkey, 'urn:type', 'urn:type:' || p_type, false FROM part")
def ntriples_text(spark, sf):
    path = sinks.scratch(spark)
    node = F.concat(F.lit("urn:part:"), F.col("p_partkey").cast("string")).alias("s")
    rows = table(spark, sf, "part")
    named = rows.select(node, F.lit("urn:name").alias("p"), F.expr(ODD).alias("o"), F.lit(None).cast("string").alias("datatype"))
    sinks.write_ntriples(named.union(rows.select(node, F.lit("urn:type"), F.concat(F.lit("urn:type:"), "p_type"), F.lit("uri"))), path)
    return readers.read_ntriples(spark, path).select("s", "p", "o", "literal")


@query(f"WITH {spans_sql('g', GOLD)} SELECT CAST(sid AS VARCHAR) AS sid, s, e, type, 'gold' AS label_source FROM g")
def silver_file(spark, sf):
    path = sinks.scratch(spark)
    cells = F.transform("spans", lambda x: F.array(x["s"].cast("string"), x["e"].cast("string"), x["type"]))
    rows = sp.collect_spans(spans(spark, sf, GOLD)).select(F.col("sid").cast("string").alias("sid"), F.array().cast("array<string>").alias("tokens"), cells.alias("spans"), F.lit("gold").alias("label_source"))
    sinks.append_records(rows, path)
    return readers.read_silver(spark, path).select("sid", "label_source", F.inline("spans"))


@query(f"""SELECT {KEY_SQL} AS key, count(*) AS total, 'train' AS origin, count(*) AS doubted FROM part GROUP BY ALL
    UNION ALL SELECT lower(p_type), count(*), 'synthetic', NULL FROM part GROUP BY ALL""")
def stored_index(spark, sf):
    """The index of part names and a synthetic one of names and types, both stored, and read as one."""
    train, made = sinks.scratch(spark), sinks.scratch(spark)
    rows = table(spark, sf, "part")
    lx.surface_index(mentions(spark, sf)).write.parquet(train)
    again = mentions(spark, sf).withColumn("type", F.lit("doubted"))
    kinds = rows.select(F.col("p_partkey").alias("sid"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit("kind").alias("type"), F.col("p_type").alias("surface"), F.col("p_partkey").alias("pos"))
    source = again.unionByName(kinds)
    sinks.add_synthetic_index(lx.surface_index(source), source.withColumn("track", F.lit("open")), "open", made)
    index = readers.read_index(spark, train, made)
    return index.select("key", "total", "origin", F.try_element_at("synthetic_types", F.lit("doubted")).alias("doubted"))


# The spellings of domains in this query's file and the types they stand for.
DOMAINS = {"ECONOMY": "economy", "Small": "small", "promo": "promo", "LAR GE": "large", "STANDARD": "standard", "MEDIUM": "medium"}


@query("""SELECT p_name || ' ' || replace(p_brand, '#', ' # ') AS words, p_retailprice AS value, lower(p_type) AS type, count(*) AS n FROM part GROUP BY ALL""")
def synthetic_corpus(spark, sf):
    path = sinks.scratch(spark)
    rows = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("sentence"), F.col("p_retailprice").alias("value"), F.lit(0.7).alias("temperature"), F.concat(F.lit("  "), F.substring("p_type", 1, 3), F.lit(" "), F.lower(F.substring("p_type", 4, 99)), F.lit(" ")).alias("domain"))
    rows.write.option("header", True).csv(path)
    back = readers.read_synthetic(spark, path, "parts", DOMAINS)
    return back.groupBy(F.array_join("tokens", " ").alias("words"), "value", "type").agg(F.count("*").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS custom_id, CASE WHEN n_chars > 500 THEN source ELSE lang END AS content FROM documents WHERE CASE WHEN n_chars > 500 THEN source ELSE lang END IS NOT NULL")
def stored_answers(spark, sf):
    """Answers whose rows for short documents are torn, with repairs for all."""
    first, repairs = sinks.scratch(spark), sinks.scratch(spark)
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", "lang", "n_chars")

    def line(content: str):
        return F.to_json(F.struct("id", F.col(content).alias("content")))

    rows.select(F.when(F.col("n_chars") > 500, line("source")).otherwise(F.substring(line("source"), 1, 9)).alias("value")).write.text(first)
    rows.where("n_chars <= 500").select(line("lang").alias("value")).write.text(repairs)
    return readers.read_answers(spark, first, repairs)


@query("SELECT n_name AS heading, 'In region ' || n_regionkey || '.' AS body FROM nation")
def markdown_items(spark, sf):
    path = sinks.scratch(spark)
    item = F.concat(F.lit("# Nations\n\n### "), F.col("n_name"), F.lit("\n\nIn region "), F.col("n_regionkey").cast("string"), F.lit(".\n"))
    table(spark, sf, "nation").select(item.alias("value")).write.text(path)
    items = readers.read_markdown_items(spark, path)
    return items.select("heading", F.substring_index("body", "\n", 1).alias("body"))


@query(f"WITH {SCORED_SQL} SELECT 'a' AS run, doc_id, round(s, 6) AS s FROM d WHERE kg_best IS NOT NULL UNION ALL SELECT 'b', doc_id, round(t, 6) FROM d")
def scored_runs(spark, sf):
    """Two runs, stored as parts of one table; rows without a span are left out."""
    path = sinks.scratch(spark)
    rows = scored(spark, sf)
    sinks.write_scored(rows.select("doc_id", "s", F.when(F.col("kg_best").isNotNull(), F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"))).alias("span")), path, "a")
    sinks.write_scored(rows.select("doc_id", F.col("t").alias("s"), F.struct(F.lit(0).alias("s"), F.lit(1).alias("e")).alias("span")), path, "b")
    return six(readers.read_scored(spark, [path]).select("run", "doc_id", "s"))


# ---- text and prompts


@query("SELECT p_partkey, sha256(p_name || chr(0) || '{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || ',\"p_brand\":\"' || p_brand || '\"}') AS digest FROM part")
def row_hashes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ft.content_hash(F.col("p_name"), ft.row_json("p_partkey", "p_size", "p_brand")).alias("digest"))


@query("""SELECT p_partkey, '[SYSTEM]' || chr(10) || 'Mark names.' || chr(10) || chr(10) || 'Known facts:' || chr(10) || '- "' || p_name || '": annotated as ' || p_brand || ' (' || (p_size + 2) || 'x), other (1x)' || CASE WHEN p_size % 2 > 0 THEN '; seen ' || (p_size % 2) || 'x outside mentions' ELSE '' END || '; closest known form: ' || p_type
    || chr(10) || chr(10) || '[USER]' || chr(10) || p_type || chr(10) || chr(10) || '[ASSISTANT]' || chr(10) || '{"entities":[{"text":"' || split_part(p_name, ' ', 1) || '","type":"' || p_brand || '"}]}' || chr(10) || chr(10) || '[USER]' || chr(10) || p_name AS prompt FROM part""")
def prompt_texts(spark, sf):
    c = F.col
    types = F.create_map(F.lit("other"), F.lit(1).cast("long"), c("p_brand"), (c("p_size") + 2).cast("long"))
    fact = ft.render_fact(c("p_name"), types, c("p_size") % 2, c("p_type"))
    answer = ft.gold_answer(F.split("p_name", " "), F.array(fs.span(F.lit(0), F.lit(1), c("p_brand"))))
    shown = F.array(F.struct(c("p_type").alias("text"), answer.alias("answer")))
    return table(spark, sf, "part").select("p_partkey", ft.render_messages(ft.build_messages(F.lit("Mark names."), F.array(fact), shown, c("p_name"))).alias("prompt"))


@query("SELECT DISTINCT p_type, lower(p_type) AS domain, CASE WHEN p_type = 'SMALL' THEN 'Small' WHEN p_type = 'PROMO' THEN 'PROMO' END AS known, p_type AS local, split_part(p_brand, '#', 2) AS number FROM part")
def names(spark, sf):
    c = F.col("p_type")
    rows = table(spark, sf, "part")
    spaced = F.concat(F.lit(" "), F.substring(c, 1, 2), F.lit(" "), F.substring(c, 3, 99))
    return rows.select("p_type", ft.normalize_domain(spaced).alias("domain"), ft.case_insensitive(F.concat(F.lit(" "), F.initcap(c)), {"small": "Small", "Promo": "PROMO"}).alias("known"), ft.uri_local_name(F.concat(F.lit("urn:x/kinds#"), c)).alias("local"), ft.uri_local_name(F.col("p_brand")).alias("number")).distinct()


# ---- spans and alignment


@query(f"""WITH {spans_sql('g', GOLD)}, w AS (SELECT user_id AS sid, event_type AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT g.sid, g.s, g.e, string_agg(w.w, ' ' ORDER BY w.i) AS mention FROM g JOIN w ON w.sid = g.sid AND w.i >= g.s AND w.i < g.e GROUP BY g.sid, g.s, g.e""")
def mention_texts(spark, sf):
    words = table(spark, sf, "events").groupBy(F.col("user_id").alias("sid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("tokens"))
    return spans(spark, sf, GOLD).join(words, "sid").select("sid", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), ft.mention_text(F.col("tokens"), F.col("s"), F.col("e")).alias("mention"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS t, upper(lang) AS x FROM documents), w AS (SELECT doc_id, x, list_contains(t, x) AS exact, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS s, CAST(i AS INTEGER) AS e FROM w WHERE CASE WHEN exact THEN w = x ELSE lower(w) = lower(x) END""")
def occurrences(spark, sf):
    """Where a document's language code stands in its text as a word, in capitals or, where it never does, in any case."""
    found = fs.align(ft.tokenize(F.col("text")), F.upper("lang"), F.lit("code"))
    return table(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.inline(found)).select("doc_id", "s", "e")


@query("""WITH t AS (SELECT p_partkey, p_size % 8 AS a, p_size % 8 + 1 + p_size % 5 AS b, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y FROM part),
    h AS (SELECT p_partkey, a < length(x) AS one, length(x) + 1 < b AND a < length(x) + 1 + length(y) AS two FROM t)
    SELECT p_partkey, CASE WHEN one THEN 0 WHEN two THEN 1 END AS s, CASE WHEN two THEN 2 WHEN one THEN 1 END AS e FROM h""")
def character_spans(spark, sf):
    at = fs.chars_to_tokens(F.split("p_name", " "), F.expr("p_size % 8"), F.expr("p_size % 8 + 1 + p_size % 5"))
    return table(spark, sf, "part").select("p_partkey", at.alias("x")).select("p_partkey", "x.s", "x.e")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '  ' || upper(p_name) ELSE p_name END AS aligned, CASE WHEN p_size % 2 = 0 THEN 'second' ELSE 'third' END AS unaligned FROM part")
def entities_of_spans(spark, sf):
    c = F.col
    kind = F.when(c("p_size") % 2 == 0, c("p_brand")).otherwise(c("p_type"))

    def entity(text, kind, form: str):
        return F.struct(text.alias("text"), kind.alias("type"), F.lit(form).alias("normalized_form"))

    upper = F.concat(F.lit("  "), F.upper("p_name"))
    found = F.array(entity(F.concat(upper, F.lit("s")), c("p_brand"), "first"), entity(upper, c("p_brand"), "second"), entity(c("p_name"), c("p_type"), "third"))
    tokens = F.split("p_name", " ")
    whole = fs.span(F.lit(0), F.size(tokens), kind)
    said = F.when(c("p_size") % 2 == 0, F.upper("p_name")).otherwise(c("p_name"))
    return table(spark, sf, "part").select("p_partkey", fs.entity_of(tokens, whole, found)["text"].alias("aligned"), fs.source_of(F.concat(said, F.lit(" ")), kind, found)["normalized_form"].alias("unaligned"))


FRAGMENTS = ["event_type AS type", "10 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS start", "CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '-' END AS gap"]


@query(f"""WITH r AS (SELECT user_id AS sid, {', '.join(FRAGMENTS)}, event_id % 4 AS late, value FROM events), f AS (SELECT *, start + 7 + late AS stop FROM r),
    o AS (SELECT *, NOT coalesce(lag(type) OVER w = type AND start <= lag(stop) OVER w + 2 AND gap = '-', false) AS opens FROM f WINDOW w AS (PARTITION BY sid ORDER BY start)),
    n AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY sid ORDER BY start) AS nth FROM o)
    SELECT sid, min(start) AS "from", max(stop) AS "to", min(type) AS type, round(avg(value), 6) AS confidence FROM n GROUP BY sid, nth""")
def merged_fragments(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id AS sid", *FRAGMENTS, "event_id % 4 AS late", "array(value) AS probs")
    rows = rows.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("start") + 7 + F.col("late"))
    return six(sp.merge_fragments(rows).select("sid", F.col("start").alias("from"), F.col("end").alias("to"), "type", "confidence"))


@query(f"{BOTH}, n AS (SELECT sid, count(*) AS n FROM p GROUP BY sid) SELECT sid, coalesce(n, 0) AS n, n IS NULL AS abandoned FROM (SELECT DISTINCT user_id AS sid FROM events) LEFT JOIN n USING (sid)")
def absent_records(spark, sf):
    subset = table(spark, sf, "events").select(F.col("user_id").alias("sid")).distinct()
    records = sp.collect_spans(spans(spark, sf, PRED)).withColumnRenamed("spans", "pred")
    return ev.with_absent(subset, records).select("sid", F.size("pred").cast("long").alias("n"), "abandoned")


@query(f"""WITH {spans_sql('g', GOLD)}, q AS (SELECT type, count(*) AS n FROM g GROUP BY type), r AS (SELECT sid, arg_min(type, (n, type)) AS stratum FROM g JOIN q USING (type) GROUP BY sid)
    SELECT sid, coalesce(stratum, 'none') AS stratum FROM (SELECT DISTINCT user_id AS sid FROM events) LEFT JOIN r USING (sid)""")
def rarest_types(spark, sf):
    return sm.rarest_type(spans(spark, sf, GOLD), table(spark, sf, "events").select(F.col("user_id").alias("sid")))


# ---- lexicon


@query(f"""WITH k AS (SELECT {KEY_SQL} AS key, p_brand AS type, count(*) AS n, min(p_partkey) AS pos FROM part GROUP BY ALL), b AS (SELECT key, arg_min(type, (-n, pos)) AS type, max(n) AS n, sum(n) AS total FROM k GROUP BY key)
    SELECT key, type FROM b WHERE total >= 2 AND n >= 0.1 * total""")
def gazetteer(spark, sf):
    return lx.gazetteer(lx.surface_index(mentions(spark, sf)), purity=0.1)


@query("SELECT DISTINCT lower(p_name) AS key FROM part WHERE length(p_name) >= 5 EXCEPT SELECT lower(p_brand) FROM part EXCEPT SELECT lower(p_type) FROM part")
def novel_mentions(spark, sf):
    rows = table(spark, sf, "part")

    def keys(*names: str) -> DataFrame:
        return rows.select(F.explode(F.array(*[ft.normalize_mention(F.col(n)) for n in names])).alias("key"))

    return lx.novel_mentions(keys("p_name", "p_brand", "p_type"), keys("p_brand", "p_type"))


@query("""WITH b AS (SELECT p_name, arg_min(p_type, (-p_size, p_partkey)) AS pred FROM part GROUP BY p_name)
    SELECT p_partkey, CASE WHEN p_size = 1 THEN 'unavailable: entity type is not a project type' WHEN pred = p_type THEN 'agreed' ELSE 'disagreed' END AS bert_status, CASE WHEN p_size <> 1 THEN pred = p_type END AS agreed FROM part JOIN b USING (p_name)""")
def cross_checks(spark, sf):
    rows = table(spark, sf, "part")
    entities = rows.select("p_partkey", F.col("p_name").alias("text"), F.when(F.col("p_size") != 1, F.col("p_type")).alias("kind"))
    predictions = rows.select(F.col("p_name").alias("text"), F.col("p_type").alias("pred_type"), (F.col("p_size") / 50).alias("p"), F.col("p_partkey").alias("pos"))
    return sc.cross_check(entities, predictions).select("p_partkey", "bert_status", "agreed")


# ---- graphs


def turtle_graph(spark, sf) -> DataFrame:
    """Nations and regions as nodes with labels and classes, from Turtle files."""
    path = sinks.scratch(spark)
    parts = []
    for name, kind in (("nation", "Nation"), ("region", "Region")):
        rows = table(spark, sf, name)
        key, label = (F.col(f"{name[0]}_{x}").cast("string") for x in (f"{name}key", "name"))
        node = F.concat(F.lit(f"<urn:{name}:"), key, F.lit(">"))
        parts.append(rows.select(F.concat(node, F.lit(' <urn:label> "'), label, F.lit('" .\n'), node, F.lit(f" <urn:kind> <http://example.org/x#{kind}> .")).alias("value")))
    schema = spark.range(1).select(F.lit('<http://example.org/x#Nation> <urn:label> "Nation" .').alias("value"))
    parts[0].union(parts[1]).union(schema).write.text(path)
    statement = r'<([^>]*)> <([^>]*)> (?:<([^>]*)>|"([^"]*)") \.'

    def parse(content: str) -> list[tuple[str, str, str, bool]]:
        return [(s, p, node or text, not node) for s, p, node, text in re.findall(statement, content)]

    return readers.read_turtle(spark, [path], parse).select("s", "p", "o", "literal")


LABEL_SQL = "regexp_replace(lower({}), '[^a-z0-9\\s]', '', 'g')"
GRAPH_SQL = f"l AS (SELECT 'urn:nation:' || n_nationkey AS uri, {LABEL_SQL.format('n_name')} AS label, 'Nation' AS kinds FROM nation UNION ALL SELECT 'urn:region:' || r_regionkey, {LABEL_SQL.format('r_name')}, 'Region' FROM region)"


@query(f"WITH {GRAPH_SQL} SELECT * FROM l")
def graph_labels(spark, sf):
    labels = readers.graph_labels(turtle_graph(spark, sf), "urn:label", "urn:kind")
    return labels.select("uri", "label", F.array_join("kinds", ",").alias("kinds"))


@query(f"WITH {GRAPH_SQL} SELECT 'land' AS type, count(DISTINCT uri) AS nodes, count(DISTINCT label) AS labels FROM l WHERE kinds = 'Nation' UNION ALL SELECT NULL, count(DISTINCT uri), count(DISTINCT label) FROM l")
def graph_statistics(spark, sf):
    return rp.kg_stats(readers.graph_labels(turtle_graph(spark, sf), "urn:label", "urn:kind"), {"Nation": "land"})


@query("""WITH q AS (SELECT n_name AS source, n_nationkey, n_regionkey, r_regionkey, r_name AS target FROM nation, region)
    SELECT source, 'urn:in' AS predicate, target, 'urn:nation:' || n_nationkey AS s, 'urn:region:' || r_regionkey AS o, n_regionkey = r_regionkey AS found, CAST(1 AS BIGINT) AS objects FROM q""")
def relation_lookup(spark, sf):
    """Whether each nation lies in each region."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    asked = nation.select(F.col("n_name").alias("source"), F.lit("urn:in").alias("predicate")).join(F.broadcast(region.select(F.col("r_name").alias("target"))))  # 25 x 5 rows at every size
    facts = nation.select(F.concat(F.lit("urn:nation:"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("urn:in").alias("p"), F.concat(F.lit("urn:region:"), F.col("n_regionkey").cast("string")).alias("o"))
    return si.find_relations(asked, readers.graph_labels(turtle_graph(spark, sf), "urn:label", "urn:kind"), facts)


@query("""WITH f AS (SELECT p_type AS q, 'urn:' || p_brand AS uri, p_name AS label, p_size / 50.0 AS similarity FROM part UNION ALL SELECT p_type, 'urn:' || p_brand, p_name, ((p_size * 7) % 50) / 50.0 FROM part),
    b AS (SELECT q, uri, arg_min(label, (-similarity, label)) AS label, max(similarity) AS similarity FROM f GROUP BY q, uri), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, label, uri) AS rank FROM b)
    SELECT q, uri, label, round(CAST(similarity AS DOUBLE), 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def merged_matches(spark, sf):
    def found(similarity: str) -> DataFrame:
        return table(spark, sf, "part").select(F.col("p_type").alias("q"), F.lit(None).cast("string").alias("kind"), F.concat(F.lit("urn:"), "p_brand").alias("uri"), F.col("p_name").alias("label"), F.expr(similarity).alias("similarity"))

    return six(si.merge_matches(found("p_size / 50"), found("((p_size * 7) % 50) / 50")).select("q", "uri", "label", "similarity", "rank"))


@query("""WITH t AS (SELECT 'urn:nation:' || n_nationkey AS s, 'urn:label' AS p, n_name AS o, true AS literal FROM nation), e AS (SELECT coalesce(t.s, 'urn:entity:' || sha256(l)) AS s, l, c FROM (SELECT n_name AS l, 'urn:Nation' AS c FROM nation UNION SELECT r_name, 'urn:Region' FROM region) LEFT JOIN t ON t.o = l)
    SELECT * FROM t UNION SELECT s, 'urn:label', l, true FROM e UNION SELECT s, 'urn:kind', c, false FROM e
    UNION SELECT a.s, 'urn:in', b.s, false FROM nation JOIN region ON n_regionkey = r_regionkey JOIN e a ON a.l = n_name JOIN e b ON b.l = r_name""")
def inserted_nodes(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    graph = nation.select(F.concat(F.lit("urn:nation:"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("urn:label").alias("p"), F.col("n_name").alias("o"), F.lit(True).alias("literal"))
    entities = nation.select(F.col("n_name").alias("label"), F.lit("urn:Nation").alias("kind_uri")).union(region.select("r_name", F.lit("urn:Region")))
    relations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.lit("urn:in").alias("predicate"), F.col("r_name").alias("target"))
    return sinks.insert_relations(sinks.insert_entities(graph, entities, "urn:label", "urn:kind"), relations, "urn:label")


# ---- statistics and reports

STATUS = "CASE WHEN n_chars > 1500 THEN 'matched' WHEN n_chars > 600 THEN 'partial' ELSE 'novel' END"


@query(f"SELECT source AS kind, count_if({STATUS} = 'matched') AS matched, count_if({STATUS} = 'partial') AS partial, count_if({STATUS} = 'novel') AS novel FROM documents GROUP BY source")
def validation_counts(spark, sf):
    return si.validation_summary(table(spark, sf, "documents").selectExpr("source AS kind", f"{STATUS} AS status"))


@query("WITH r AS (SELECT DISTINCT doc_id AS id FROM documents), a AS (SELECT DISTINCT item_id AS id FROM benchmark UNION SELECT -1) SELECT count(r.id) AS requests, count_if(r.id IS NOT NULL AND a.id IS NOT NULL) AS answered, count_if(a.id IS NULL) AS missing, count_if(r.id IS NULL) AS unexpected FROM r FULL JOIN a USING (id)")
def batch_completeness(spark, sf):
    answers = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("custom_id")).union(spark.range(1).select(F.lit("-1")))
    return rp.completeness_of_batches(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("custom_id")), answers)


@query(f"WITH {SCORED_SQL} SELECT doc_id, round((t - s) / (0.9999999 - s), 6) AS share FROM d")
def gap_shares(spark, sf):
    return six(scored(spark, sf).select("doc_id", st.gap_closed(F.col("s"), F.col("t"), F.lit(0.9999999)).alias("share")))


@query(f"WITH {SCORED_SQL}, r AS (SELECT source, p, s, row_number() OVER (PARTITION BY source ORDER BY round(s, 10) DESC, p) AS n FROM d) SELECT source, round(p, 6) AS p, round(s, 6) AS s FROM r WHERE n = 1")
def best_settings(spark, sf):
    return six(ln.best_setting(scored(spark, sf), "p", "s", ["source"]).select("source", "p", "s"))


@query(f"WITH {SCORED_SQL} SELECT count(*) AS rows, true AS equal FROM d")
def same_predictions(spark, sf):
    rows = scored(spark, sf).select("doc_id", "p")
    return ln.same_predictions(rows, rows.withColumn("p", F.col("p") + 1e-12), "doc_id")


F1_SQL = "2 * sum(w * {0}) / greatest(2 * sum(w * {0}) + sum(w * {1}) + sum(w * {2}), 1)"


@query(f"""{MATCHED}, k AS (SELECT sid, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp + fn) AS gold, 0 AS nil FROM m GROUP BY sid), {weights_sql('k', 'sid', 50)},
    f AS (SELECT rep, ({F1_SQL.format('gold', 'nil', 'nil')} - {F1_SQL.format('tp', 'fp', 'fn')}) - ({F1_SQL.format('tp', 'fp', 'fn')} - {F1_SQL.format('tp', 'gold', 'fn')}) AS d FROM ww JOIN k USING (sid) GROUP BY rep) SELECT {TWO_SIDED} FROM f""")
def difference_of_differences(spark, sf):
    """What the gold run gains over the predictions, against what those gain over a run with a wrong span for each gold one."""
    four = two_runs(spark, sf)
    worse = [F.col("tp_a").alias("tp_c"), (F.col("tp_b") + F.col("fn_b")).alias("fp_c"), F.col("fn_a").alias("fn_c")]
    return six(rs.difference_of_differences(four.select("*", *worse, *[F.col(f"{c}_a").alias(f"{c}_d") for c in ("tp", "fp", "fn")]), 50))


@query(f"""WITH {SCORED_SQL}, {weights_sql('d', 'source', 20)}, x AS (SELECT rep, s, y, w FROM d JOIN ww USING (source)), {auroc_sql('x', 'rep', 's', 'y', 'w')}, f AS (SELECT {NO_ZERO} - 0.5 AS d FROM b GROUP BY rep) SELECT {TWO_SIDED} FROM f""")
def auroc_p(spark, sf):
    return six(rs.auroc_p(scored(spark, sf), "source", "s", reps=20))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, CAST(1.0 AS DOUBLE) AS own, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM v""")
def unit_vectors(spark, sf):
    e = F.col("embedding").cast("array<double>")
    pooled = vc.mean_pool(F.array(e, F.reverse(e)), F.array(F.lit(1), F.lit(0)))
    return six(table(spark, sf, "embeddings").select("vec_id", vc.norm(e).alias("norm"), vc.dot(vc.unit(e), vc.unit(e)).alias("own"), pooled[0].alias("first")))


# ---- resumed work


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(1 AS INTEGER) AS attempt, upper(c_name) AS result, false AS abandoned FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(n AS INTEGER), NULL, n = 3 FROM customer, range(1, 4) r(n) WHERE c_acctbal < 0""")
def resumed_work(spark, sf):
    """Items that come five times: done once, or given up after three attempts. A stream over files, drained once."""
    path, out, state = (sinks.scratch(spark) for _ in range(3))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.to_json(F.struct("c_name", "c_acctbal")).alias("payload"))
    rows.select("key", "payload", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("time")).write.parquet(path)

    def process(key: str, payload: str) -> str:
        import json

        row = json.loads(payload)
        if row["c_acctbal"] < 0:
            raise ValueError("no credit")
        return row["c_name"].upper()

    stream = spark.readStream.schema("key string, payload string, time int").parquet(path)
    queue.drain(queue.work(stream, process, attempts=3), out, state)
    return spark.read.parquet(out).select("key", "attempt", "result", "abandoned")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_size % 5 > 0 THEN upper(p_name) END AS content, CASE WHEN p_size % 5 = 0 THEN 'TimeoutError: busy' END AS error, CAST(CASE WHEN p_size % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS tries FROM part")
def chat_answers(spark, sf):
    """Requests to a service that never answers a fifth of them."""

    def complete(messages: str) -> str:
        name, size = messages.split("|")
        if int(size) % 5 == 0:
            raise TimeoutError("busy")
        return name.upper()

    requests = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat_ws("|", "p_name", F.col("p_size").cast("string")).alias("messages"))
    return readers.chat(requests, complete)


@query("""SELECT sha256('m' || chr(0) || t) AS key, round(a, 6) AS first, round(sqrt(1 - a * a), 6) AS second FROM (SELECT t, CASE WHEN kind = 'p' THEN 0.6 ELSE length(t) / sqrt(length(t) * length(t) + 1) END AS a FROM (SELECT DISTINCT 'q: ' || p_name AS t, 'p' AS kind FROM part UNION SELECT DISTINCT 'q: ' || p_brand, 'b' FROM part))""")
def cached_embeddings(spark, sf):
    """Vectors of names from a cache, those of brands computed."""
    rows = table(spark, sf, "part")
    key = F.sha2(F.concat(F.lit("m\u0000q: "), "p_name"), 256)
    cache = rows.select(key.alias("key"), F.array(F.lit(0.6), F.lit(0.8)).alias("v")).distinct()

    def compute(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), 1.0] for t in texts]

    found = readers.embed(rows.select(F.col("p_name").alias("text")).union(rows.select("p_brand")), cache, "m", compute, "q: ")
    return six(found.select("key", F.col("v")[0].alias("first"), F.col("v")[1].alias("second")))


@query("""SELECT p_partkey AS sid, 0 AS "from", length(p_name) AS "to", 'name' AS type, p_name AS text, CAST(0.7 AS DOUBLE) AS confidence FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, length(split_part(p_name, ' ', 1)) + 1, length(p_name), 'noun', split_part(p_name, ' ', 2), 0.6 FROM part WHERE p_size % 2 = 1""")
def classified_pieces(spark, sf):
    """Spans of a token classifier that marks both words of a name as one, or the second alone."""

    def predict(texts: list[str]) -> list[list[tuple]]:
        out = []
        for text in texts:
            name, size = text.split("|")
            a, b = name.split(" ")
            kinds = ("B-name", "I-name") if int(size) % 2 == 0 else ("O", "B-noun")
            out.append([(0, len(a), a, kinds[0], 0.8), (len(a) + 1, len(name), b, kinds[1], 0.6)])
        return out

    texts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("sid"), F.concat_ws("|", "p_name", F.col("p_size").cast("string")).alias("text"))
    found = sp.pieces_to_spans(readers.classify(texts, predict))
    return six(found.select(F.col("sid").cast("long").alias("sid"), F.col("start").alias("from"), F.col("end").alias("to"), "type", "text", "confidence"))


@query(f"""WITH {spans_sql('g', GOLD)}, n AS (SELECT user_id AS sid, count(*) AS n FROM events GROUP BY user_id) SELECT sid, n FROM n WHERE sid IN (SELECT sid FROM g) AND n BETWEEN 8 AND 75 AND sid NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 180)""")
def demonstration_pool(spark, sf):
    e = table(spark, sf, "events")
    words = e.groupBy(F.col("user_id").alias("sid")).agg(F.collect_list("event_type").alias("tokens"))
    rows = words.join(sp.collect_spans(spans(spark, sf, GOLD)), "sid")
    excluded = e.where("event_type = 'purchase' AND value > 180").select(F.col("user_id").alias("sid"))
    return vc.demonstration_pool(rows, excluded, 8, 75).select("sid", F.size("tokens").cast("long").alias("n"))
