"""Readers: annotated corpora, JSON lines, graphs, registries, stored answers. All give DataFrames with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import bio_to_spans
from ..functions.text import normalize_domain, normalize_iob_label, tokenize
from ..operators.numbering import with_number

SPANS = "array<struct<s:int,e:int,type:string>>"
BIO = "words string, sentence_id string, labels string"


def numbered(df: DataFrame, name: str = "pos") -> DataFrame:
    """Adds a number that grows with the rows' order in their files; CSV and JSON-lines order carries meaning here."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_bio_csv(spark: SparkSession, path: str, dataset: str, split: str, types: Iterable[str]) -> DataFrame:
    """sid, tokens, spans, repaired of a token-per-row CSV (words, sentence_id, labels); a blank label is O.

    Sentences keep their first appearance in ``pos``. A type outside the schema fails the query, as does a file without the three columns.
    """
    rows = numbered(spark.read.option("header", True).option("enforceSchema", False).schema(BIO).csv(path))
    label = F.when(F.trim(F.coalesce("labels", F.lit(""))) == "", "O").otherwise(F.trim("labels"))
    by = F.struct("pos", F.coalesce("words", F.lit("")).alias("w"), label.alias("l"))
    lists = rows.groupBy("sentence_id").agg(F.array_sort(F.collect_list(by)).alias("r"), F.min("pos").alias("pos"))
    lists = lists.select(F.concat_ws(":", F.lit(dataset), F.lit(split), "sentence_id").alias("sid"), "pos", F.transform("r", lambda x: x["w"]).alias("tokens"), bio_to_spans(F.transform("r", lambda x: x["l"])).alias("b"))
    known = F.array(*[F.lit(t) for t in types])
    odd = F.filter("b.spans", lambda x: ~F.array_contains(known, x["type"]))
    checked = F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("a type outside the schema in "), F.col("sid")))).otherwise(F.col("b.spans"))
    return lists.select("sid", "pos", "tokens", checked.cast(SPANS).alias("spans"), F.col("b.repaired").alias("repaired"))


def read_synthetic(spark: SparkSession, path: str, dataset: str, domains: Mapping[str, str]) -> DataFrame:
    """sid, tokens, value, temperature, type of generated sentences; an unknown domain fails the query."""
    rows = numbered(spark.read.option("header", True).option("multiLine", True).schema("sentence string, value double, temperature double, domain string").csv(path))
    names = F.create_map(*[F.lit(x) for k, v in domains.items() for x in (k.strip().lower().replace(" ", ""), v)])
    kind = F.element_at(names, normalize_domain(F.col("domain")))
    kind = F.when(kind.isNull(), F.raise_error(F.concat(F.lit("unknown domain "), F.coalesce("domain", F.lit("(none)"))))).otherwise(kind)
    return with_number(rows, "pos", name="nth").select(F.concat_ws(":", F.lit(dataset), F.lit("s_full"), F.col("nth").cast("string")).alias("sid"), tokenize(F.col("sentence")).alias("tokens"), "value", "temperature", kind.alias("type"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines. A broken line is dropped if it is the last of its file (a torn append), elsewhere it fails the query.

    A path without files is an empty frame. A file's last line is found by a maximum over the places of its lines, so its parts stay in their tasks.
    """
    try:
        lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path"))
        lines = lines.withColumn("_pos", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))).where(F.trim("value") != "")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("_pos", "_file", parsed.alias("_r")).select("_pos", "_file", "_r.*")
    ends = lines.groupBy("_file").agg(F.max("_pos").alias("_end"))
    bad = F.col("_corrupt").isNotNull()
    kept = rows.join(ends, "_file").where(~(bad & (F.col("_pos") == F.col("_end"))))
    names = [f.name for f in rows.schema.fields if not f.name.startswith("_")]
    first = F.when(bad, F.raise_error(F.concat(F.lit("a broken line in "), F.col("_file")))).otherwise(F.col(names[0]))
    return kept.withColumn(names[0], first).select(*names)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """sid, tokens, spans, label_source of annotated sentences whose spans are [start, end, type] arrays."""
    rows = read_jsonl(spark, path, "sid string, tokens array<string>, spans array<array<string>>, label_source string")
    spans = F.transform("spans", lambda x: F.struct(x[0].cast("int").alias("s"), x[1].cast("int").alias("e"), x[2].alias("type")))
    return rows.select("sid", "tokens", spans.alias("spans"), "label_source")


def read_index(spark: SparkSession, path: str, synthetic: str | None = None) -> DataFrame:
    """A stored surface index, joined with a synthetic one if asked."""
    from ..operators.lexicon import merge_indexes

    index = spark.read.parquet(path)
    return index if synthetic is None else merge_indexes(index, spark.read.parquet(synthetic))


# The grammar of N-Triples lines.
TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'


# What stands for a sign behind a backslash in N-Triples; other signs stand for themselves.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unescape(text: Column) -> Column:
    """The text of an N-Triples literal, read from left to right: a backslash with its sign, or with u or U and a code point, is one sign."""
    named = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])

    def one(part: Column) -> Column:
        sign = F.substring(part, 2, 1)
        code = F.when(F.length(part) == 6, F.decode(F.unhex(F.substring(part, 3, 4)), "UTF-16BE")).when(F.length(part) == 10, F.decode(F.unhex(F.substring(part, 3, 8)), "UTF-32"))
        return F.when(~F.startswith(part, F.lit("\\")), part).otherwise(F.coalesce(code, F.try_element_at(named, sign), sign))

    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, literal, datatype of an N-Triples file, split by lines over all tasks; comments and blank lines are skipped."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))

    def part(i: int):
        return F.nullif(F.regexp_extract("value", TRIPLE, i), F.lit(""))

    text = unescape(part(5))
    known =F.when(~F.col("value").rlike(TRIPLE), F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))).otherwise(F.regexp_replace(part(1), "^<|>$", ""))
    empty = F.col("value").rlike(r'"\s*(\^\^<[^>]*>|@\S+)?\s*\.\s*$')
    return rows.select(known.alias("s"), part(2).alias("p"), F.coalesce(part(3), part(4), text, F.when(empty, "")).alias("o"), empty.alias("literal"), part(6).alias("datatype"))


def read_turtle(spark: SparkSession, patterns: Iterable[str], parse: Callable[[str], Iterable[tuple[str, str, str, bool]]]) -> DataFrame:
    """s, p, o, literal, error of Turtle files: each file is parsed whole by ``parse`` in a task; a file that fails is one row with its error."""

    def load(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(*t, None) for t in parse(bytes(content).decode())]
                except Exception as e:  # noqa: BLE001
                    rows = [(None, None, None, None, f"{path}: {e}")]
                yield pd.DataFrame(rows, columns=["s", "p", "o", "literal", "error"])

    files = spark.read.format("binaryFile").load(list(patterns)).select("path", "content")
    return files.mapInPandas(load, "s string, p string, o string, literal boolean, error string")


def graph_labels(triples: DataFrame, label: str, kind: str) -> DataFrame:
    """uri, label (normalised), kinds: the labels of nodes with the local names of their classes; schema resources are left out."""
    from ..functions.text import normalize_label, uri_local_name

    sub = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
    schema = (
        triples.where(F.col("p") == kind).select(F.col("o").alias("uri"))
        .union(triples.where(F.col("p") == sub).select("s")).union(triples.where(F.col("p") == sub).select("o"))
        .union(triples.where((F.col("p") == kind) & F.col("o").rlike("#(Class|ObjectProperty|DatatypeProperty|Property)$")).select("s"))
        .distinct()
    )
    labels = triples.where(F.col("p") == label).select(F.col("s").alias("uri"), normalize_label(F.col("o")).alias("label")).distinct()
    kinds = triples.where(F.col("p") == kind).groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set(uri_local_name(F.col("o")))).alias("kinds"))
    return labels.join(schema, "uri", "left_anti").join(kinds, "uri", "left").select("uri", "label", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def external_matches(queries: DataFrame, triples: DataFrame, label: str, kind: str, k: int = 10, least: float = 0.5) -> DataFrame:
    """Labels of an external triple table that hold the query's text, of its class, scored again and best for each node.

    The text filter runs over distinct (query, label) pairs of one class; as a triple table it takes no cap.
    """
    from ..operators.similarity import contained, top_per_uri

    labels = graph_labels(triples, label, kind)
    found = contained(queries, labels, least)
    held = labels.select("uri", "label", F.explode_outer("kinds").alias("class"))
    rows = queries.select("q", "kind").distinct().join(found, "q").join(held, "label").where(F.col("kind").isNull() | (F.col("kind") == F.col("class")))
    return top_per_uri(rows.select("q", "kind", "label", "uri", "similarity"), k)


def read_iob(spark: SparkSession, path: str) -> DataFrame:
    """sid, tokens, labels of white-space separated IOB lines (first column token, last label); a blank line ends a sentence.

    The sentence number is the running count of blank lines within a file.
    """
    rows = numbered(spark.read.text(path).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("f")))
    w = Window.partitionBy("f").orderBy("pos")
    rows = rows.withColumn("n", F.sum((F.col("v") == "").cast("int")).over(w)).withColumn("p", F.split("v", r"\s+")).where(F.size("p") >= 2)
    cell = F.struct("pos", F.element_at("p", 1).alias("t"), normalize_iob_label(F.element_at("p", -1)).alias("l"))
    lists = rows.groupBy("f", "n").agg(F.array_sort(F.collect_list(cell)).alias("r"), F.min("pos").alias("pos"))
    return lists.select(F.concat_ws(":", F.element_at(F.split("f", "/"), -1), F.col("n").cast("string")).alias("sid"), "pos", F.transform("r", lambda x: x["t"]).alias("tokens"), F.transform("r", lambda x: x["l"]).alias("labels"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """sid, pos, tokens, labels of either form: CSV with the columns words, sentence_id and labels, or IOB lines (see :func:`read_iob`).

    The first line that isn't blank tells which: CSV begins with ``words,`` or names ``sentence_id`` between commas. Sentences of a CSV keep the numbers that it gives them;
    a missing label is O.
    """
    first = spark.read.text(path).where(F.trim("value") != "").first()
    head = first[0].strip().lower() if first else ""
    if not (head.startswith("words,") or ",sentence_id," in head):
        return read_iob(spark, path)
    rows = numbered(spark.read.option("header", True).csv(path))
    label = normalize_iob_label(F.coalesce(F.nullif(F.trim("labels"), F.lit("")), F.lit("O")))
    cell = F.struct("pos", F.trim(F.coalesce("words", F.lit(""))).alias("t"), label.alias("l"))
    lists = rows.groupBy(F.coalesce(F.col("sentence_id").cast("long"), F.lit(0)).alias("n")).agg(F.array_sort(F.collect_list(cell)).alias("r"))
    return lists.select(F.col("n").cast("string").alias("sid"), F.col("n").alias("pos"), F.transform("r", lambda x: x["t"]).alias("tokens"), F.transform("r", lambda x: x["l"]).alias("labels"))


def read_models(root: str, kind: str | None = None) -> list[dict]:
    """Registered models: every folder with a config.json, its labels and type. A driver-side listing."""
    out = []
    for config in sorted(Path(root).glob("*/config.json")):
        body = json.loads(config.read_text())
        found = {"name": config.parent.name, "labels": sorted((body.get("id2label") or {}).values()), "type": body.get("model_type", "entity")}
        if kind is None or found["type"] == kind:
            out.append(found)
    return out


def label_types(labels: Iterable[str]) -> list[str]:
    """The types behind B- and I- labels."""
    return sorted({x[2:] for x in labels if x[:2] in ("B-", "I-")})


def read_scored(spark: SparkSession, paths: list[str], with_unaligned: bool = False, lines: str | None = None) -> DataFrame:
    """Scored rows of several runs; rows that were not aligned to the text (no span) only if asked for.

    They are Parquet, or JSON lines with the schema ``lines``, of which rows may leave fields out.
    """
    rows = spark.read.schema(lines).json(paths) if lines else spark.read.option("mergeSchema", True).parquet(*paths)
    return rows if with_unaligned else rows.where("span IS NOT NULL")


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """sid, pos of a subset manifest, in its order."""
    return spark.read.option("multiLine", True).schema("sentence_ids array<string>").json(path).select(F.posexplode("sentence_ids").alias("pos", "sid"))


def read_answers(spark: SparkSession, originals: str, repairs: str | None = None) -> DataFrame:
    """custom_id, content of stored answers: the first valid row of each id, originals before repairs; broken lines are skipped."""
    parts = [spark.read.text(originals).select("value", F.lit(0).alias("r"))] + ([spark.read.text(repairs).select("value", F.lit(1).alias("r"))] if repairs else [])
    rows = numbered(parts[0] if len(parts) == 1 else parts[0].union(parts[1]))
    data = F.try_parse_json("value")
    rows = rows.select("r", "pos", F.try_variant_get(data, "$.id", "string").alias("custom_id"), F.try_variant_get(data, "$.content", "string").alias("content")).where("custom_id IS NOT NULL AND content IS NOT NULL")
    return rows.groupBy("custom_id").agg(F.min_by("content", F.struct("r", "pos")).alias("content"))


def read_markdown_items(spark: SparkSession, path: str) -> DataFrame:
    """file, heading, body of '### ' items of Markdown files."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parts = F.split(F.concat(F.lit("\n"), F.col("value")), "\n### ")
    items = text.select("file", F.posexplode(parts).alias("n", "item")).where("n > 0")
    heading = F.substring_index("item", "\n", 1)
    return items.select("file", F.trim(heading).alias("heading"), F.regexp_replace(F.substr("item", F.length(heading) + 2), r"^\s+|\s+$", "").alias("body"))


def chat(requests: DataFrame, complete: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """requests (key, messages) with content, error and tries. ``complete`` answers one JSON request; ConnectionError and
    TimeoutError are tried again, anything else is not. Answers come from tasks, so a lost executor asks again."""

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, messages in zip(pdf["key"], pdf["messages"], strict=True):
                content = error = None
                tries = 0
                while tries < attempts:
                    tries += 1
                    try:
                        content, error = complete(messages), None
                        break
                    except (ConnectionError, TimeoutError) as e:
                        error = f"{type(e).__name__}: {e}"
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        break
                rows.append((key, content, error, tries))
            yield pd.DataFrame(rows, columns=["key", "content", "error", "tries"])

    return requests.select("key", "messages").mapInPandas(ask, "key string, content string, error string, tries int")


def embed(texts: DataFrame, cache: DataFrame, model: str, compute: Callable[[list[str]], list[list[float]]] | None, prefix: str = "") -> DataFrame:
    """key, v: unit vectors of texts, from the cache or computed. Without ``compute`` (offline) a missing text fails the query."""
    from ..operators.vectors import missing_embeddings, unit

    missing = missing_embeddings(texts, cache, model, prefix)
    if compute is None:
        fresh = missing.select(F.when(F.lit(True), F.raise_error(F.concat(F.lit("not in the cache: "), F.col("text")))).cast("string").alias("key"), F.lit(None).cast("array<double>").alias("v"))
    else:

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pd.DataFrame({"key": pdf["key"], "v": compute(list(pdf["text"]))})

        fresh = missing.mapInPandas(run, "key string, v array<double>").select("key", unit(F.col("v")).alias("v"))
    wanted = texts.select(F.sha2(F.concat(F.lit(model + "\u0000" + prefix), F.col("text")), 256).alias("key")).distinct()
    return cache.select("key", F.col("v").cast("array<double>").alias("v")).unionByName(fresh).join(wanted, "key")


def classify(texts: DataFrame, predict: Callable[[list[str]], list[list[tuple]]]) -> DataFrame:
    """Word-piece rows (sid, i, start, end, token, label, p, text) from a token classifier; see operators.spans.pieces_to_spans."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(sid, i, *piece, text) for sid, text, pieces in zip(pdf["sid"], pdf["text"], predict(list(pdf["text"])), strict=True) for i, piece in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["sid", "i", "start", "end", "token", "label", "p", "text"])

    return texts.select("sid", "text").mapInPandas(run, "sid string, i int, start int, end int, token string, label string, p double, text string")
