"""Annotate new texts with the passages of an evaluation set, and hold back those that give too much of it away.

    python -m jobs.annotate_texts --documents DIR --passages DIR --output DIR --checkpoint DIR [--config FILE]

A file stream takes the document files that no earlier run has taken. Each text is split into tokens, stretches of ``tokens`` tokens that a passage
holds too are found by the dictionary join, joined to spans where they overlap, and of overlapping spans the longest stay. A record holds the
spans and the share of tokens inside them; what exceeds ``most_share`` is held back from training.

``output/annotations`` (Parquet, partitioned by batch and language) has one record for each distinct (doc_id, text): one that an earlier batch
has annotated is left out, also when it comes again in another file. ``output/report`` (JSON) sums up the whole output by language and source.
A batch replaces its own partitions, so one that is repeated after a failure leaves what it would have left the first time; a run without new
files changes nothing but the report, which it writes again.

Defined results: a null or empty text has no tokens and no spans and isn't held back; a null or empty language is 'unknown'; of repeated rows the
first language and source by name stay; an empty input gives empty output.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import spans as fs
from spanloom.functions import text as ft
from spanloom.operators import lexicon as lx

from .settings import arguments, from_file, session

log = logging.getLogger(__name__)
RECORD = "key string, doc_id long, source string, n_tokens int, spans array<struct<s:int,e:int,type:string>>, n_tagged int, held_back boolean, batch long, lang string"


@dataclass(frozen=True)
class Settings:
    tokens: int = 6
    most_share: float = 0.05
    files_per_batch: int = 1000


def dictionary(passages: DataFrame, tokens: int) -> DataFrame:
    """key, type: every stretch of ``tokens`` tokens of each passage (item_id, text)."""
    rows = passages.select(F.col("item_id").cast("string").alias("sid"), ft.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    return lx.windows(rows, tokens, shortest=tokens).select("key", F.col("sid").alias("type")).distinct()


def annotate(documents: DataFrame, entries: DataFrame, settings: Settings) -> DataFrame:
    """One record for each distinct (doc_id, text). Texts stay where they are read; hits and counts are shuffled."""
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("unknown"))
    rows = documents.select(F.sha2(ft.row_json("doc_id", "text"), 256).alias("sid"), "doc_id", "source", lang.alias("lang"), ft.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    records = rows.select("sid", "doc_id", F.size("tokens").alias("n_tokens"), F.struct("lang", "source").alias("at")).groupBy("sid", "doc_id", "n_tokens").agg(F.min("at").alias("at"))
    hits = lx.dictionary_join(rows, entries, settings.tokens, shortest=settings.tokens).select("sid", "type", "s", "e").distinct()
    by = Window.partitionBy("sid", "type").orderBy("s")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("new", F.coalesce(F.col("s") > before, F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(by))
    spans = islands.groupBy("sid", "type", "nth").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    chosen = spans.groupBy("sid").agg(fs.non_overlapping(F.collect_list(fs.span(F.col("s"), F.col("e"), F.col("type")))).alias("spans"))
    out = records.join(chosen, "sid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(fs.SPANS)))
    out = out.withColumn("n_tagged", F.aggregate("spans", F.lit(0), lambda n, x: n + x["e"] - x["s"]))
    return out.select(
        F.col("sid").alias("key"), "doc_id", "at.source", "n_tokens", "spans", "n_tagged", (F.col("n_tagged") > F.lit(settings.most_share) * F.col("n_tokens")).alias("held_back"), "at.lang"
    )


def exactly(path: str) -> str:
    """The path as a pattern that only it matches: a stream reads a single file no other way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, *, documents: str, passages: str, output: str, checkpoint: str, settings: Settings | None = None) -> dict[str, int]:
    """Annotate what is new; how many rows were read, records written, and batches run."""
    settings = settings or Settings()
    at = f"{output.rstrip('/')}/annotations"
    entries = dictionary(spark.read.parquet(passages), settings.tokens)
    spark.createDataFrame([], RECORD).write.mode("append").partitionBy("batch", "lang").parquet(at)
    counts = {"read": 0, "written": 0, "batches": 0}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = session.read.schema(RECORD).parquet(at).where(F.col("batch") != number).select("key")
        fresh = annotate(batch, entries, settings).join(earlier, "key", "left_anti")
        fresh = fresh.withColumn("batch", F.lit(number).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(at)
        read, written = batch.count(), session.read.schema(RECORD).parquet(at).where(F.col("batch") == number).count()  # counted from the files' footers
        log.info("batch %d: %d rows read, %d records written to %s", number, read, written, at)
        counts["read"] += read
        counts["written"] += written
        counts["batches"] += 1

    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(exactly(documents))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d rows read from %s in %d batches, %d records written", counts["read"], documents, counts["batches"], counts["written"])
    report(spark.read.schema(RECORD).parquet(at)).write.mode("overwrite").json(f"{output.rstrip('/')}/report")
    log.info("report written to %s/report", output.rstrip("/"))
    return counts


def report(records: DataFrame) -> DataFrame:
    """By language and source: texts, tokens, spans, tagged tokens, texts held back."""
    sums = [F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum(F.size("spans")).alias("spans"), F.sum("n_tagged").alias("tagged"), F.count_if("held_back").alias("held_back")]
    return records.groupBy("lang", "source").agg(*sums)


def main() -> None:
    paths = {"documents": "Parquet of doc_id, text, lang, source", "passages": "Parquet of item_id, text", "output": "folder of the annotations and the report", "checkpoint": "folder of the stream's checkpoint"}
    given = arguments(__doc__.split("\n")[0], "jobs.annotate_texts", paths)
    spark = session("annotate-texts")
    try:
        run(spark, documents=given.documents, passages=given.passages, output=given.output, checkpoint=given.checkpoint, settings=from_file(spark, given.config, Settings))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
