"""Build prompts that ask a model for the labels of unlabelled texts, in numbered batches.

    python -m jobs.build_prompts --documents DIR --labels DIR --passages DIR --output DIR [--config FILE]

Labelled texts that are short enough and aren't evaluation passages make the pool; ``demonstrations`` of them are drawn, in proportion to language and
labels with at least one of each kind, and the first ``shown`` of a language go before each of its questions. Unlabelled texts are asked about
once, however many copies there are. Prompts are numbered in the order of language and id over the whole output, ``batch_size`` to a batch.

``output/prompts`` (JSON lines, partitioned by ``part``, of ``batches_per_part`` batches each) has the prompts, ``output/manifest`` (JSON) a line
for each batch with its size, its first and last id, and a digest of its prompts, by which a returned batch can be checked. Both are replaced as a
whole, so a second run leaves the same.

Defined results: texts that are null or blank aren't asked about, nor are those without an id; a copy of a labelled text counts as labelled; a null
language is 'none'; a language without demonstrations is asked without any; empty tables give empty output.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as ft
from spanloom.operators import lexicon as lx
from spanloom.operators import sampling as sm
from spanloom.operators.numbering import with_number

from .settings import arguments, from_file, session

log = logging.getLogger(__name__)
PROMPT = "doc_id long, lang string, copies long, batch long, position int, shown int, prompt string, part long"


@dataclass(frozen=True)
class Settings:
    system: str = 'Judge the text. Answer with JSON: {"quality": 0 or 1, "toxic": 0 or 1}.'
    demonstrations: int = 40
    shown: int = 3
    longest: int = 800
    batch_size: int = 100
    batches_per_part: int = 50
    seed: int = 7


def demonstrations(labelled: DataFrame, passages: DataFrame, settings: Settings) -> DataFrame:
    """lang, shown: array<struct<text, answer>> of each language, at most ``demonstrations`` texts in all."""
    answer = F.to_json(F.struct("quality", "toxic"))
    pool = labelled.where((F.length("text") <= settings.longest) & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    pool = lx.decontaminate(pool.withColumn("kind", F.concat_ws("/", "lang", "quality", "toxic")), passages)
    drawn = sm.stratified(pool, "kind", "doc_id", settings.demonstrations, settings.seed)
    order = Window.partitionBy("lang").orderBy(sm.seeded(settings.seed, F.col("doc_id")), "doc_id")
    first = drawn.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= settings.shown)
    turns = F.sort_array(F.collect_list(F.struct("nth", "text", answer.alias("answer"))))
    return first.groupBy("lang").agg(F.transform(turns, lambda t: F.struct(t["text"].alias("text"), t["answer"].alias("answer"))).alias("shown"))


def prompts(documents: DataFrame, labels: DataFrame, passages: DataFrame, settings: Settings) -> DataFrame:
    """The rows of ``output/prompts``."""
    texts = documents.where(F.col("doc_id").isNotNull() & (F.trim(F.col("text")) != "")).select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("lang"))
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"), F.lit(True).alias("known"))
    # one row for each text: the copy of the smallest id, and the labels of the smallest labelled copy. Texts are told apart by digests, and an id's
    # several texts by their hash; the texts themselves join what is left
    texts = texts.withColumn("hash", F.xxhash64("text"))
    same = F.sha2(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 256)
    both = texts.select("doc_id", "lang", "hash", F.length("text").alias("chars"), same.alias("same")).join(judged, "doc_id", "left")
    first = F.min_by(F.struct("doc_id", "lang", "hash", "chars", "quality", "toxic", "known"), F.struct(F.col("known").isNull(), "doc_id", "hash"))
    single = both.groupBy("same").agg(first.alias("r"), F.count("*").alias("copies")).select("r.*", "copies")

    def with_text(rows: DataFrame, among: DataFrame) -> DataFrame:
        """An id may come again with the same text."""
        return rows.join(among.select("doc_id", "hash", "text"), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])

    labelled = with_text(single.where(F.col("known") & (F.col("chars") <= settings.longest)), texts.where(F.length("text") <= settings.longest))
    shown = F.broadcast(demonstrations(labelled, passages, settings))  # a row for each language that has demonstrations
    numbered = with_number(single.where("known IS NULL").select("lang", "doc_id", "hash", "copies"), "lang", "doc_id", "hash", name="n")
    # in the order of the output, before demonstrations are put in front of each text
    rows = with_text(numbered, texts).repartitionByRange("n").join(shown, "lang", "left")
    none = F.array().cast("array<struct<text:string,answer:string>>")
    rows = rows.withColumn("shown", F.coalesce("shown", none)).withColumn("batch", F.floor(F.col("n") / settings.batch_size))
    message = ft.build_messages(F.lit(settings.system), F.array().cast("array<string>"), F.col("shown"), F.col("text"))
    return rows.select(
        "doc_id", "lang", "copies", "batch", (F.col("n") % settings.batch_size).cast("int").alias("position"), F.size("shown").alias("shown"),
        ft.render_messages(message).alias("prompt"), F.floor(F.col("batch") / settings.batches_per_part).alias("part"),
    )


def manifest(rows: DataFrame) -> DataFrame:
    """A row for each batch. What is gathered is one hash for each of its prompts."""
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("position", F.md5("prompt").alias("h")))), lambda x: x["h"])
    first, last = F.min_by("doc_id", "position"), F.max_by("doc_id", "position")
    return rows.groupBy("batch").agg(F.count("*").alias("prompts"), first.alias("first_id"), last.alias("last_id"), F.sum(F.length("prompt")).alias("chars"), F.sha2(F.array_join(hashes, ""), 256).alias("digest"))


def run(spark: SparkSession, *, documents: str, labels: str, passages: str, output: str, settings: Settings | None = None) -> dict[str, int]:
    """Write prompts and manifest; how many documents were read and prompts and batches written."""
    settings, at = settings or Settings(), output.rstrip("/")
    read = spark.read.parquet(documents)
    made = prompts(read, spark.read.parquet(labels), spark.read.parquet(passages), settings)
    # prompts come in ranges of their numbers: a part's prompts meet in few files, and a part may be spread over several
    made.sortWithinPartitions("part", "batch", "position").write.mode("overwrite").partitionBy("part").json(f"{at}/prompts")
    written = spark.read.schema(PROMPT).json(f"{at}/prompts")
    manifest(written).write.mode("overwrite").json(f"{at}/manifest")
    counts = {"read": read.count(), "prompts": written.count(), "batches": spark.read.schema("batch long").json(f"{at}/manifest").count()}
    log.info("%d documents read from %s, %d prompts in %d batches written to %s", counts["read"], documents, counts["prompts"], counts["batches"], at)
    return counts


def main() -> None:
    paths = {"documents": "Parquet of doc_id, text, lang", "labels": "Parquet of doc_id, quality, toxic", "passages": "Parquet of evaluation texts (text)", "output": "folder of prompts and manifest"}
    given = arguments(__doc__.split("\n")[0], "jobs.build_prompts", paths)
    spark = session("build-prompts")
    try:
        run(spark, documents=given.documents, labels=given.labels, passages=given.passages, output=given.output, settings=from_file(spark, given.config, Settings))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
