"""Spans as rows: (sid, s, e, type), half-open; tags as rows (sid, pos, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bio_spans(tags: DataFrame, sid: str = "sid", pos: str = "pos", label: str = "label") -> DataFrame:
    """Spans of B-, I- and O rows by gaps and islands, with ``repaired`` for those that an I- opened.

    A row continues a span if it is I- and the row before has the same type (B- or I-).
    """
    w = Window.partitionBy(sid).orderBy(pos)
    rows = tags.select(F.col(sid).alias("sid"), (F.row_number().over(w) - 1).alias("i"), F.coalesce(F.col(label), F.lit("O")).alias("label"))
    rows = rows.withColumn("kind", F.when(F.col("label").rlike("^[BI]-"), F.expr("substring(label, 3)")))
    w = Window.partitionBy("sid").orderBy("i")
    goes_on = F.col("label").startswith("I-") & F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    rows = rows.withColumn("opens", F.col("kind").isNotNull() & ~goes_on)
    rows = rows.withColumn("nth", F.sum(F.col("opens").cast("int")).over(w)).where("kind IS NOT NULL")
    return rows.groupBy("sid", "nth").agg(
        F.min("i").alias("s"), (F.max("i") + 1).alias("e"), F.first("kind").alias("type"), F.bool_or(F.col("opens") & F.col("label").startswith("I-")).alias("repaired")
    ).select("sid", "s", "e", "type", "repaired")


def collect_spans(spans: DataFrame, *more: str) -> DataFrame:
    """One row for each sid (and ``more``) with its spans in order."""
    return spans.groupBy("sid", *more).agg(F.array_sort(F.collect_set(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "type"))).alias("spans"))


def explode_spans(rows: DataFrame, column: str = "spans", *keep: str) -> DataFrame:
    return rows.select("sid", *keep, F.inline(column))


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Join fragments (sid, start, end, type, text, p) of one type that lie at most two characters apart with no white space between.

    ``gap``: the text between a fragment and the one before. Confidence is the mean of the fragments' tokens (``probs`` array).
    """
    w = Window.partitionBy("sid").orderBy("start")
    joins = (F.lag("type").over(w) == F.col("type")) & (F.col("start") <= F.lag("end").over(w) + 2) & ~F.col("gap").rlike(r"\s")
    rows = fragments.withColumn("opens", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("nth", F.sum("opens").over(w))
    return rows.groupBy("sid", "nth").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("type").alias("type"),
        F.expr("aggregate(flatten(collect_list(probs)), 0D, (a, x) -> a + x) / size(flatten(collect_list(probs)))").alias("confidence"),
    ).drop("nth")


def pieces_to_spans(pieces: DataFrame) -> DataFrame:
    """Word-piece predictions (sid, i, start, end, token, label, p, text) as character spans (sid, start, end, type, text, confidence).

    A piece opens a span at B- or where the type changes; B- of the same type right after a piece (or a sub-word) goes on.
    Empty pieces take no part. Spans of one type with nothing but signs between them are merged, and confidence is the mean over pieces.
    """
    w = Window.partitionBy("sid").orderBy("i")
    rows = pieces.withColumn("prev_end", F.coalesce(F.lag("end").over(w), F.lit(-1))).where("start <> end")
    between = F.when((F.col("prev_end") >= 0) & (F.col("start") > F.col("prev_end")), F.expr("substring(text, prev_end + 1, start - prev_end)")).otherwise("")
    near = (F.col("start") == F.col("prev_end")) | ((F.col("start") <= F.col("prev_end") + 1) & (F.trim(between) == ""))
    inner = F.col("token").startswith("##") | F.col("token").startswith("Ġ") | ((F.col("prev_end") > 0) & (F.col("start") > F.col("prev_end")) & ~between.rlike(r"\s"))
    rows = rows.withColumn("kind", F.when(F.col("label").rlike("^[BI]-"), F.expr("substring(label, 3)"))).withColumn("near", near | inner)
    same = F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    opens = F.col("kind").isNotNull() & ~(same & (F.col("label").startswith("I-") | F.col("near")))
    rows = rows.withColumn("nth", F.sum(opens.cast("int")).over(w)).where("kind IS NOT NULL")
    spans = rows.groupBy("sid", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("type"), F.first("text").alias("text"), F.collect_list("p").alias("probs"))
    w = Window.partitionBy("sid").orderBy("start")
    last = F.lag("end").over(w)
    spans = spans.withColumn("gap", F.when(F.col("start") > last, F.substr("text", last + 1, F.col("start") - last)).otherwise(""))
    merged = merge_fragments(spans)
    texts = rows.groupBy("sid").agg(F.first("text").alias("text"))
    return merged.join(texts, "sid").withColumn("text", F.expr("substring(text, start + 1, end - start)"))
