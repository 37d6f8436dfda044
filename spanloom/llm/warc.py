"""WARC archives written and read in parallel, with boundary-chain verification.

Writing: a page becomes a ``response`` record, or a ``revisit`` that refers to the response with the same payload. Records are
text, so Spark's own writer lays them out, with the blank lines between records as its line separator, into any shared store.

Reading: tasks cut the bytes at every occurrence of the record magic, also at those inside payloads. Each occurrence is a
candidate: from its header a task knows where its successor would begin. Starting at each file's first byte, pointer jumping
over the pairs (offset, successor) doubles the reached chain in every round; only reached candidates are records. A payload
that holds the magic was cut into several pieces, which are put together again for such records only.

Defined results: a null payload is empty; a null url leaves its header out; repeated rows are records of their own; every row
that has the smallest page_id among equal payloads is a response (null ids are responses only where all ids are null);
payloads below ``least`` bytes are always responses; an empty table gives no rows; bytes that no chain reaches are skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _written, materialise, shared_dir, small_batches

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """The digest's 160 bits in groups of 20: five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("same", F.sha2(F.col("payload").cast("binary"), 256))
    first = rows.where(F.col("size") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= least)
    return rows.join(first, "same", "left").select("page_id", "url", "payload", "digest", "size", F.when(later, F.col("first")).alias("refers_to"))


def record_text(date: str) -> Column:
    """One record, from its magic to the end of its block."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    url = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n")
    )
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\n"), F.coalesce(url, F.lit("")),
        F.lit(f"WARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), F.coalesce(revisit, F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END), http, body,
    )


def write_archives(pages: DataFrame, path: str, *, least: int = 0, records_per_file: int = 4096, compression: str = "gzip", date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record for each row of pages (page_id, url, html)."""
    with_roles(pages, least).select(record_text(date).alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece between two occurrences of the magic: where it lies, and what it would be as a record."""
    cut = spark.read.option("lineSep", MAGIC).text(path)
    cut = cut.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part")).withColumn("nth", F.monotonically_increasing_id())
    raw, block = F.col("value").cast("binary"), F.col("block").cast("string")
    cut = cut.withColumn("bytes", F.octet_length("value").cast("long")).withColumn("head", F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1)))
    cut = cut.withColumn("declared", F.try_to_number(F.regexp_extract("head", r"(?i)(?:^|\r\n)Content-Length: *(\d{1,15})(?:\r\n|$)", 1), F.lit("9" * 15)).cast("long"))
    cut = cut.withColumn("at", (F.octet_length("head") + len(END)).cast("int")).withColumn("whole", F.col("at") + F.col("declared") + len(END) <= F.col("bytes"))
    cut = cut.withColumn("block", F.when(F.col("whole"), F.substring(raw, F.col("at") + 1, F.col("declared").cast("int"))))
    cut = cut.withColumn("payload", payload_of(F.col("block"), block))
    return cut.select(
        "file", "part", "nth", "bytes", "at", "declared", "whole", "head", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest")
    )


def payload_of(block: Column, text: Column) -> Column:
    """What follows the HTTP header of a block, or the whole block where it has none."""
    http = F.lower(header("Content-Type")).startswith("application/http") & (F.instr(text, END) > 0)
    return F.when(http, F.substring(block, F.octet_length(F.substring_index(text, END, 1)) + len(END) + 1, 2147483647)).otherwise(block)


def with_offsets(cut: DataFrame) -> DataFrame:
    """The offset of each piece's magic in its (uncompressed) file, and of its successor; ``nth`` becomes its number inside its part of the file."""
    step = F.col("bytes") + len(MAGIC)
    parts = cut.groupBy("file", "part").agg(F.sum(step).alias("total"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # the first piece of a file is what comes before its first magic
    cut = cut.withColumn("ahead", F.coalesce(F.sum(step).over(inside), F.lit(0))).withColumn("nth", F.count("*").over(inside)).join(parts, ["file", "part"])
    cut = cut.withColumn("offset", F.col("base") + F.col("ahead") - len(MAGIC)).where(F.col("offset") >= 0).drop("base", "ahead")
    return cut.withColumn("next", F.col("offset") + len(MAGIC) + F.col("at") + F.col("declared") + len(END))


def reached(pieces: DataFrame) -> DataFrame:
    """file, offset of the candidates that the chain from each file's start reaches, by pointer jumping."""
    at = pieces.select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("on"))
    while True:
        at = materialise(at)
        if not at.where("on AND jump IS NOT NULL").limit(1).count():
            return at.where("on").select("file", "offset")
        beyond = at.select("file", F.col("offset").alias("jump"), F.col("jump").alias("further"))
        marks = at.where("on AND jump IS NOT NULL").select("file", F.col("jump").alias("offset"), F.lit(True).alias("mark")).distinct()
        at = (
            at.join(beyond, ["file", "jump"], "left")
            .join(marks, ["file", "offset"], "left")
            .select("file", "offset", F.col("further").alias("jump"), (F.col("on") | F.coalesce("mark", F.lit(False))).alias("on"))
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, size, digest, declared_digest of every record; size and digest are of the payload in the archive."""
    pieces = materialise(with_offsets(candidates(spark, path)))
    starts = materialise(reached(pieces))
    records = pieces.join(starts, ["file", "offset"])
    fields = ["file", "offset", header("WARC-Type").alias("record_type"), page_number("WARC-Record-ID").alias("page_id"), page_number("WARC-Refers-To").alias("refers_to"), F.regexp_extract("head", r"(?i)WARC-Payload-Digest: *sha1:([A-Z2-7]+)", 1).alias("declared_digest")]
    out = records.where("whole").select(*fields, "size", "digest")
    broken = records.where("NOT whole AND declared IS NOT NULL")
    if broken.limit(1).count():
        out = out.unionByName(put_together(spark, path, pieces, broken, fields))
    return out


def page_number(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: *<urn:page:(-?\d+)>", 1), F.lit("")).cast("long")


def numbered(texts: DataFrame) -> DataFrame:
    """``texts`` (value, file, part) with the number of each piece inside its part of the file, however parts are dealt to tasks."""

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in it:
            nth = []
            for place in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, n = place, n + 1 if place == at else 0
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=["value", "file", "part", "nth"])

    return small_batches(texts).mapInArrow(number, "value binary, file string, part long, nth long")


def put_together(spark: SparkSession, path: str, pieces: DataFrame, broken: DataFrame, fields: list) -> DataFrame:
    """The records whose payloads hold the magic: their pieces, in order, with the magic between them."""
    marks = broken.select("file", "offset", F.col("offset").alias("own"), F.col("next").alias("until"))
    order = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    spans = pieces.select("file", "offset", "part", "nth", "bytes").join(marks, ["file", "offset"], "left")
    spans = spans.withColumn("own", F.last("own", ignorenulls=True).over(order)).withColumn("until", F.last("until", ignorenulls=True).over(order))
    spans = materialise(spans.where("offset < until").select("file", "part", "nth", "bytes", "offset", "own"))
    texts = spark.read.option("lineSep", MAGIC).text(path)
    texts = numbered(texts.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part")))
    joined = texts.join(spans, ["file", "part", "nth"]).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("all"))
    # parts of uncompressed files may be cut differently in this read: then no record is lost silently
    expected = spans.groupBy("file", "own").agg(F.count("*").alias("pieces"), F.sum("bytes").alias("bytes"))
    found = F.coalesce((F.size("all") == F.col("pieces")) & (F.aggregate("all", F.lit(0).cast("long"), lambda x, y: x + F.octet_length(y["value"])) == F.col("bytes")), F.lit(False))
    joined = expected.join(joined, ["file", "own"], "left").withColumn("all", F.when(found, F.col("all")).otherwise(F.raise_error(F.concat(F.lit("pieces of a record were not found again in "), "file", F.lit(" at "), F.col("own").cast("string")))))
    magic = F.lit(MAGIC).cast("binary")
    whole = F.aggregate("all", F.lit(b""), lambda x, y: F.when(F.octet_length(x) == 0, y["value"]).otherwise(F.concat(x, magic, y["value"])))
    joined = joined.select("file", F.col("own").alias("offset"), whole.alias("value")).join(broken.select("file", "offset", "head", "at", "declared"), ["file", "offset"])
    joined = joined.withColumn("block", F.expr("substring(value, at + 1, cast(declared AS int))"))
    joined = joined.withColumn("payload", payload_of(F.col("block"), F.col("block").cast("string")))
    return joined.select(*fields, F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))


def round_trip(pages: DataFrame, *, least: int = 0, records_per_file: int = 4096) -> DataFrame:
    """Write ``pages``, read the archives, and return page_id, payload_bytes, payload_digest, record_type, refers_to of each."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spanloom-{uuid.uuid4().hex}"
    write_archives(pages, path, least=least, records_per_file=records_per_file)
    _written.append((spark, path))
    records = materialise(read_records(spark, path))
    bodies = records.where("record_type = 'response'").groupBy("digest").agg(F.max("size").alias("full_size"))
    later = records.where("record_type = 'revisit'").drop("digest").withColumnRenamed("declared_digest", "digest").join(bodies, "digest", "left")
    kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        later.select("page_id", F.col("full_size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to").select(*kinds)
    )
