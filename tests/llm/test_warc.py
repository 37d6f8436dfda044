import base64
import glob
import gzip
import hashlib
from collections import Counter, defaultdict

from spanloom.llm.warc import MAGIC, read_records, round_trip, write_archives

SCHEMA = "page_id long, url string, html string"
INNER = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ODD = [
    (5, "http://a/", "same"),
    (2, "http://b/", "same"),
    (9, None, "same"),
    (2, "http://b/", "same"),
    (None, "http://n/", "same"),
    (None, "http://n/", "alone"),
    (3, "http://c/", None),
    (4, "http://d/", ""),
    (6, "http://e/\r\nX: y", INNER),
    (7, "http://f/", "before " + INNER + INNER + "after"),
    (8, "http://g/", MAGIC * 3),
    (10, "http://h/", "x\r\n\r\ny\r\n\r\n" + MAGIC + "Content-Length: 99999\r\n\r\n"),
    (11, "http://i/", "Ünïcödé 😀 " * 20000),
]


def brute(rows, least=0):
    first = defaultdict(list)
    for i, _, h in rows:
        first[h or ""].append(i)
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        low = min((x for x in first[h or ""] if x is not None), default=None)
        revisit = len(b) >= least and low is not None and i != low
        out[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", low if revisit else None] += 1
    return out


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, round_trip(pages).collect())) == brute(rows)


def test_odd(spark):
    for least, per_file in ((0, 4096), (5, 3)):
        df = spark.createDataFrame(ODD, SCHEMA)
        assert Counter(map(tuple, round_trip(df, least=least, records_per_file=per_file).collect())) == brute(ODD, least)
    assert round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_are_what_they_should_be(spark, tmp_path):
    """Walk the files byte by byte, as any reader does."""
    write_archives(spark.createDataFrame(ODD, SCHEMA).repartition(2), f"{tmp_path}/a")
    n = 0
    for name in glob.glob(f"{tmp_path}/a/part-*"):
        data = gzip.open(name).read()
        at = 0
        while at < len(data):
            assert data[at:].startswith(MAGIC.encode())
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
            at = end + 4 + int(head["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            n += 1
    assert n == len(ODD)


def test_large_files_are_read_in_parts(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " + (INNER if i % 7 == 0 else "") + "z" * (i * 37 % 400)) for i in range(600)]
    write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/a", compression="none")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_records(spark, f"{tmp_path}/a").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert Counter((r.page_id, r["size"], r.digest) for r in got) == Counter((i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows)
