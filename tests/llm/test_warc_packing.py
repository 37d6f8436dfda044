from collections import Counter

from spanloom.llm.warc import MAGIC, read_records, write_archives


def test_packing_may_change_between_reads(spark, tmp_path):
    """The second read of the archives packs all files into one partition."""
    rows = [(i, f"http://x/{i}", f"page {i} {MAGIC if i % 3 else ''} " + "z" * (i * 37 % 400)) for i in range(120)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), f"{tmp_path}/a")
    got = read_records(spark, f"{tmp_path}/a")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert Counter((r.page_id, r["size"]) for r in got.collect()) == Counter((i, len(h)) for i, _, h in rows)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
