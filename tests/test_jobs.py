"""The jobs over growing and repeated input, and their command lines."""

import json
import os
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import annotate_texts, build_prompts
from jobs.settings import from_file, read_settings

ROOT = Path(__file__).parent.parent


def records(spark, at):
    return sorted(str(r) for r in spark.read.schema(annotate_texts.RECORD).parquet(f"{at}/annotations").drop("batch").collect())


def lines(folder):
    return sorted(line for p in Path(folder).rglob("*.json") for line in p.read_text().splitlines())


def run(spark, sf, documents, at, **settings):
    return annotate_texts.run(spark, documents=str(documents), passages=f"{sf}/benchmark.parquet", output=f"{at}/out", checkpoint=f"{at}/mark", settings=annotate_texts.Settings(**settings))


def test_annotations_of_growing_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    grown = tmp_path / "documents"
    docs.where("doc_id % 3 = 0").repartition(2).write.parquet(str(grown))
    first = run(spark, sf, grown, tmp_path, files_per_batch=1)
    assert first["batches"] == 2 and first["written"] == first["read"] == docs.where("doc_id % 3 = 0").count()
    before = records(spark, tmp_path / "out")

    # new documents, together with some that were annotated before, one changed text and one without text
    docs.where("doc_id % 3 = 1 OR doc_id < 9").coalesce(1).write.mode("append").parquet(str(grown))
    changed = docs.where("doc_id = 0").withColumn("text", F.concat("text", F.lit(" changed")))
    changed.union(changed).union(changed.withColumn("doc_id", F.lit(-1)).withColumn("text", F.lit(None).cast("string")).withColumn("lang", F.lit(""))).coalesce(1).write.mode("append").parquet(str(grown))
    second = run(spark, sf, grown, tmp_path)
    assert second["batches"] == 1 and second["read"] == docs.where("doc_id % 3 = 1 OR doc_id < 9").count() + 3
    assert second["written"] == docs.where("doc_id % 3 = 1 OR doc_id < 9 AND doc_id % 3 <> 0").count() + 2
    after = records(spark, tmp_path / "out")
    assert set(before) < set(after)

    # nothing new
    report = lines(tmp_path / "out/report")
    assert run(spark, sf, grown, tmp_path) == {"read": 0, "written": 0, "batches": 0}
    assert records(spark, tmp_path / "out") == after and lines(tmp_path / "out/report") == report

    # all at once gives the same
    run(spark, sf, grown, tmp_path / "again")
    assert records(spark, tmp_path / "again/out") == after and lines(tmp_path / "again/out/report") == report
    texts = {r.doc_id: r for r in spark.read.schema(annotate_texts.RECORD).parquet(str(tmp_path / "out/annotations")).where("doc_id = -1").collect()}
    assert (texts[-1].n_tokens, texts[-1].spans, texts[-1].held_back, texts[-1].lang) == (0, [], False, "unknown")


def test_a_batch_that_is_repeated(spark, sf, tmp_path):
    """The batch was written, but the run ended before the checkpoint knew: it is taken again and leaves the same."""
    grown = tmp_path / "documents"
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(str(grown))
    run(spark, sf, grown, tmp_path)
    before = records(spark, tmp_path / "out")
    for p in (tmp_path / "mark/commits").iterdir():
        if not p.name.startswith("."):
            p.unlink()
    for p in (tmp_path / "mark/commits").iterdir():
        p.unlink()
    assert run(spark, sf, grown, tmp_path)["batches"] == 1
    assert records(spark, tmp_path / "out") == before


def test_annotations_of_odd_rows(spark, tmp_path):
    passages = spark.createDataFrame([(1, "one two three four five six seven"), (2, "four five six seven eight nine ten"), (3, None), (4, "one two three four five six seven")], "item_id long, text string")
    passages.write.parquet(str(tmp_path / "p"))
    text = "Zero One two three four five six seven eight nine ten eleven"
    rows = [(1, text, None, "s"), (1, text, "en", "s"), (2, "one two three", "en", None), (None, text, "de", "s"), (3, "", "", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' AS key", "7 AS spans", "'y' AS batch").write.parquet(str(tmp_path / "d"))
    annotate_texts.run(spark, documents=str(tmp_path / "d"), passages=str(tmp_path / "p"), output=str(tmp_path / "o"), checkpoint=str(tmp_path / "c"))
    got = {r.doc_id: r for r in spark.read.schema(annotate_texts.RECORD).parquet(str(tmp_path / "o/annotations")).collect()}
    # passages 1 and 4 are the same stretch, which is as long as that of 2 and further left
    for i, lang in ((1, "en"), (None, "de")):
        assert (got[i].lang, got[i].n_tokens, [tuple(s) for s in got[i].spans], got[i].n_tagged, got[i].held_back) == (lang, 12, [(1, 8, "1")], 7, True)
    assert (got[2].spans, got[2].n_tokens, got[2].held_back) == ([], 3, False)
    assert len(got) == 4 and got[3].lang == "unknown"


def test_prompts_twice_and_grown(spark, sf, tmp_path):
    given = {"labels": f"{sf}/labels.parquet", "passages": f"{sf}/benchmark.parquet", "output": str(tmp_path / "out")}
    settings = build_prompts.Settings(batch_size=7, batches_per_part=3)
    counts = build_prompts.run(spark, documents=f"{sf}/documents.parquet", settings=settings, **given)
    first = lines(tmp_path / "out/prompts"), lines(tmp_path / "out/manifest")
    assert build_prompts.run(spark, documents=f"{sf}/documents.parquet", settings=settings, **given) == counts
    assert (lines(tmp_path / "out/prompts"), lines(tmp_path / "out/manifest")) == first
    rows = spark.read.schema(build_prompts.PROMPT).json(str(tmp_path / "out/prompts")).orderBy("batch", "position").collect()
    assert [r.batch * 7 + r.position for r in rows] == list(range(len(rows))) and [(r.lang, r.doc_id) for r in rows] == sorted((r.lang, r.doc_id) for r in rows)
    assert all(r.part == r.batch // 3 for r in rows) and counts["batches"] == -(-len(rows) // 7)
    sizes = [json.loads(line)["prompts"] for line in first[1]]
    assert sum(sizes) == len(rows) == counts["prompts"]
    # fewer documents leave no batches of the former run behind
    spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 50").write.parquet(str(tmp_path / "few"))
    fewer = build_prompts.run(spark, documents=str(tmp_path / "few"), settings=settings, **given)
    assert 0 < fewer["prompts"] < counts["prompts"] and len(lines(tmp_path / "out/prompts")) == fewer["prompts"]


def test_prompts_of_odd_rows(spark, tmp_path):
    docs = [(1, "Good  text here", "en"), (2, "good text", "en"), (3, "ask me", "en"), (4, "ask \n me", "en"), (5, None, "en"), (6, " ", "en"), (None, "no id", "en"), (7, "demande", None), (8, "Good text here", "en"), (9, "in the test set", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' AS n", "1 AS batch", "'k' AS kind", "2 AS shown").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(8, 1, 0), (2, 0, 1), (9, 1, 0), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([(1, "In the  test set"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "p"))
    build_prompts.run(spark, documents=str(tmp_path / "d"), labels=str(tmp_path / "l"), passages=str(tmp_path / "p"), output=str(tmp_path / "o"))
    got = {r.doc_id: r for r in spark.read.schema(build_prompts.PROMPT).json(str(tmp_path / "o/prompts")).collect()}
    assert sorted(got) == [3, 7]
    assert (got[3].copies, got[3].lang, got[3].shown, got[3].batch, got[3].position) == (2, "en", 2, 0, 0) and (got[7].lang, got[7].shown, got[7].position) == ("none", 0, 1)
    assert '[USER]\nGood text here\n\n[ASSISTANT]\n{"quality":1,"toxic":0}' in got[3].prompt and "test set" not in got[3].prompt
    assert got[7].prompt.endswith("[USER]\ndemande") and got[3].prompt.startswith("[SYSTEM]\nJudge")


def test_empty_tables(spark, tmp_path):
    for name, schema in (("d", "doc_id long, text string, lang string, source string"), ("l", "doc_id long, quality int, toxic int"), ("p", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    paths = {"documents": str(tmp_path / "d"), "passages": str(tmp_path / "p")}
    assert annotate_texts.run(spark, output=str(tmp_path / "a"), checkpoint=str(tmp_path / "c"), **paths)["written"] == 0
    assert records(spark, tmp_path / "a") == []
    assert build_prompts.run(spark, labels=str(tmp_path / "l"), output=str(tmp_path / "o"), **paths) == {"read": 0, "prompts": 0, "batches": 0}


def test_settings(spark):
    for kind, name in ((annotate_texts.Settings, "annotate_texts"), (build_prompts.Settings, "build_prompts")):
        assert from_file(spark, str(ROOT / f"jobs/{name}.json"), kind) == kind()
    assert read_settings(annotate_texts.Settings, {"tokens": 8}) == replace(annotate_texts.Settings(), tokens=8)
    with pytest.raises(ValueError, match="token_s"):
        read_settings(annotate_texts.Settings, {"token_s": 8})


def test_command_lines(sf, tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    common = ["--documents", f"{sf}/documents.parquet", "--passages", f"{sf}/benchmark.parquet"]
    for module, more in (("jobs.annotate_texts", ["--checkpoint", f"{tmp_path}/c", "--output", f"{tmp_path}/a"]), ("jobs.build_prompts", ["--labels", f"{sf}/labels.parquet", "--output", f"{tmp_path}/b"])):
        got = subprocess.run([sys.executable, "-m", module, *common, *more], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert got.returncode == 0, got.stderr[-3000:]
        assert "written to" in got.stderr and "read from" in got.stderr
    assert lines(tmp_path / "a/report") and lines(tmp_path / "b/prompts") and lines(tmp_path / "b/manifest")
