"""Readers, writers, streams and plumbing."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.plans import experiments as ex
from spanloom.sources import readers as rd
from spanloom.sources import sinks as sk
from spanloom.streaming import queue as qu


def write(path, text):
    path.write_text(text)
    return str(path)


def test_bio_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", "words,sentence_id,labels\nLung,2,B-Disease\ncancer,2,I-Disease\n.,2,\nA,1,I-Disease\n")
    rows = {r.sid: r for r in rd.read_bio_csv(spark, p, "d", "dev", ["Disease"]).collect()}
    assert rows["d:dev:2"].tokens == ["Lung", "cancer", "."] and [tuple(x) for x in rows["d:dev:2"].spans] == [(0, 2, "Disease")]
    assert rows["d:dev:1"].repaired == 1 and rows["d:dev:2"].pos < rows["d:dev:1"].pos
    with pytest.raises(Exception, match="outside the schema"):
        rd.read_bio_csv(spark, p, "d", "dev", ["Chemical"]).collect()


def test_synthetic(spark, tmp_path):
    p = write(tmp_path / "s.csv", 'sentence,value,temperature,domain\n"Aspirin helps, a lot.",0.5,1.0,Sub Stance\n')
    r = rd.read_synthetic(spark, p, "d", {"substance": "Chemical"}).first()
    assert (r.sid, r.type, r.tokens[-1]) == ("d:s_full:0", "Chemical", ".")
    with pytest.raises(Exception, match="unknown domain"):
        rd.read_synthetic(spark, p, "d", {"x": "y"}).collect()


def test_jsonl(spark, tmp_path):
    torn = write(tmp_path / "a.jsonl", '{"a":1}\n{"a":2}\n{"a":3, "b"')
    assert sorted(r.a for r in rd.read_jsonl(spark, torn, "a int").collect()) == [1, 2]
    broken = write(tmp_path / "b.jsonl", '{"a":1}\n{"a":\n{"a":3}\n')
    with pytest.raises(Exception, match="broken line"):
        rd.read_jsonl(spark, broken, "a int").collect()
    whole = write(tmp_path / "c.jsonl", '{"a":1}\n{"a":2}')
    assert rd.read_jsonl(spark, whole, "a int").count() == 2
    assert rd.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").collect() == []
    silver = write(tmp_path / "d.jsonl", '{"sid":"x","tokens":["a","b"],"spans":[[0,2,"T"]],"label_source":"s"}\n')
    assert [tuple(x) for x in rd.read_silver(spark, silver).first().spans] == [(0, 2, "T")]


def test_graphs(spark, tmp_path):
    nt = '<u:1> <u:label> "Heart \\"x\\"" .\n# note\n\n<u:1> <u:type> <http://k#Disease> .\n<http://k#Disease> <u:type> <http://www.w3.org/2002/07/owl#Class> .\n<http://k#Disease> <u:label> "Disease"@en .\n<u:2> <u:label> "" .\n<u:1> <u:n> "3"^^<http://www.w3.org/2001/XMLSchema#integer> .\n'
    t = rd.read_ntriples(spark, write(tmp_path / "g.nt", nt))
    assert t.count() == 6 and {r.o for r in t.where("literal").collect()} == {'Heart "x"', "Disease", "", "3"}
    labels = {r.uri: (r.label, r.kinds) for r in rd.graph_labels(t, "u:label", "u:type").collect()}
    assert labels == {"u:1": ("heart x", ["Disease"]), "u:2": ("", [])}
    q = spark.createDataFrame([("heart", "Disease")], "q string, kind string")
    assert [r.uri for r in rd.external_matches(q, t, "u:label", "u:type", least=0.5).collect()] == ["u:1"]
    sk.write_ntriples(t.select("s", "p", "o", F.when(~F.col("literal"), "uri").otherwise(F.col("datatype")).alias("datatype")), str(tmp_path / "out"))
    assert sorted(map(str, rd.read_ntriples(spark, str(tmp_path / "out")).collect())) == sorted(map(str, t.collect()))
    with pytest.raises(Exception, match="not a triple"):
        rd.read_ntriples(spark, write(tmp_path / "bad.nt", "nonsense\n")).collect()
    more = sk.insert_entities(t, spark.createDataFrame([('Heart "x"', "k#D"), ("New", "k#D")], "label string, kind_uri string"), "u:label", "u:type")
    assert more.where("p = 'u:label'").count() == 4
    linked = sk.insert_relations(more, spark.createDataFrame([("New", "u:rel", 'Heart "x"'), ("None", "u:rel", "New")], "source string, predicate string, target string"), "u:label")
    assert [r.o for r in linked.where("p = 'u:rel'").collect()] == ["u:1"]

    def parse(text):
        if "bad" in text:
            raise ValueError("bad")
        return [("s", "p", text.strip(), True)]

    write(tmp_path / "a.ttl", "x\n"), write(tmp_path / "b.ttl", "bad\n")
    got = rd.read_turtle(spark, [str(tmp_path / "*.ttl")], parse).collect()
    assert sorted(r.error is None for r in got) == [False, True]


def test_triples_keep_every_sign(spark, tmp_path):
    texts = ["C:\\new\\table", "\\\\n", "\n\t\r\b\f", '"quoted\\"', "end\\", "\\u0041", "é €", "𝄞", *[f"a{chr(i)}b" for i in range(32)]]
    rows = spark.createDataFrame([(f"u:{i}", "u:p", t, None) for i, t in enumerate(texts)], "s string, p string, o string, datatype string")
    sk.write_ntriples(rows, str(tmp_path / "all"))
    assert {r.s: r.o for r in rd.read_ntriples(spark, str(tmp_path / "all")).collect()} == {f"u:{i}": t for i, t in enumerate(texts)}
    coded = write(tmp_path / "c.nt", '<u:1> <u:p> "\\u00E9 \\U0001D11E \\\\u0041 \\\'" .\n')
    assert rd.read_ntriples(spark, coded).first().o == "é 𝄞 \\u0041 '"


def test_reports_drop_no_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="rows at most"):
        sk.write_table(spark.range(10_001), str(tmp_path / "t"), ["id"], "long")
    with pytest.raises(ValueError, match="rows at most"):
        sk.write_markdown({"one": spark.range(10_001)}, str(tmp_path / "r.md"), "long")


def test_iob_models_subsets_answers(spark, tmp_path):
    p = write(tmp_path / "x.iob", "Lung NN B-Disease\ncancer NN I-disease\n\nAspirin B-Drug\n")
    rows = sorted(rd.read_iob(spark, p).collect(), key=lambda r: r.pos)
    assert [r.labels for r in rows] == [["B-disease", "I-disease"], ["B-substance"]]
    (tmp_path / "m").mkdir()
    write(tmp_path / "m" / "config.json", json.dumps({"id2label": {"0": "O", "1": "B-x", "2": "I-x"}}))
    assert rd.read_models(str(tmp_path))[0]["labels"] == ["B-x", "I-x", "O"] and rd.label_types(["O", "B-x", "I-x"]) == ["x"]
    s = write(tmp_path / "sub.json", '{"sentence_ids": ["b", "a"]}')
    assert [(r.pos, r.sid) for r in rd.read_subset(spark, s).collect()] == [(0, "b"), (1, "a")]
    a, b = write(tmp_path / "o.jsonl", '{"id":"1","content":"first"}\nbroken\n{"id":"2"}\n'), write(tmp_path / "r.jsonl", '{"id":"1","content":"second"}\n{"id":"2","content":"fixed"}\n')
    assert {r.custom_id: r.content for r in rd.read_answers(spark, a, b).collect()} == {"1": "first", "2": "fixed"}
    md = write(tmp_path / "b.md", "# t\n### one\nbody a\nmore\n### two\nbody b\n")
    assert [(r.heading, r.body) for r in rd.read_markdown_items(spark, md).collect()] == [("one", "body a\nmore"), ("two", "body b")]


def test_chat_and_embeddings(spark):
    def answer(messages):
        if "timeout" in messages:
            raise TimeoutError("slow")
        if "bad" in messages:
            raise ValueError("no")
        return messages.upper()

    got = {r.key: (r.content, r.tries, r.error) for r in rd.chat(spark.createDataFrame([("a", "hi"), ("b", "timeout"), ("c", "bad")], "key string, messages string"), answer).collect()}
    assert got["a"][:2] == ("HI", 1) and got["b"][:2] == (None, 3) and got["c"][:2] == (None, 1)
    texts = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    cache = spark.createDataFrame([], "key string, v array<double>")
    v = rd.embed(texts, cache, "m", lambda ts: [[3.0, 4.0] for _ in ts])
    assert [list(r.v) for r in v.collect()] == [[0.6, 0.8]] * 2
    with pytest.raises(Exception, match="not in the cache"):
        rd.embed(texts, cache, "m", None).collect()
    pieces = rd.classify(spark.createDataFrame([("1", "ab")], "sid string, text string"), lambda ts: [[(0, 2, "ab", "B-x", 0.9)] for _ in ts])
    assert pieces.first().label == "B-x"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.12345, None), ("c", None, 3)], "name string, score double, n int")
    tex = sk.write_table(df, str(tmp_path / "t"), ["name", "score", "n"], "50 % cap")
    assert r"a\_b & 0.123 & --" in tex and r"50 \% cap" in tex
    assert "a_b,0.1235," in "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    sk.write_markdown({"one": df}, str(tmp_path / "r.md"), "Report")
    assert "| a_b | 0.1235 |" in (tmp_path / "r.md").read_text() or "| a_b | 0.1234 |" in (tmp_path / "r.md").read_text()
    sk.replace_json(str(tmp_path / "m.json"), {"a": 1})
    sk.journal(str(tmp_path / "j"), "start", "now", x=1)
    assert json.loads((tmp_path / "j").read_text())["x"] == 1
    sk.append_records(df, str(tmp_path / "log"))
    sk.append_records(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sk.write_scored(df, str(tmp_path / "scored"), "r1")
    sk.write_scored(df, str(tmp_path / "scored"), "r2")
    sk.write_scored(df, str(tmp_path / "scored"), "r1")
    assert spark.read.parquet(str(tmp_path / "scored")).count() == 4


def test_streamed_work(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "key string, payload string"

    def process(key, payload):
        if payload == "fail":
            raise ValueError("no")
        return payload.upper()

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)

    def run():
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        qu.drain(qu.work(spark.readStream.schema(schema).json(src), process, 3), out, ck)
        return sorted((r.key, r.attempt, r.result, r.abandoned) for r in spark.read.parquet(out).collect())

    put([("a", "x"), ("b", "fail"), ("c", "fail")])
    assert run() == [("a", 1, "X", False), ("b", 1, None, False), ("c", 1, None, False)]
    put([("a", "again"), ("b", "ok"), ("c", "fail")])
    put([("c", "fail")])
    put([("c", "late")])
    rows = run()
    assert ("b", 2, "OK", False) in rows and ("c", 3, None, True) in rows and len([r for r in rows if r[0] == "a"]) == 1
    assert not [r for r in rows if r[0] == "c" and r[2]]
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    done = spark.read.parquet(out).where("result IS NOT NULL")
    failed = spark.read.parquet(out).where("result IS NULL")
    assert [r.key for r in qu.pending(items, done, failed, 3).collect()] == ["d"]
    s = qu.status(items, done, failed, 3).first()
    assert (s.completed, s.abandoned, s.remaining, s.state) == (2, 1, 1, "partial")


def test_queue_shares_states(spark, tmp_path):
    """Calls and states are bounded by the groups, and each key still has its own attempts, over two runs."""
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "key string, payload string"
    keys = [None, "", *map(str, range(298))]
    fails = {k: i % 4 for i, k in enumerate(keys)}
    spark.createDataFrame([(k, f"{k}|{i}") for i, k in enumerate(keys)], schema).write.parquet(src)

    def process(key, payload):
        name, left = payload.split("|")
        if int(left) % 4:
            raise ValueError(name)
        return name

    def run():
        before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            qu.drain(qu.work(spark.readStream.schema(schema).parquet(src), process, 3, groups=8), out, ck)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before[0])
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])
        return sorted(((r.key, r.attempt, r.result, r.abandoned) for r in spark.read.parquet(out).collect()), key=str)

    first = [(k, 1, None if n else str(k), False) for k, n in fails.items()]
    assert run() == sorted(first, key=str)
    assert 1 < spark.read.format("statestore").load(ck).count() <= 8
    # all come thrice more, and fail; those that were done give nothing
    again = [(k, f"{k}|1") for k in keys for _ in range(3)]
    spark.createDataFrame(again, schema).write.mode("append").parquet(src)
    more = [(k, a, None, a == 3) for k, n in fails.items() if n for a in (2, 3)]
    assert run() == sorted(first + more, key=str)
    assert spark.read.format("statestore").load(ck).count() <= 8


def test_plumbing(spark):
    c = ex.merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}})
    assert c == {"a": {"x": 1, "y": 3}, "b": 1} and ex.identity(c) == ex.identity({"b": 1, "a": {"y": 3, "x": 1}})
    assert len(ex.grid(a=[1, 2, 3], b=[1, 2], c=[1, 2, 3])) == 18 == ex.grid_frame(spark, a=[1, 2, 3], b=[1, 2], c=[1, 2, 3]).count()
    for bad in ({"split": "test"}, {"pools": ["test"]}, {"kg_splits": ["test"]}):
        with pytest.raises(ValueError):
            ex.check_protocol(bad)
    ex.check_protocol({"split": "test", "frozen": True, "pools": ["train"]})
    with pytest.raises(ValueError):
        ex.check_splits(spark.createDataFrame([("test",)], "split string"), ["train"])
    runs = spark.createDataFrame([("m", "r1"), ("m", "r2"), ("n", "r1")], "model string, runtime string")
    assert [r.model for r in ex.one_runtime(runs).collect()] == ["m"]
    assert ex.manifest({"a": 2}, 1, 3)["status"] == "complete_with_failures" and ex.same_labels(["a"], ["b"]) == ["a", "b"]


def test_restarts():
    seen = []

    def run():
        seen.append("run")
        if len([x for x in seen if x == "run"]) < 3:
            raise ConnectionError("gone")

    assert qu.with_restarts(run, lambda: False, lambda: seen.append("restart"), wait=0) == 2
    assert seen == ["run", "restart", "run", "restart", "run"]
    with pytest.raises(ValueError):
        qu.with_restarts(lambda: (_ for _ in ()).throw(ValueError("own")), lambda: True, lambda: None, wait=0)
    p = qu.Progress(10)
    assert p.remaining is None
