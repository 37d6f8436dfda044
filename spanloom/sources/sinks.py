"""Writers: append-only records, graphs, scored rows, report tables. Spark's committers make each of them all or nothing."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_records(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; readers see whole commits only."""
    df.write.mode("append").json(path)


def replace_json(path: str, body: Mapping) -> None:
    """Replace a small driver-side file: a temporary file beside it, synced, then renamed."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w") as f:
        json.dump(body, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, target)


def journal(path: str, event: str, at: str, **fields) -> None:
    """Append one event line on the driver."""
    with open(path, "a") as f:
        f.write(json.dumps({"event": event, "time": at, **fields}, sort_keys=True) + "\n")


def index_triples(index: DataFrame, base: str = "urn:lexicon:") -> DataFrame:
    """s, p, o, datatype of a surface index: a node for each key, and one node for each (key, type) that holds the count."""
    from ..operators.numbering import with_number

    rows = with_number(index, "key", name="n").withColumn("n", F.col("n") + 1)
    node = F.concat(F.lit(base + "entry/"), F.col("n").cast("string"))
    integer = F.lit("http://www.w3.org/2001/XMLSchema#integer")
    rows = rows.select("*", node.alias("node"), F.posexplode_outer(F.array_sort(F.map_entries("types"))).alias("i", "t"))
    link = F.concat("node", F.lit("/type/"), F.col("i").cast("string"))
    none = F.lit(None).cast("string")
    one = [F.struct(F.col("node").alias("s"), F.lit(base + "label").alias("p"), F.col("label").alias("o"), none.alias("datatype")), F.struct(F.col("node").alias("s"), F.lit(base + "outside").alias("p"), F.col("o").cast("string").alias("o"), integer.alias("datatype"))]
    typed = [
        F.struct(F.col("node").alias("s"), F.lit(base + "annotatedAs").alias("p"), link.alias("o"), F.lit("uri").alias("datatype")),
        F.struct(link.alias("s"), F.lit(base + "type").alias("p"), F.concat(F.lit(base + "class/"), F.col("t.key")).alias("o"), F.lit("uri").alias("datatype")),
        F.struct(link.alias("s"), F.lit(base + "frequency").alias("p"), F.col("t.value").cast("string").alias("o"), integer.alias("datatype")),
    ]
    triples = F.when(F.coalesce("i", F.lit(0)) == 0, F.array(*one)).otherwise(F.array().cast("array<struct<s:string,p:string,o:string,datatype:string>>"))
    more = F.when(F.col("i").isNotNull(), F.array(*typed)).otherwise(F.array().cast("array<struct<s:string,p:string,o:string,datatype:string>>"))
    return rows.select(F.inline(F.concat(triples, more)))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """datatype 'uri' marks objects that are nodes."""
    text = F.col("o")
    for a, b in ((r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        text = F.regexp_replace(text, a, b)
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">")), F.lit("")))
    obj = F.when(F.col("datatype") == "uri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(literal)
    triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), obj, F.lit(" ."))).write.mode("overwrite").text(path)


def add_synthetic_index(index: DataFrame, rows: DataFrame, track: str, path: str) -> None:
    """Write a synthetic index; raises before anything is written if rows of another track are among its sources."""
    if rows.where(F.coalesce(F.col("track") != track, F.lit(True))).limit(1).count():
        raise ValueError(f"rows outside track {track}")
    index.write.mode("overwrite").parquet(path)


def insert_entities(triples: DataFrame, entities: DataFrame, label: str, kind: str, base: str = "urn:entity:") -> DataFrame:
    """Triples with new entities (label, kind_uri): an exact label that exists keeps its node, others get one from their text's hash."""
    known = triples.where(F.col("p") == label).groupBy(F.col("o").alias("label")).agg(F.min("s").alias("s"))
    rows = entities.distinct().join(known, "label", "left").withColumn("s", F.coalesce("s", F.concat(F.lit(base), F.sha2("label", 256))))
    fresh = rows.select("s", F.lit(label).alias("p"), F.col("label").alias("o"), F.lit(True).alias("literal")).union(rows.select("s", F.lit(kind), "kind_uri", F.lit(False)))
    return triples.select("s", "p", "o", "literal").union(fresh).dropDuplicates()


def insert_relations(triples: DataFrame, relations: DataFrame, label: str) -> DataFrame:
    """Triples with relations (source, predicate, target) between nodes of these exact labels; relations without both nodes are left out."""
    node = triples.where(F.col("p") == label).groupBy("o").agg(F.min("s").alias("s"))
    rows = relations.join(node.select(F.col("o").alias("source"), "s"), "source").join(node.select(F.col("o").alias("target"), F.col("s").alias("t")), "target")
    return triples.select("s", "p", "o", "literal").union(rows.select("s", "predicate", "t", F.lit(False))).dropDuplicates()


def write_scored(df: DataFrame, path: str, run: str) -> None:
    """One run's scored rows as its own partition, replaced as a whole."""
    df.withColumn("run", F.lit(run)).write.partitionBy("run").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def derive_run(spark: SparkSession, path: str, source: str, run: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """A run made from a stored one: its records with ``change``, its failures as they are. Each replaces the partition of ``run`` as a whole.

    ``path`` holds ``records`` and ``failures``, both parted by run. Failures are written last, so a run that has them is complete.
    """
    for name, made in (("records", change), ("failures", lambda df: df)):
        rows = spark.read.parquet(f"{path}/{name}").where(F.col("run") == source).drop("run")
        write_scored(made(rows), f"{path}/{name}", run)


def write_subset(ids: DataFrame, path: str, order: str, most: int = 100_000) -> None:
    """An evaluation subset as a manifest: one JSON row with the ids (column ``sid``) in order. More than ``most`` ids are no subset and raise ValueError."""
    if ids.limit(most + 1).count() > most:
        raise ValueError(f"a subset holds {most} ids at most")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col("sid").cast("string").alias("sid")))), lambda x: x["sid"])
    ids.agg(F.count("*").alias("n"), listed.alias("sentence_ids")).coalesce(1).write.mode("overwrite").json(path)


def report_rows(df: DataFrame, most: int = 10_000) -> list:
    """All rows of a report table; more than ``most`` are no report and raise ValueError, so none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table holds {most} rows at most")
    return rows


def write_table(df: DataFrame, path: str, columns: Sequence[str], caption: str) -> str:
    """A report table as CSV (four decimals, null empty); returns it as LaTeX (three decimals, null --). See :func:`report_rows`."""
    kinds = dict(df.dtypes)

    def cell(c: str, digits: int, null: str):
        text = F.format_string(f"%.{digits}f", c) if kinds[c] in ("double", "float") else F.col(c).cast("string")
        return F.coalesce(text, F.lit(null)).alias(c)

    rows = report_rows(df.select(*[cell(c, 3, "--") for c in columns]))
    df.select(*[cell(c, 4, "") for c in columns]).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    escape = str.maketrans({"_": r"\_", "%": r"\%"})
    lines = [" & ".join(str(v).translate(escape) for v in r) + r" \\" for r in rows]
    head = " & ".join(c.translate(escape) for c in columns) + r" \\"
    return "\n".join([rf"\begin{{table}}\caption{{{caption.translate(escape)}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head, r"\midrule", *lines, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def write_markdown(sections: Mapping[str, DataFrame], path: str, title: str) -> None:
    """A report of small tables as Markdown. See :func:`report_rows`."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = report_rows(df)
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    Path(path).write_text("\n".join(out) + "\n")


def prompt_batches(prompts: DataFrame, order: str, size: int, path: str) -> None:
    """Prompts in files of ``size`` items."""
    from ..operators.sampling import batches

    batches(prompts, order, size).write.partitionBy("batch").mode("overwrite").json(path)


_scratch: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A machine-local folder is taken in local mode alone; a cluster without the setting raises ValueError.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that executors share")
        at = tempfile.mkdtemp(prefix="spanloom-")
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder, deleted when the process ends."""
    path = f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended  # noqa: BLE001
            continue
