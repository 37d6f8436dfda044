"""Sharding by a consistent-hash ring with virtual nodes and bounded loads. DataFrame operations only.

The ring has ``ring`` places. Every shard owns ``vnodes`` of them, at places hashed from its own number alone, so a shard
that is added takes places from others and no other place changes its owner. A place belongs to the first virtual
node at or clockwise of it. A document's place is the hash of its text, so equal texts (a group) meet in one shard as long
as it has room. Each shard has room for its exact part of the rows (counts of any two shards differ by one at most); rows
that find their shard full continue clockwise to the next shard with room.

Only the counts of the arcs between virtual nodes (``n_shards * vnodes`` numbers) reach the driver, where the overflow is
settled. A row learns its arc's rank from counts by (place, salt), so that a group which holds a third of all rows is
ranked by ``salts`` tasks and not by one. Rows that are alike are counted before they are shuffled.

Defined results: a null text counts as empty (size 1, crc32 0); null or repeated doc_ids are rows like any other, since
the place comes from the text; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_table, materialise


def settle(counts: dict[int, int], owners: list[int], n_shards: int) -> list[dict]:
    """Split the arcs' rows over the shards.

    counts: rows by arc; owners: the shard of each arc's virtual node, in ring order. An arc of more rows than a shard has room for
    comes first and fills one shard clockwise after the other. Then, in turn k, each other arc, the largest first, puts what is
    left of it into the k-th distinct shard clockwise of it, as far as that has room: what has room at home stays there.
    Returns segments: ranks lo to hi (exclusive) of ``arc`` go to ``shard``, where they take slots from ``first`` on.
    """
    n = sum(counts.values())
    room = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    left, done = dict(counts), dict.fromkeys(counts, 0)
    out = []
    ahead: dict[int, list[int]] = {}
    for arc in counts:
        ahead[arc] = list(dict.fromkeys(owners[arc:] + owners[:arc]))

    def put(arc: int, turn: int) -> None:
        shard = ahead[arc][turn]
        take = min(left[arc], room[shard] - used[shard])
        if take > 0:
            out.append({"arc": arc, "lo": done[arc], "hi": done[arc] + take, "shard": shard, "first": used[shard]})
            used[shard] += take
            done[arc] += take
            left[arc] -= take

    by_size = sorted(counts, key=lambda arc: (-counts[arc], arc))
    for arc in by_size:
        if counts[arc] > max(room):
            for turn in range(len(ahead[arc])):
                put(arc, turn)
    for turn in range(n_shards):
        for arc in by_size:
            if turn < len(ahead[arc]):
                put(arc, turn)
    return out


def shard_documents(docs: DataFrame, *, n_shards: int = 8, vnodes: int = 128, ring: int = 1 << 16, salts: int = 32, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard (the ring's owner before any overflow)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(F.lit(seed), text), F.lit(ring)).cast("int").alias("place"),
        )
        .groupBy("doc_id", "size", "text_crc32", "place")
        .agg(F.count("*").alias("alike"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(salts)).cast("int"))
    )
    nodes = (
        spark.range(n_shards * vnodes)
        .select(F.expr(f"id div {vnodes}").cast("int").alias("owner"), (F.col("id") % vnodes).alias("nth"))
        .select("owner", F.pmod(F.xxhash64(F.lit(seed), F.lit("node"), "owner", "nth"), F.lit(ring)).cast("int").alias("at"), "nth")
        .orderBy("at", "owner", "nth")
        .collect()
    )  # n_shards * vnodes rows
    owners = [r["owner"] for r in nodes]
    # the places from the node before (exclusive) up to this node (inclusive) are this node's arc; after the last node the first follows
    arcs = spark.range(ring).select(F.col("id").cast("int").alias("place"))
    ends = literal_table(spark, [{"arc": i, "at": r["at"]} for i, r in enumerate(nodes)], "arc int, at int")
    firsts = ends.groupBy("at").agg(F.min("arc").alias("arc"))
    around = arcs.join(F.broadcast(firsts.withColumnRenamed("at", "place")), "place", "left").select(
        "place", F.coalesce(F.last("arc", ignorenulls=True).over(Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("arc")
    )
    around = materialise(around)  # one row for each place of the ring
    counts = rows.groupBy("place", "salt").agg(F.sum("alike").alias("n")).join(F.broadcast(around), "place")
    before = Window.partitionBy("arc").orderBy("place", "salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    by_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    segments = literal_table(spark, settle(by_arc, owners, n_shards), "arc int, lo long, hi long, shard int, first long")
    homes = literal_table(spark, [{"arc": i, "home_shard": s} for i, s in enumerate(owners)], "arc int, home_shard int")
    within = Window.partitionBy("place", "salt").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(counts.select("place", "salt", "arc", "base"), ["place", "salt"]).withColumn("low", F.col("base") + F.coalesce(F.sum("alike").over(within), F.lit(0)))
    ranked = ranked.select("doc_id", "size", "text_crc32", "arc", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("alike") - 1)).alias("rank"))
    s, r = segments.alias("s"), ranked.alias("r")
    return (
        r.join(F.broadcast(s), F.expr("r.arc = s.arc AND r.rank >= s.lo AND r.rank < s.hi"))
        .join(F.broadcast(homes.alias("h")), F.expr("r.arc = h.arc"))
        .select(
            "r.doc_id", "r.size", "r.text_crc32", F.lit("rows").alias("law"), "s.shard", (F.col("s.first") + F.col("r.rank") - F.col("s.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "h.home_shard"
        )
    )
