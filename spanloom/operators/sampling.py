"""Seeded samples: by stratum with largest remainders, and plain ones. The order is md5(seed | id), the same on any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import with_number


def seeded(seed: int, id_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), id_.cast("string")))


def allocate(sizes: DataFrame, n: int) -> DataFrame:
    """stratum, size, quota of rows (stratum, size): n rows in proportion, by largest remainders, with at least one for each stratum.

    Shares are exact: n * size = floor * total + remainder. Missing rows go to the largest remainders, one each; where the strata that get their
    one row take too much, the largest quotas are levelled. Ties go by the stratum's name. Ranks come from range partitions, so
    there may be any number of strata.
    """
    total = sizes.agg(F.sum("size").cast("decimal(38,0)").alias("total"))
    share = F.lit(n).cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)")
    rows = sizes.join(F.broadcast(total)).select("stratum", "size", "total", F.greatest(F.lit(1), F.floor(share / F.col("total"))).cast("long").alias("q"), (share % F.col("total")).alias("rest"))
    # a quotient of decimals is rounded, so it may reach the next whole number
    rows = rows.withColumn("q", F.when((F.col("q") > 1) & (F.col("q") * F.col("total") > share), F.col("q") - 1).otherwise(F.col("q")))
    ranked = with_number(rows.withColumn("open", (F.col("q") < F.col("size")).cast("int")), F.desc("open"), F.desc("rest"), "stratum", name="rank")
    missing = F.lit(n) - F.sum("q")
    found = ranked.agg(missing.alias("missing"), F.sum("size").alias("all"))
    # how far the largest quotas come down: the highest level at which enough is saved
    levels = ranked.groupBy("q").agg(F.count("*").alias("k"))
    down = Window.orderBy(F.desc("q"))  # rows are distinct quotas: fewer than the root of twice their sum
    lower = levels.select("q", F.sum("k").over(down).alias("many"), F.sum(F.col("q") * F.col("k")).over(down).alias("words"))
    # between two quotas the saving grows by ``many`` for each step down
    reach = lower.join(F.broadcast(found.where((F.col("missing") < 0) & (F.col("all") > n)))).withColumn("level", F.floor((F.col("words") + F.col("missing")) / F.col("many")))
    level = reach.where("level < q").agg(F.max(F.struct("level", (F.col("words") + F.col("missing") - F.col("level") * F.col("many")).alias("back"))).alias("l"))
    quota = F.when(F.col("all") <= n, F.col("size")).when(F.col("missing") >= 0, F.col("q") + ((F.col("open") == 1) & (F.col("rank") < F.col("missing"))).cast("int"))
    joined = ranked.join(F.broadcast(found)).join(F.broadcast(level))
    above = F.col("q") > F.col("l.level")
    kept = with_number(joined.where(above & quota.isNull()).select("stratum"), F.desc("stratum"), name="late")
    out = joined.join(kept, "stratum", "left").withColumn("quota", F.coalesce(quota, F.when(above, F.col("l.level") + (F.col("late") < F.col("l.back")).cast("int")).otherwise(F.col("q"))))
    return out.select("stratum", "size", F.col("quota").cast("long").alias("quota"))


def stratified(df: DataFrame, stratum: str, id_: str, n: int, seed: int = 7) -> DataFrame:
    """n rows, strata in proportion, each stratum's by the seeded hash of the id. A null stratum is called 'none'.

    Inside a stratum the hash's first digits are counted, so only rows up to the digits that fill its quota are ranked, whatever its size.
    """
    rows = df.withColumn("__k", F.coalesce(F.col(stratum).cast("string"), F.lit("none"))).withColumn("__h", seeded(seed, F.col(id_))).withColumn("__d", F.substring("__h", 1, 3))
    counts = rows.groupBy("__k", "__d").agg(F.count("*").alias("c"))
    quota = allocate(counts.groupBy(F.col("__k").alias("stratum")).agg(F.sum("c").alias("size")), n).select(F.col("stratum").alias("__k"), "quota")
    before = F.sum("c").over(Window.partitionBy("__k").orderBy("__d")) - F.col("c")
    digits = counts.withColumn("__before", before).join(quota, "__k").where("__before < quota").select("__k", "__d", (F.col("quota") - F.col("__before")).alias("__left"))
    place = F.row_number().over(Window.partitionBy("__k", "__d").orderBy("__h", id_))
    return rows.join(digits, ["__k", "__d"]).withColumn("__n", place).where("__n <= __left").select(*df.columns)


def rarest_type(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """sid, stratum: the type of a sentence that is rarest in all, ties by name; 'none' without spans."""
    freq = spans.groupBy("type").agg(F.count("*").alias("n"))
    rare = spans.select("sid", "type").distinct().join(F.broadcast(freq), "type").groupBy("sid").agg(F.min(F.struct("n", "type")).alias("m"))
    return sentences.select("sid").distinct().join(rare, "sid", "left").select("sid", F.coalesce("m.type", F.lit("none")).alias("stratum"))


def sample(df: DataFrame, id_: str, n: int, seed: int = 7) -> DataFrame:
    return df.orderBy(seeded(seed, F.col(id_)), id_).limit(n)


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch: rows in order, ``size`` to a batch."""
    return with_number(df, order, name="__n").withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")
