"""Queries on statistics that are resampled together, and the weight grid at its full resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn
from ..operators import resampling as rs
from ..sources.sinks import scratch
from .catalogue import AUROC, CRITERIA, FAR, SCORED_SQL, auroc_sql, query, scored, six, weights_sql


@query(f"""WITH {SCORED_SQL}, r AS (SELECT source, y, s, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, CAST(t >= 0.4 AS INTEGER) AS passed FROM d), {weights_sql('r', 'source', 60)},
    o AS (SELECT rep, source, w FROM ww UNION ALL SELECT -1, source, 1 FROM u), x AS (SELECT rep, side, s, y, passed, w FROM o JOIN r USING (source)), {auroc_sql('x', 'rep, side', 's', 'y', 'w')},
    g AS (SELECT rep, side, sum(pos * (below + neg / 2.0)) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0) AS auroc FROM b GROUP BY rep, side),
    f AS (SELECT rep, side, 2.0 * sum(w * passed * y) / greatest(sum(w * passed) + sum(w * y), 1) AS f1, sum(w * passed * (1 - y)) / nullif(CAST(sum(w * (1 - y)) AS DOUBLE), 0) AS accepted FROM x GROUP BY rep, side),
    z AS (SELECT rep, max(CASE WHEN side = 'b' THEN auroc END) - max(CASE WHEN side = 'a' THEN auroc END) AS auroc, max(CASE WHEN side = 'b' THEN f1 END) - max(CASE WHEN side = 'a' THEN f1 END) AS f1, max(CASE WHEN side = 'b' THEN accepted END) - max(CASE WHEN side = 'a' THEN accepted END) AS accepted FROM g JOIN f USING (rep, side) GROUP BY rep),
    v AS (UNPIVOT z ON auroc, f1, accepted INTO NAME statistic VALUE v)
    SELECT statistic, round(max(v) FILTER (rep < 0), 6) AS value, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 6) AS high, round(least(1, 2 * least(avg(CAST(v <= 0 AS INTEGER)) FILTER (rep >= 0), avg(CAST(v >= 0 AS INTEGER)) FILTER (rep >= 0))), 6) AS p, count(*) FILTER (rep >= 0) AS replicates FROM v GROUP BY statistic""")
def joint_differences(spark, sf):
    """Differences of AUROC, of F1 and of false acceptance between two conditions, on the same draws of sources."""
    c = F.col
    rows = scored(spark, sf).withColumn("passed", (c("t") >= 0.4).cast("int"))
    side = {"a": c("doc_id") % 2 == 0, "b": c("doc_id") % 2 == 1}
    made = {"tp": c("passed") * c("y"), "passed": c("passed"), "y": c("y"), "fp": c("passed") * (1 - c("y")), "bad": 1 - c("y")}
    sums = {f"{n}_{k}": F.when(cond, e).otherwise(0) for n, e in made.items() for k, cond in side.items()}
    f1 = {k: 2 * c(f"tp_{k}") / F.greatest(c(f"passed_{k}") + c(f"y_{k}"), F.lit(1)) for k in side}
    accepted = {k: F.try_divide(c(f"fp_{k}"), c(f"bad_{k}")) for k in side}
    statistics = {"auroc": c("auroc_b") - c("auroc_a"), "f1": f1["b"] - f1["a"], "accepted": accepted["b"] - accepted["a"]}
    areas = {f"auroc_{k}": (cond, "s") for k, cond in side.items()}
    return six(rs.joint_bootstrap(rows, "source", sums, statistics, areas=areas, reps=60))


@query(f"""WITH {SCORED_SQL}, k AS (SELECT {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in CRITERIA.items())}, y FROM d),
    g AS (SELECT row_number() OVER (ORDER BY i, j, k, l) - 1 AS ord, i / 20.0 AS w1, j / 20.0 AS w2, k / 20.0 AS w3, l / 20.0 AS w4, (20 - i - j - k - l) / 20.0 AS w5 FROM range(21) a(i), range(21) b(j), range(21) c(k), range(21) d(l) WHERE i + j + k + l <= 20),
    x AS (SELECT ord, floor(1000 * (w1 * a + w2 * b + w3 * c + w4 * d + w5 * e) + 0.5) AS s, y FROM k, g), {auroc_sql('x', 'ord', 's', 'y').replace('b AS (', 'bb AS (')}, r AS (SELECT ord, {AUROC} AS auroc FROM bb GROUP BY ord)
    SELECT {', '.join(f'CAST(w{i} AS DOUBLE) AS w{i}' for i in range(1, 6))}, round(auroc, 6) AS auroc FROM r JOIN g USING (ord) ORDER BY round(r.auroc, 6) DESC, round({FAR}, 9), ord LIMIT 1""")
def weight_grid_fine(spark, sf):
    rows = scored(spark, sf).select(*[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in CRITERIA.items()], "y")
    return six(rs.best_weights(rows, list(CRITERIA), step=0.05).drop("ord"))


@query(f"""WITH {SCORED_SQL}, k AS (SELECT s, sum(y) AS y, count(*) AS n, row_number() OVER (ORDER BY s) AS i FROM d GROUP BY s), c AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn FROM k),
    a AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean FROM c a JOIN c b ON b.i >= a.i), m AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM a)
    SELECT s, round(max(least), 6) AS calibrated FROM m JOIN k USING (i) GROUP BY s""")
def isotonic_map(spark, sf):
    """Calibrated scores at each distinct score; in SQL as the largest of the smallest means of stretches around it."""
    rows = scored(spark, sf).select("s", "y")
    return six(learn.apply_isotonic(learn.fit_isotonic(rows, "s"), rows.select("s").distinct(), "s"))


@query(f"WITH {SCORED_SQL} SELECT count(*) AS rows, true AS equal, min(doc_id) AS first_id, max(doc_id) AS last_id FROM d")
def stored_model(spark, sf):
    """Fit, save, load by the fingerprint of the training rows, predict again: as the predictions that were stored at first."""
    rows, at, features = scored(spark, sf).select("doc_id", "s", "t", F.col("p").alias("q"), "y"), scratch(spark), ["s", "t", "q"]
    marks = learn.fingerprint(rows, ["doc_id", *features, "y"])
    model = learn.fit_logistic(rows, features)
    learn.predict(model, rows).select("doc_id", "p").write.parquet(f"{at}/predictions")
    learn.save_model(model, f"{at}/scorer", features=features, trained_on=marks)
    again, about = learn.load_model(spark, f"{at}/scorer", learn.fingerprint(rows.repartition(3, "doc_id"), ["doc_id", *features, "y"]))
    found = learn.same_predictions(spark.read.parquet(f"{at}/predictions"), learn.predict(again, rows.select("doc_id", *about["features"])), "doc_id")
    return found.crossJoin(rows.agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")))  # one row each


@query()
def transfer_matrix(spark, sf):
    """AUROC of a model of each language's documents on each language's: tests/test_joint.py fits them one by one."""
    rows = scored(spark, sf).select(F.coalesce("lang", F.lit("none")).alias("lang"), "s", "t", F.col("p").alias("q"), "y")
    return six(learn.transfer(rows, ["s", "t", "q"], "lang", ["de", "en", "es", "fr"]))
