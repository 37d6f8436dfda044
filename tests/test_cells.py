import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators.cells import Cells, nearest_in_cells, visits


def made(spark, x, ids, name):
    return spark.createDataFrame([(int(i), int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], f"{name} long, pos long, v array<double>")


@pytest.mark.parametrize("block", [8192, 7])
def test_neighbours_by_trying_all(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 3
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 6)) * 0.1, np.zeros((3, 6)), np.tile(centres[:1], (5, 1))])
    q = np.concatenate([centres[rng.integers(0, 12, 20)] + rng.normal(size=(20, 6)) * 0.1, np.zeros((1, 6)), rng.normal(size=(4, 6))])
    pool, queries = made(spark, x, range(len(x)), "pid"), made(spark, q, range(len(q)), "qid").drop("pos")
    s = q @ x.T
    got = {}
    for r in nearest_in_cells(queries, pool, 4, block=block).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.pid, r.similarity))
    assert sorted(got) == list(range(len(q)))
    for i, found in got.items():
        assert len({p for p, _ in found}) == 4  # equal vectors may tie either way by the last bits of a sum
        assert [v for _, v in found] == pytest.approx(sorted(s[i], reverse=True)[:4]) == [s[i, p] for p, _ in found]
    if block == 8192:  # of clustered vectors a small share is compared
        cells = Cells(pool)
        least = spark.createDataFrame([(i, float(np.sort(s[i])[-4])) for i in range(len(q))], "qid long, least double")
        seen = [visits(queries.where("qid < 20"), cells, 4, *more).select("cell").toPandas()["cell"] for more in ((), (least,))]
        assert sum(cells.size[c] for v in seen for c in v) < 0.5 * 20 * len(x)


def test_few_and_no_vectors(spark):
    pool, queries = made(spark, [[1.0, 0.0]], [3], "pid"), made(spark, [[2.0, 1.0], [-1.0, 0.0]], [1, 2], "qid").drop("pos")
    assert sorted(map(tuple, nearest_in_cells(queries, pool, 5).collect())) == [(1, 3, 2.0, 1), (2, 3, -1.0, 1)]
    assert nearest_in_cells(queries, pool.limit(0), 5).collect() == []
    assert nearest_in_cells(queries.limit(0), pool, 5).collect() == []
    none = pool.union(spark.createDataFrame([(9, 9, None)], pool.schema))
    assert nearest_in_cells(queries.where(F.col("qid") == 1), none, 5).count() == 1
