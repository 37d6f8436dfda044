import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import resampling as rs
from spanloom.plans import catalogue, joint


def test_weight_vectors(spark):
    for step, k in ((0.25, 5), (0.5, 2), (0.2, 3)):
        want = [tuple(r)[1:] for r in rs.simplex(spark, step, k).orderBy("ord").collect()]
        assert np.allclose(rs.weight_vectors(step, k), want)
    assert rs.weight_vectors(0.05, 5).shape == (10_626, 5)


def test_best_weights_by_trying_all(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((90, 3)), rng.integers(0, 2, 90)
    x[:, 1] = (x[:, 1] + y) / 2
    rows = [(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 0.1, 0.2, 1), (0.1, float("nan"), 0.2, 1), (0.1, 0.2, 0.3, None)]
    got = rs.best_weights(spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(3), ["a", "b", "c"], step=0.1).first()

    def area(s):
        pos, neg = s[y == 1][:, None], s[y == 0][None, :]
        return ((pos > neg) + (pos == neg) / 2).mean()

    best = max((round(area(np.floor(1000 * (x @ w) + 0.5)), 6), -round(np.abs(w - 1 / 3).sum(), 9), -i) for i, w in enumerate(rs.weight_vectors(0.1, 3)))
    assert (round(got.auroc, 6), got.ord) == (best[0], -best[2])


def test_joint_bootstrap_draws_once(spark):
    """Every statistic by its own definition on the rows that a replicate draws."""
    rng = np.random.default_rng(7)
    rows = [(f"u{i % 9}", float(rng.random()), int(rng.integers(0, 2)), int(rng.integers(0, 3))) for i in range(80)]
    df = spark.createDataFrame(rows, "u string, s double, y int, v int")
    universe = spark.createDataFrame([(f"u{i}",) for i in range(11)], "u string")
    got = {r.statistic: r for r in rs.joint_bootstrap(df, "u", {"v": F.col("v"), "n": F.lit(1)}, {"mean": F.try_divide(F.col("v"), F.col("n")), "area": F.col("area") - 0.5}, areas={"area": (F.lit(True), "s")}, universe=universe, reps=25).collect()}
    w = {}
    for r in rs.multiplicities(universe, "u", 25).collect():
        w.setdefault(r.rep, {})[r.u] = r.w
    mean, areas = [], []
    for rep in range(25):
        drawn = [r for r in rows for _ in range(w[rep].get(r[0], 0))]
        mean.append(sum(r[3] for r in drawn) / len(drawn))
        pairs = [(p[1], q[1]) for p, q in itertools.product(drawn, drawn) if p[2] == 1 and q[2] == 0]
        areas.append(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) - 0.5)
    for name, values in (("mean", mean), ("area", areas)):
        r = got[name]
        assert r.replicates == 25 and (r.low, r.high) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))
        assert r.p == pytest.approx(min(1, 2 * min(np.mean(np.array(values) <= 0), np.mean(np.array(values) >= 0))))
    assert got["mean"].value == pytest.approx(sum(r[3] for r in rows) / len(rows))


def test_models_are_loaded_by_what_they_were_trained_on(spark, tmp_path):
    from spanloom.operators import learn

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal()), int(rng.integers(0, 2)), "ab"[i % 2]) for i in range(120)], "id long, a double, b double, y int, k string")
    model, marks = learn.fit_logistic(df, ["a", "b"]), learn.fingerprint(df, ["id", "a", "b", "y"])
    assert marks == learn.fingerprint(df.repartition(7), ["id", "a", "b", "y"]) != learn.fingerprint(df.where("id > 0"), ["id", "a", "b", "y"])
    learn.save_model(model, str(tmp_path / "m"), features=["a", "b"], trained_on=marks, name="x")
    again, about = learn.load_model(spark, str(tmp_path / "m"), marks)
    assert about == {"features": ["a", "b"], "trained_on": marks, "name": "x"}
    assert learn.same_predictions(learn.predict(model, df), learn.predict(again, df), "id").first().asDict() == {"rows": 120, "equal": True}
    with pytest.raises(ValueError, match="trained on"):
        learn.load_model(spark, str(tmp_path / "m"), learn.fingerprint(df.where("id > 0"), ["id", "a", "b", "y"]))
    # a transfer cell is the AUROC of one source's model on another's rows
    cells = {(r.train, r.test): r.auroc for r in learn.transfer(df, ["a", "b"], "k", ["a", "b"]).collect()}
    scores = learn.predict(learn.fit_logistic(df.where("k = 'a'"), ["a", "b"]), df.where("k = 'b'")).collect()
    pairs = [(p.p, q.p) for p, q in itertools.product(scores, scores) if p.y == 1 and q.y == 0]
    assert cells["a", "b"] == pytest.approx(sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs)) and len(cells) == 4


def test_isotonic_map_of_hand_cases(spark):
    from spanloom.operators import learn

    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 1), (4.0, 0), (5.0, 1)], "s double, y int")
    got = {r.s: r.calibrated for r in learn.apply_isotonic(learn.fit_isotonic(df, "s"), df.select("s").distinct(), "s").collect()}
    assert got == pytest.approx({1.0: 0.6, 2.0: 0.6, 3.0: 0.6, 4.0: 0.6, 5.0: 1.0})


def test_best_weights_tell_close_scores_apart(spark):
    """Scores that differ in the sixth digit: rounded to three they would all be ties, and the sums of most vectors too."""
    rows = [(0.5 + i * 1e-6, 0.5 - i * 1e-6, 0.5, i % 3 // 2 if i < 30 else 1) for i in range(60)]
    got = rs.best_weights(spark.createDataFrame(rows, "a double, b double, c double, y int"), ["a", "b", "c"], digits=10).first()
    pos, neg = [r for r in rows if r[3]], [r for r in rows if not r[3]]

    def area(w):
        s = {r: round(sum(x * y for x, y in zip(w, r, strict=False)), 10) for r in rows}
        return round(sum((s[p] > s[n]) + (s[p] == s[n]) / 2 for p in pos for n in neg) / (len(pos) * len(neg)), 6)

    grid = [(i / 4, j / 4, (4 - i - j) / 4) for i in range(5) for j in range(5 - i)]
    best = max(range(len(grid)), key=lambda k: (area(grid[k]), -round(sum(abs(x - 1 / 3) for x in grid[k]), 9), -k))
    assert (got.ord, round(got.auroc, 6)) == (best, area(grid[best]))
    assert got.auroc > 0.6


def best_by_trying_all(x, y, weights):
    """ord and AUROC at six digits: scores of ten digits of every row under every vector; a row takes no part where its score is not a number."""
    found = []
    for i, w in enumerate(weights):
        with np.errstate(invalid="ignore"):
            s = np.floor(sum(a * b for a, b in zip(w, x.T, strict=True)) * 1e10 + 0.5)
        pos, neg = s[(y == 1) & ~np.isnan(s)][:, None], s[(y == 0) & ~np.isnan(s)][None, :]
        found.append((round(float(((pos > neg) + (pos == neg) / 2).mean()), 6), -round(np.abs(w - 1 / len(w)).sum(), 9), -i))
    return -max(found)[2], max(found)[0]


def test_weight_grid_tries_all_vectors(spark, sf):
    """It tried 15 vectors of three criteria; all are the 10,626 vectors of five at steps of 0.05."""
    rows = catalogue.scored(spark, sf).select(*[F.expr(f"CAST({e} AS DOUBLE)") for e in joint.CRITERIA.values()], "y").collect()
    x, y = np.array([r[:5] for r in rows]), np.array([r.y for r in rows])
    weights = rs.weight_vectors(0.05, 5)
    order, area = best_by_trying_all(x, y, weights)
    got = catalogue.weight_grid(spark, sf).first()
    assert (got.ord, got.auroc) == (order, area)
    assert [got[f"w{i}"] for i in range(1, 6)] == pytest.approx(list(weights[order]))


@pytest.mark.parametrize("kind", ["any", "few values", "parted", "infinite", "one class"])
def test_best_weights_by_bounds(spark, monkeypatch, kind):
    """Few counts at a time, so bounds are coarse at first and vectors are left for all rounds; the best one is that of trying all."""
    rng = np.random.default_rng(11)
    x, y = rng.random((240, 3)), rng.integers(0, 2, 240)
    x[:, 1] = (x[:, 1] + 0.3 * y) / 1.3
    if kind == "few values":
        x = np.round(x * 4) / 4
    if kind == "parted":  # most vectors tie at an AUROC of 1
        x[:, 0] = (x[:, 0] + 20 * y) / 21
    if kind == "infinite":
        x[:9, 0], x[9:14, 2] = np.inf, -np.inf
    if kind == "one class":
        y[:] = 1
    x, y = np.concatenate([x, x[:20]]), np.concatenate([y, y[:20]])
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 0.1, 0.2, 1), (0.1, float("nan"), 0.2, 0), (0.1, 0.2, 0.3, None)], "a double, b double, c double, y int").repartition(3)
    rounds, bounds, exact = [], rs.grid_bounds, rs.exact_areas
    monkeypatch.setattr(rs, "_CELLS", 1 << 12)
    monkeypatch.setattr(rs, "_ROWS", 1 << 12)
    monkeypatch.setattr(rs, "grid_bounds", lambda rows, ends, w, digits, bins: rounds.append(len(w)) or bounds(rows, ends, w, digits, bins))
    monkeypatch.setattr(rs, "exact_areas", lambda rows, w, digits: rounds.append(-len(w)) or exact(rows, w, digits))
    got = rs.best_weights(df, ["a", "b", "c"], step=0.05, digits=10).first()
    many = max(16, (1 << 12) // len(np.unique(np.column_stack([x, y]), axis=0)))
    assert rounds[0] == 231 and all(n >= -many for n in rounds)
    if kind == "one class":
        assert got.ord is None and got.auroc is None
    else:
        assert (got.ord, round(got.auroc, 6)) == best_by_trying_all(x, y, rs.weight_vectors(0.05, 3))
    if kind == "parted":
        assert rounds[-1] >= -16 and sum(n < 0 for n in rounds) == 1
