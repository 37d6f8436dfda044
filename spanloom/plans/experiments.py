"""Experiment plumbing on the driver: configurations, their identity, grids, eligibility, manifests. Few and small by nature."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge(defaults: Mapping, given: Mapping) -> dict:
    """Defaults with a configuration over them, one level deep."""
    out = {k: dict(v) if isinstance(v, Mapping) else v for k, v in defaults.items()}
    for k, v in given.items():
        out[k] = {**out[k], **v} if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def identity(config: Mapping, length: int = 12) -> str:
    """The hash of a configuration's canonical JSON; key order and spacing don't matter."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:length]


def grid(**axes: Iterable) -> list[dict]:
    """All combinations, the last axis fastest."""
    names = list(axes)
    return [dict(zip(names, values, strict=True)) for values in product(*axes.values())]


def grid_frame(spark: SparkSession, **axes: Iterable) -> DataFrame:
    """The same as rows. The product's size is that of the axes the caller names."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out


def check_protocol(config: Mapping) -> None:
    """Raise ValueError where test data could leak: test splits only with frozen settings, pools from training or synthetic data."""
    if config.get("split") == "test" and not config.get("frozen"):
        raise ValueError("test runs need a frozen configuration")
    pools = set(config.get("pools", ()))
    if pools - {"train", "synthetic"}:
        raise ValueError(f"demonstrations come from training or synthetic data, not {sorted(pools - {'train', 'synthetic'})}")
    if "test" in config.get("kg_splits", ()):
        raise ValueError("the graph never holds test data")


def runnable(config: Mapping, done: Iterable[str], needs: Mapping[str, Iterable[str]]) -> bool:
    """Whether all that a run needs is there."""
    return set(needs.get(identity(config), ())) <= set(done)


def check_splits(pool: DataFrame, allowed: Iterable[str]) -> None:
    """Raise if a pool has rows of another split. One row at most is fetched."""
    bad = pool.where(~F.col("split").isin(*allowed)).limit(1).collect()
    if bad:
        raise ValueError(f"split {bad[0]['split']} may not be used here")


def one_runtime(runs: DataFrame) -> DataFrame:
    """model, runtimes of models that ran under more than one runtime fingerprint; none should."""
    return runs.groupBy("model").agg(F.countDistinct("runtime").alias("runtimes")).where("runtimes > 1")


def manifest(counts: Mapping[str, int], failures: int, total: int) -> dict:
    done = sum(counts.values())
    state = "partial" if done + failures < total else "complete_with_failures" if failures else "complete"
    return {"status": state, "completed": done, "failures": failures, "total": total, "counts": dict(sorted(counts.items()))}


def same_labels(found: Iterable[str], schema: Iterable[str]) -> list[str]:
    """What a model's labels and a schema don't share."""
    return sorted(set(found) ^ set(schema))
