"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Mapping
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession


def read_settings(kind: type, body: Mapping | None = None):
    """Settings of this dataclass; a name that it doesn't have is an error, so a misspelt one isn't ignored."""
    body = dict(body or {})
    if unknown := sorted(set(body) - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**body)


def from_file(spark: SparkSession, path: str, kind: type):
    """Settings from a JSON file, which Spark reads, so it may lie anywhere."""
    return read_settings(kind, json.loads(spark.read.text(path, wholetext=True).first()[0]))


def arguments(about: str, module: str, paths: Mapping[str, str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog=f"python -m {module}", description=about)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", default=str(Path(__file__).parent / f"{module.rsplit('.', 1)[-1]}.json"), help="settings as JSON")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()


def session(name: str) -> SparkSession:
    """A session of the cluster that spark-submit names; the command lines alone make and stop one."""
    return SparkSession.builder.appName(name).getOrCreate()
