"""Pipeline configurations: JSON lists of steps, read on the driver. Of repeated keys the last wins."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def read_config(path: str, spark: SparkSession | None = None) -> list[dict]:
    """The steps of a file; with a session, of any file system that it knows."""
    if spark is None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    else:
        text = spark.read.text(path, wholetext=True).first()[0]
    steps = json.loads(text)
    if not isinstance(steps, list) or not all(isinstance(s, dict) for s in steps):
        raise ValueError("a configuration is a list of steps")
    return steps
