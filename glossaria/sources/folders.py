"""Folders that all executors reach, and small marks in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder in local mode, and nowhere on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="glossaria-"))
        found = _own[0]
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where it is absent."""
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, made in one step: it is there or not, never half."""
    fs, at = _fs(spark, path)
    fs.create(at, False).close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)
