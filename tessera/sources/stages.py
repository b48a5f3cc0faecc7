"""Intermediate tables of multi-round searches, kept in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the folder in ``spark.checkpoint.dir``, deleted by release().

    Only where that setting is missing and the master is local, a temporary folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-rounds-")
        spark.conf.set("spark.checkpoint.dir", folder)
    _made.append(f"{folder}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to a new folder and read back, so later rounds start from files."""
    path = new_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict = {}
_shared: set[str] = set()


def keep(spark: SparkSession, key: tuple, make):
    """What make() gives: made once in a session for each key, and kept until release(), beyond any scope().

    It is made again if someone else has deleted what it stored.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept or not all(_exists(spark, path) for path in _kept[key][1]):
        before = len(_made)
        value = make()
        _kept[key] = value, _made[before:]
        _shared.update(_made[before:])
    return _kept[key][0]


@contextmanager
def scope(spark: SparkSession):
    """Tables stored inside are deleted at its end, also after a failure; read results before that. Scopes may nest.

    What keep() holds stays for later queries.
    """
    before = len(_made)
    try:
        yield
    finally:
        mine = [path for path in _made[before:] if path not in _shared]
        _made[before:] = [path for path in _made[before:] if path in _shared]
        for path in mine:
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this process has stored; DataFrames that read them end with it."""
    _kept.clear()
    _shared.clear()
    while _made:
        _delete(spark, _made.pop())


def _file(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, path: str) -> bool:
    files, path = _file(spark, path)
    return files.exists(path)


def _delete(spark: SparkSession, path: str) -> None:
    files, path = _file(spark, path)
    files.delete(path, True)
