"""Intermediate tables in the storage that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session that names none gets a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessella-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: what follows depends on files, not on a long lineage."""
    path = f"{shared_folder(df.sparkSession)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
