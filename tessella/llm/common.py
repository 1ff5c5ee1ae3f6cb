"""Helpers that every operator of the subpackage shares: shared storage, staging, words."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word definition: U+0020 and U+0009 to U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_local: list[str] = []
_runs: set[str] = set()


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests on one machine) gets a temporary folder; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tessella-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, path): storage as Spark itself sees it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before, below the folder of this application. That folder goes when the driver's
    JVM ends in order, or when ``release`` is called."""
    run = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}"
    if run not in _runs:
        fs, p = _path(spark, run)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _runs.add(run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this application has staged. Results that were not consumed before can't be read any more."""
    run = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}"
    remove(spark, run)
    _runs.discard(run)


#: Rows of a staged file at least, where it is known how many there can be.
FILE_ROWS = 100_000


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result depends on files only: a lost executor costs a reread, not a recomputation of the lineage. ``rows``: how many there can be at most, where that is
    known; a table of few rows is then written into few files, whatever the number of shuffle partitions.
    """
    spark = session_of(df)
    path = scratch(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Spark's own file system classes."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null. Built from JVM expressions only."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


#: Rows and bytes of an Arrow batch at most: texts can be very long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES``, if they are wider. They are read when a plan runs, after
    the operator has returned, so they stay; all operators ask for the same."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at its end the worker gives the memory that it has freed back to the machine: workers outlive their tasks, and what an
    allocator keeps would count against those that follow."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return each


def fresh(df: DataFrame, *wanted: str) -> str:
    """A column name for internal use that ``df`` does not have."""
    name = "_" + "_".join(wanted)
    while name in df.columns:
        name += "_"
    return name


def open_fs(uri: str):
    """(file system, path) of a URI for Python code on executors: ``file``, ``hdfs``, ``viewfs``, ``s3``, ``gs``."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def put_atomic(fs, tmp: str, final: str) -> None:
    """Move a finished temporary file to its final name; repeating it after a crash changes nothing."""
    from pyarrow.fs import FileType

    if fs.get_file_info(tmp).type == FileType.File:
        fs.move(tmp, final)
    elif fs.get_file_info(final).type != FileType.File:
        raise FileNotFoundError(f"neither {tmp} nor {final} is there")


#: Shards at most: their cut points, 17 bytes each, are held by the driver and sent to the executors.
MOST_SHARDS = 1 << 22
#: Tasks of a writer at most; beyond that a task writes several shards, one after the other.
MOST_TASKS = 20_000


class Cuts:
    """The first (key, tie) of each shard, in order, nulls first."""

    def __init__(self, cuts: list[tuple[int | None, int]]) -> None:
        self.nulls = np.array([t for k, t in cuts if k is None], np.int64)
        self.keys = np.array([k for k, _ in cuts if k is not None], np.int64)
        self.ties = np.array([t for k, t in cuts if k is not None], np.int64)

    def shards(self, keys: pa.Array, ties: pa.Array) -> np.ndarray:
        """The shard of each row: the last one that begins at it or before."""
        null = keys.is_null().to_numpy(zero_copy_only=False)
        k, t = keys.fill_null(0).to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False)
        high = np.searchsorted(self.keys, k, "right")
        out = len(self.nulls) + high - 1
        at_cut = ~null & (high > 0)
        at_cut[at_cut] = self.keys[high[at_cut] - 1] == k[at_cut]
        for i in np.flatnonzero(at_cut):
            low = int(np.searchsorted(self.keys, k[i]))
            out[i] = len(self.nulls) + low + int(np.searchsorted(self.ties[low : high[i]], t[i], "right")) - 1
        out[null] = np.searchsorted(self.nulls, t[null], "right") - 1
        return np.maximum(out, 0).astype(np.int32)


def range_cuts(rows: DataFrame, target: int) -> Cuts:
    """Cut points of shards of about ``target`` weight over ``rows`` (key long, tie long, weight long) in ascending order of key and tie.

    The rows are ranged and sorted, and their weights summed up to each: a shard begins with the first row that has a further multiple of
    ``target`` before it, so no shard exceeds ``target`` by more than its last row and the rows equal to it in key and tie. Sums are exact, so the
    same rows give the same cuts in any order. A hot key is cut by its ties; what is equal in both stays together. Nothing is
    computed with keys, so any longs will do. At most ``MOST_SHARDS`` cuts reach the driver.
    """
    order = [F.col("key").asc_nulls_first(), F.col("tie").asc()]
    ranged = staged(rows.select("key", "tie", "weight").repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("p").agg(F.sum("weight").alias("_w"))  # one row a partition
    before = F.coalesce(F.sum("_w").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.join(F.broadcast(sums.select("p", before.alias("_before"))), "p")
    upto = F.sum("weight").over(Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lots = ranged.select("key", "tie", F.floor((F.col("_before") + upto - F.col("weight")) / F.lit(target)).alias("lot"))
    row = F.struct(F.col("key").isNotNull().alias("some"), "key", "tie")
    cuts = lots.groupBy("lot").agg(F.min(row).alias("c")).select("c.*").distinct().limit(MOST_SHARDS + 1).collect()
    if len(cuts) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards; choose a larger size")
    return Cuts([(k if some else None, t) for some, k, t in sorted((c[0], c[1] or 0, c[2]) for c in cuts)])


def in_range_shards(rows: DataFrame, narrow: DataFrame, key: str, tie: str, target: int, *sort: str) -> DataFrame:
    """Deal ``rows`` into shards of ascending ``key`` and sort them in each by ``sort``; the column ``_shard`` tells the shard.

    ``narrow`` (key long, tie long, weight long) has a row for each of them, ``tie`` names their column with the same hash. One shuffle of the rows;
    a task gets one shard, or some in a row where there are more than ``MOST_TASKS``.
    """
    cuts = range_cuts(narrow, target)
    n = max(1, len(cuts.nulls) + len(cuts.keys))
    each = -(-n // MOST_TASKS)

    @F.arrow_udf("int")
    def shard_of(keys: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(cuts.shards(keys, ties))

    rows = rows.withColumn("_shard", shard_of(F.col(key).cast("long"), F.col(tie)))
    return rows.repartitionById(-(-n // each), F.floor(F.col("_shard") / each).cast("int")).sortWithinPartitions("_shard", key, *sort)
