"""Committing files that tasks write: temporary names, a manifest, then the final names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_TASKS, exists, open_fs, put_atomic, remove, session_of, tidy

MANIFEST = "shard int, seq int, name string, tmp string, bytes long, sha256 string, records long, units long, first_id long, last_id long"

#: Files that a task gives their final names.
RENAMES = 256


def manifest_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in MANIFEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


class TempFile:
    """A file under a name no other attempt has; ``row`` describes it once it is closed."""

    def __init__(self, out_dir: str, shard: int, seq: int, ending: str) -> None:
        import hashlib

        self.fs, base = open_fs(out_dir)
        self.shard, self.seq, self.name = shard, seq, f"{shard:06d}-{seq:04d}{ending}"
        self.tmp = f"{base}/_tmp/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{base}/_tmp", recursive=True)
        self.out, self.bytes, self.digest = self.fs.open_output_stream(self.tmp, compression=None), 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def row(self, **more) -> dict:
        self.out.close()
        return {"shard": self.shard, "seq": self.seq, "name": self.name, "tmp": self.tmp, "bytes": self.bytes, "sha256": self.digest.hexdigest()} | more


class Checked:
    """Reads a file from its start to its end; on leaving, its length and digest must be those of the manifest."""

    def __init__(self, file, row: dict) -> None:
        import hashlib

        self.file, self.row, self.bytes, self.digest = file, row, 0, hashlib.sha256()

    def read(self, size: int = -1) -> bytes:
        data = self.file.read(None if size is None or size < 0 else size)
        self.bytes += len(data)
        self.digest.update(data)
        return data

    def __enter__(self) -> Checked:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and (self.bytes, self.digest.hexdigest()) != (self.row["bytes"], self.row["sha256"]):
            raise ValueError(f"{self.row['name']} is not the file of the manifest")


def commit(rows: DataFrame, out_dir: str) -> DataFrame:
    """Give the files that ``rows`` (the tasks' output) names their final names, and write the manifest.

    ``rows`` is brought together by shard into few files and written by Spark's own committer, which takes one attempt of each task; files of lost or
    repeated attempts are in no row and go with the temporary folder. An executor lost before that costs the shards that it had written. The renames
    run on the executors and may be repeated. The manifest is written last: a reader that finds it finds every file. A run into a folder that has a manifest, or the remains of a run that died, takes its place; where only
    the renames were left, ``resume`` ends that run instead. Returns the manifest.
    """
    spark = session_of(rows)
    remove(spark, f"{out_dir}/manifest")
    rows.repartition("shard").write.mode("overwrite").parquet(f"{out_dir}/_attempts")
    return resume(spark, out_dir)


def resume(spark: SparkSession, out_dir: str) -> DataFrame:
    """End a commit whose driver died after all tasks had written: renames that are left, the manifest, the temporary files."""
    if exists(spark, f"{out_dir}/manifest/_SUCCESS"):
        return manifest(spark, out_dir)
    if not exists(spark, f"{out_dir}/_attempts/_SUCCESS"):
        raise FileNotFoundError(f"{out_dir} holds no finished attempts; run the writer again")
    taken = spark.read.schema(MANIFEST).parquet(f"{out_dir}/_attempts")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out_dir)
        for b in batches:
            for tmp, name in zip(b.column("tmp").to_pylist(), b.column("name").to_pylist(), strict=True):
                put_atomic(fs, tmp, f"{base}/{name}")
            yield b

    taken = taken.repartition(min(MOST_TASKS, 1 + taken.count() // RENAMES))
    taken.mapInArrow(tidy(rename), MANIFEST).drop("tmp").write.mode("overwrite").parquet(f"{out_dir}/manifest")
    remove(spark, f"{out_dir}/_tmp")
    remove(spark, f"{out_dir}/_attempts")
    return manifest(spark, out_dir)


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The committed files in order, with ``before``: the units in all files before each. One row a file; sums go by lots of 1,024 shards."""
    rows = spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest").drop("tmp").withColumn("_lot", F.floor(F.col("shard") / 1024))
    earlier = lambda w: F.coalesce(F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = rows.groupBy("_lot").agg(F.sum("units").alias("units")).select("_lot", earlier(Window.orderBy("_lot")).alias("_before"))
    within = earlier(Window.partitionBy("_lot").orderBy("shard", "seq"))
    return rows.withColumn("before", within).join(lots, "_lot").withColumn("before", F.col("before") + F.col("_before")).drop("_lot", "_before")


def per_file(files: DataFrame, run, schema: str) -> DataFrame:
    """Run ``run(rows)`` on the executors, rows being dicts of the manifest, a file at a time."""
    spark = session_of(files)
    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism + files.count() // 16))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from run(row)

    return files.repartition(n).mapInArrow(tidy(each), schema)


def to_json(value) -> bytes:
    return json.dumps(value, separators=(",", ":"), sort_keys=True).encode()
