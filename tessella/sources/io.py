"""Readers and writers: JSON lines, CSV, text lists, Markdown tables, blobs, caches, partial results, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = True) -> DataFrame:
    """JSON lines with a stated schema: absent keys are null, nothing is inferred. A missing file is an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines, characters as they are, and return how many rows were written, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(path)
    return seen.get["rows"]


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header; all text; missing values and columns are empty strings."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids between white space, each once."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("id")).where("id <> ''").distinct()


def read_blobs(spark: SparkSession, path: str, magic: bytes | None = None) -> DataFrame:
    """(path, bytes, sha256, ok): size, digest and, if ``magic`` is given, whether the file begins with it."""
    files = spark.read.format("binaryFile").load(path)
    ok = F.lit(True) if magic is None else F.substring("content", 1, len(magic)) == F.lit(magic)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), ok.alias("ok"))


def first_write_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """An append-only cache in which the first line of a key counts."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def last_write_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a job that can be taken up again."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def newest(files: DataFrame, key: str, stamp: str, value: str, unwanted: Column) -> DataFrame:
    """The value of the newest file of each key, leaving out unwanted ones."""
    return files.where(~unwanted).groupBy(key).agg(F.max_by(value, stamp).alias(value), F.max(stamp).alias(stamp))


def parse_markdown(lines: DataFrame, order: str, line: str, key: int = 0) -> DataFrame:
    """(row, column, value) of a Markdown table given as ordered lines: the first is the header, rules are skipped."""
    cells = F.transform(F.slice(F.split(line, r"\|"), 2, F.greatest(F.size(F.split(line, r"\|")) - 2, F.lit(0))), lambda c: F.trim(c))
    rows = lines.where(F.trim(line).startswith("|")).select(order, cells.alias("cells"), F.trim(line).rlike(r"^\|[\s:|-]+\|$").alias("rule"))
    rows = rows.withColumn("header", F.first("cells").over(Window.partitionBy(F.lit(0)).orderBy(order)))
    body = rows.where("NOT rule").where(F.col("cells") != F.col("header"))
    return body.select(F.element_at("cells", key + 1).alias("row"), F.posexplode(F.arrays_zip("header", "cells")).alias("i", "c")).select("row", F.col("c.header").alias("column"), F.col("c.cells").alias("value"))


def render_markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``line`` for each row: a Markdown table's body, whole numbers with thousands separators."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.format_number(F.col(c), 0) if kinds[c] in ("int", "bigint") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))


def strip_text(rows: DataFrame, ident: str, fields: list[str], hide_id: bool = False) -> DataFrame:
    """A copy that may be published: fields blank, ids kept or given as digests."""
    out = rows.withColumns({f: F.lit("") for f in fields})
    return out.withColumn(ident, F.concat(F.lit("sha256:"), F.sha2(F.col(ident).cast("string"), 256))) if hide_id else out


def fill_text(stripped: DataFrame, source: DataFrame, ident: str, field: str) -> DataFrame:
    """The text joined again by id or by its digest: one equi-join on a list of both keys, not a join with OR."""
    keys = F.explode(F.array(F.col(ident).cast("string"), F.concat(F.lit("sha256:"), F.sha2(F.col(ident).cast("string"), 256))))
    src = source.select(keys.alias("_k"), F.col(field).alias("_t"))
    return stripped.join(src, F.col(ident).cast("string") == F.col("_k"), "left").withColumn(field, F.coalesce("_t", field)).drop("_k", "_t")


def manifest(df: DataFrame, *keys: str) -> DataFrame:
    """(rows, digest): a digest of all rows in any order: the digest of the sorted digests of blocks of row digests."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in keys or df.columns]), 256)
    blocks = df.select(row.alias("d")).groupBy(F.substring("d", 1, 2).alias("b")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("d", 3, 15), 16, 10).cast("decimal(38,0)")).alias("s"))
    return blocks.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "n", F.col("s").cast("string")))), ","), 256).alias("digest"))


def mismatched(found: DataFrame, frozen: DataFrame) -> DataFrame:
    """Names in a frozen list (name, sha256) whose file is missing or has another digest."""
    return frozen.join(found, ["name", "sha256"], "left_anti")


def guarded_append(table: DataFrame, row: DataFrame, tag: str) -> DataFrame:
    """The table with one more row; refused if the columns differ or the table's rows were scored on another item set."""
    if table.columns != row.columns:
        raise ValueError("the header differs")
    if not table.select(tag).distinct().join(row.select(tag), tag, "left_anti").isEmpty():
        raise ValueError("the table was scored on other items")
    return table.unionByName(row)


def replace_block(text: str, begin: str, end: str, body: str) -> str:
    """The text with what stands between two markers replaced; exactly one pair must be there."""
    if text.count(begin) != 1 or text.count(end) != 1 or text.index(begin) > text.index(end):
        raise ValueError("exactly one pair of markers is needed")
    head, _, rest = text.partition(begin)
    return f"{head}{begin}\n{body}\n{end}{rest.partition(end)[2]}"
