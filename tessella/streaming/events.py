"""Event-time streams: windows, duplicates within the watermark, a stateful monitor of runs, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over event files; ``ts`` becomes a timestamp, for watermarks don't take timestamp_ntz."""
    schema = spark.read.parquet(path).schema
    # A single file is a folder of one for the file source.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    from tessella.sources.io import is_folder

    stream = stream.parquet(path) if is_folder(spark, path) else stream.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def batch_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of windows; the same expression serves stream and batch."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    w = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    w = e.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events that follow each other within ``gap``."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    w = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event once; a stream remembers ids as long as the watermark allows."""
    if events.isStreaming:
        return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


MONITOR = "user_id long, events long, best double, since_best long, stopped boolean"


def monitor(events: DataFrame, patience: int = 5) -> DataFrame:
    """A running monitor of each user's values: the best so far, events since, and whether ``patience`` of them have passed; once stopped, it stays so.

    State is five numbers a key, kept by Spark in the checkpoint, so a restart goes on where it was. Rows of a batch are taken in event order.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, best, since, stopped = state.get if state.exists else (0, float("-inf"), 0, False)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for v in rows["value"]:
            n, since = n + 1, since + 1
            if v > best:
                best, since = v, 0
            stopped = stopped or since >= patience
        state.update((n, best, since, stopped))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "best": [best], "since_best": [since], "stopped": [stopped]})

    return events.groupBy("user_id").applyInPandasWithState(update, MONITOR, "n long, best double, since long, stopped boolean", "update", "NoTimeout")


def monitor_batch(events: DataFrame, patience: int = 5) -> DataFrame:
    """The monitor's last state from a table, by window functions."""
    from tessella.operators.stats import flat_best

    rows = flat_best(events.select("user_id", "event_id", "value"), "user_id", "event_id", "value", patience)
    last = F.max_by(F.col("since_best"), F.col("event_id"))
    return rows.groupBy("user_id").agg(F.count("*").alias("events"), F.max("value").alias("best"), last.alias("since_best"), F.bool_or("stop").alias("stopped"))


def run_to_end(stream: DataFrame, mode: str, checkpoint: str, out: str) -> DataFrame:
    """Run a stream over all that is there now and read back what it wrote. Update-mode rows are appended batch by batch with their batch number;
    a batch that is repeated after a failure replaces its own folder."""
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/batch=*")
