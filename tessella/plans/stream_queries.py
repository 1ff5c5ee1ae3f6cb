"""Streaming queries over the events, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.storage import shared_folder
from tessella.streaming import events as ev

from .registry import query


def _path(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet"


def _run(stream, mode):
    base = f"{shared_folder(stream.sparkSession)}/tessella/stream-{uuid.uuid4().hex}"
    return ev.run_to_end(stream, mode, f"{base}/checkpoint", f"{base}/out")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """Hourly counts by a stream in complete mode, so that open windows are there too."""
    out = _run(ev.tumbling(ev.read_events(spark, _path(sf_dir))), "complete")
    last = out.agg(F.max("_batch")).first()[0]
    return out.where(F.col("_batch") == last).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    """Two-hour windows every hour."""
    out = _run(ev.sliding(ev.read_events(spark, _path(sf_dir))), "complete")
    last = out.agg(F.max("_batch")).first()[0]
    return out.where(F.col("_batch") == last).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT user_id, ts, sum((p IS NULL OR ts >= p + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def session_windows(spark, sf_dir):
    """Sessions with a gap of 30 minutes, in batch."""
    s = ev.sessions(ev.batch_events(spark, _path(sf_dir)))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_distinct(spark, sf_dir):
    """A stream that drops repeated events within the watermark."""
    out = _run(ev.distinct_events(ev.read_events(spark, _path(sf_dir))).select("event_id"), "append")
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query()
def stream_monitor(spark, sf_dir):
    """The stateful monitor's last state for each user (custom state; tested equal to its batch twin)."""
    out = _run(ev.monitor(ev.read_events(spark, _path(sf_dir)).select("user_id", "event_id", "value")), "update")
    row = F.max_by(F.struct("events", "best", "since_best", "stopped"), "_batch")
    return out.groupBy("user_id").agg(row.alias("r")).select("user_id", "r.*")
