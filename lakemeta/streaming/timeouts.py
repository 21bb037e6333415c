"""Runs that never end: timed out by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.functions import fixed_values as fx

DEFAULT_TIMEOUT = 600


def stream_run_timeouts(starts: DataFrame, ends: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Started runs without an end within their ``timeout_seconds``, whatever its length.

    ``starts`` has run_id, started_at and timeout_seconds (null: the default, negative: an error), ``ends``
    run_id and ended_at. A run's start opens a session as long as its timeout, an end up to and including the
    deadline falls into it. A session without one comes out as soon as the watermark passes the
    deadline, and only open sessions are state. A run started again within its session counts as one.
    Each side has a watermark of its own, and the slower one counts: ends that run ahead make no start late.
    """
    seconds = F.coalesce(F.col("timeout_seconds"), F.lit(DEFAULT_TIMEOUT))
    seconds = F.when(seconds < 0, F.raise_error(F.lit("timeout_seconds must not be negative")).cast("int")).otherwise(seconds)
    started = starts.select("run_id", F.col("started_at").alias("at"), seconds.alias("timeout_seconds"))
    ended = ends.select("run_id", F.col("ended_at").alias("at"), F.lit(None).cast("int").alias("timeout_seconds"))
    # A session excludes its end; the extra microsecond takes the deadline in.
    gap = F.concat((F.coalesce("timeout_seconds", F.lit(0)).cast("bigint") * 1_000_000 + 1).cast("string"), F.lit(" microseconds"))
    both = started.withWatermark("at", delay).unionByName(ended.withWatermark("at", delay))
    sessions = (both.groupBy(F.session_window("at", gap), "run_id")
                .agg(F.min(F.when(F.col("timeout_seconds").isNotNull(), F.col("at"))).alias("started_at"),
                     F.max("timeout_seconds").alias("timeout_seconds"),
                     F.count_if(F.col("timeout_seconds").isNull()).alias("ends")))
    late = sessions.filter(F.col("started_at").isNotNull() & (F.col("ends") == 0))
    return late.select("run_id", "started_at", "timeout_seconds", F.lit(fx.TIMED_OUT).alias("status"),
                       F.concat(F.lit(fx.TIMEOUT_ERROR[0]), F.col("timeout_seconds").cast("string"),
                                F.lit(fx.TIMEOUT_ERROR[1])).alias("error"))
