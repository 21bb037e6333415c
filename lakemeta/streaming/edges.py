"""Lineage edges as they arrive: unique edges and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakemeta.model import EDGE_KEY
from lakemeta.operators.lineage import with_app_bucket
from lakemeta.streaming import batches

_EDGES = ", ".join(f"{c} STRING" for c in EDGE_KEY)


def dedup_edge_stream(stream: DataFrame, arrival: str | None = None, delay: str = "1 day") -> DataFrame:
    """Deduplicated edges as a stream.

    With an ``arrival`` time, duplicates within ``delay`` are dropped and older state is released.
    Without one the state keeps every edge ever seen; ``collect_edges`` keeps a table and counts beside it.
    """
    if arrival is None:
        return stream.dropDuplicates(EDGE_KEY)
    return stream.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(EDGE_KEY)


def collect_edges(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends edges never seen before to the table of unique edges, until the source is drained.

    What is known of past edges is the query's state: per edge its copies and the times of the first and the last
    batch that had it. A micro-batch shrinks to its distinct edges map-side — one edge on a third of the rows
    costs one row per task — and meets the state of just those edges; edges whose first batch is this
    one are new. No earlier output is read, so a batch costs the same however long the history. With the RocksDB
    provider (``session.RECOMMENDED_CONF``) the state lives on the executors' disks and only its changes are
    checkpointed. A retried batch finds the state as it was and overwrites its own folder.
    """
    batches.create(stream.sparkSession, f"{store}/edges", _EDGES)
    seen = stream.select(*EDGE_KEY, F.current_timestamp().alias("at")).groupBy(*EDGE_KEY).agg(
        F.count("*").alias("copies"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        batches.write(batch.filter("first_at = last_at").select(*EDGE_KEY), f"{store}/edges", batch_id)

    return (seen.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_edges(spark: SparkSession, store: str) -> DataFrame:
    return batches.read(spark, f"{store}/edges", _EDGES).select(*EDGE_KEY)


def read_edge_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every edge with its ``copies``, from the state of the last finished batch of ``collect_edges``."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value.count").alias("copies"))


def read_lineage_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Running unique edges per application and provider."""
    return with_app_bucket(read_edge_state(spark, checkpoint)).groupBy("app_bucket", "source_type").agg(
        F.count("*").alias("unique_edges"))


def read_raw_count(spark: SparkSession, checkpoint: str) -> DataFrame:
    return read_edge_state(spark, checkpoint).agg(
        F.coalesce(F.sum("copies"), F.lit(0).cast("bigint")).alias("total_raw"))
