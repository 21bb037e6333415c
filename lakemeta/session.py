"""Session helpers: recommended settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "lakemeta", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for materialised intermediates.

    ``spark.checkpoint.dir`` names it. Only where it is unset (tests, laptops) a local temporary
    folder is made and recorded in the session, so later calls and ``checkpoint()`` share it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="lakemeta-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder path of the shared folder; nothing is ever reused or overwritten."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings for plans made in here."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: Bytes of compressed files whose rows, or a few of their columns, one task takes.
_DEALT = 1 << 21
_UNKNOWN = 1 << 50
#: Shuffle files go when the plan that made them has run, not when the driver's garbage is collected.
_FILES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows that lie together by some of a join's keys are joined where they are.
_STAY = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def materialize(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    For a result several plans consume: they share the written columns instead of recomputing it,
    lineage is cut, and a lost executor costs no more than its running tasks. Nothing of it but the
    folder is left on disk. ``stay`` is for rows dealt by keys that every join and group of the plan
    has among its own, and that spread well: they are not dealt again.
    """
    path = run_dir(df.sparkSession, name)
    write_step(df, path, stay)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_step(df: DataFrame, path: str, stay: bool = False, mode: str = "errorifexists") -> None:
    """Writes ``df`` as ``materialize`` does."""
    with settings(df.sparkSession, _FILES_GO | (_STAY if stay else {})):
        df.select("*").write.mode(mode).option("compression", "zstd").parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Spark's estimate of the bytes of ``df``: of a table in files and its filters, those of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` dealt by ``keys`` to at least as many partitions as there are cores and to one for each ``_DEALT`` bytes of its
    files, so that what is grouped or joined by these keys and others finds its rows together. Rows that lie in no files,
    whose bytes nobody knows, go to the session's number of partitions."""
    spark, size = df.sparkSession, file_bytes(df)
    tasks = -(-size // _DEALT) if size < _UNKNOWN else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, tasks), *keys)
