"""A keyed store in hash buckets: batches append to it, readers prune it, compaction shortens it.

``delta/batch_id=N/bucket=B`` holds the rows batch N wrote, ``base/version=V/bucket=B`` what a compaction made of a
bucket's rows, ``heads/version=V`` which buckets that compaction covers and up to which batch. A bucket is
read as its newest head's base and the deltas after it. A head is written last, in one file, so a running stream sees
a compaction whole or not at all, and a compaction that fails leaves nothing that is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemeta.streaming import batches

_HEADS = "bucket INT, upto BIGINT"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(spark: SparkSession, path: str, schema: str) -> None:
    """Makes the store readable before its first batch; does nothing to an existing one."""
    for name, more, parts in (("delta", "", ["batch_id", "bucket"]), ("base", ", batch_id BIGINT", ["version", "bucket"])):
        kinds = ", ".join(f"{c} {'INT' if c == 'bucket' else 'BIGINT'}" for c in parts)
        spark.createDataFrame([], f"{schema}{more}, {kinds}").write.mode("ignore").partitionBy(*parts).parquet(f"{path}/{name}")
    spark.createDataFrame([], f"{_HEADS}, version BIGINT").write.mode("ignore").partitionBy("version").parquet(f"{path}/heads")


def write(df: DataFrame, path: str, batch_id: int, keys: list[str], buckets: int) -> None:
    """Writes a batch's rows, one file a bucket; a retry overwrites just them."""
    dealt = df.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/delta/batch_id={batch_id}")


def touched(df: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The buckets of a batch: at most ``buckets`` numbers reach the driver."""
    return sorted(r.bucket for r in df.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect())


def _heads(spark: SparkSession, path: str) -> dict[int, tuple[int, int]]:
    rows = spark.read.schema(f"{_HEADS}, version BIGINT").parquet(f"{path}/heads")
    newest = rows.groupBy("bucket").agg(F.max(F.struct("version", "upto")).alias("head"))
    return {r.bucket: (r.head.version, r.head.upto) for r in newest.collect()}


def read(spark: SparkSession, path: str, schema: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Rows with the ``batch_id`` that wrote them. ``buckets`` and ``before`` are literals on partition columns, so other folders
    are not listed into the scan."""
    heads = {b: h for b, h in _heads(spark, path).items() if buckets is None or b in buckets}
    delta = spark.read.schema(f"{schema}, batch_id BIGINT, bucket INT").parquet(f"{path}/delta")
    if buckets is not None:
        delta = delta.filter(F.col("bucket").isin(buckets))
    if before is not None:
        delta = delta.filter(F.col("batch_id") < before)
    if heads:
        later = ~F.col("bucket").isin(list(heads))
        for upto in {h[1] for h in heads.values()}:
            later |= F.col("bucket").isin([b for b, h in heads.items() if h[1] == upto]) & (F.col("batch_id") > upto)
        delta = delta.filter(later)
    names = [*delta.columns[:-2], "batch_id"]
    if not heads:
        return delta.select(*names)
    base = spark.read.schema(f"{schema}, batch_id BIGINT, version BIGINT, bucket INT").parquet(f"{path}/base")
    chosen = F.lit(False)
    for version in {h[0] for h in heads.values()}:
        chosen |= (F.col("version") == version) & F.col("bucket").isin([b for b, h in heads.items() if h[0] == version])
    return base.filter(chosen).select(*names).unionByName(delta.select(*names))


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], upto: int, buckets: list[int],
            count: int) -> None:
    """Folds some of the ``count`` buckets, their rows of batches up to ``upto``, which must be committed, into a base.

    It may run beside the stream; other buckets keep the heads they have.
    """
    heads = _heads(spark, path)
    buckets = [b for b in buckets if b not in heads or heads[b][1] < upto]
    if not buckets:
        return
    version = max((h[0] for h in heads.values()), default=-1) + 1
    rows = read(spark, path, schema, before=upto + 1, buckets=buckets)
    last = batches.latest_rows(rows, keys).withColumn("bucket", bucket_of(keys, count))
    last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/version={version}")
    published = spark.createDataFrame([(b, upto) for b in buckets], _HEADS).coalesce(1)
    published.write.mode("overwrite").parquet(f"{path}/heads/version={version}")
