"""Helpers the text operators share: row keys, saved intermediates, Arrow buffers, word hashes."""

from __future__ import annotations

from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakemeta.session import run_dir

#: Words are maximal runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
_ROOT = str(Path(__file__).resolve().parents[2])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, unless it was shipped otherwise."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """DataFrames made in here drop their shuffle files when they have run, not when the driver's garbage is collected."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def saved(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back, so later jobs survive lost executors. Its shuffle files go."""
    path = run_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*columns) if columns else back


def discarded(*frames: DataFrame) -> None:
    """Empties folders that ``saved`` wrote, once everything that reads them is written itself."""
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            df.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(folder)


def text_key(id_: Column, text: Column) -> Column:
    """A 64-bit digest that, beside the id, tells rows apart; equal rows share it and get equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")), id_)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, text) of ``docs``; null texts become empty, other columns are left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(id_col), F.col(text_col)).alias("key"),
                       F.coalesce(text_col, F.lit("")).alias("text"))


def null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Joins on ``names``, nulls matching nulls; the right side's copies are dropped."""
    renamed = right.select([F.col(c).alias(f"r_{c}") if c in names else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(renamed[f"r_{c}"]) for c in names]
    joined = left.join(renamed, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"r_{c}" for c in names])


def row_and(df: DataFrame, more: str) -> StructType:
    """The schema of ``df.row`` followed by the columns of ``more``."""
    return StructType([df.schema["row"], *StructType.fromDDL(more).fields])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows, without copying; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def binary_column(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of ``parts`` (bytes); they must stay under 2 GB."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(parts))])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2^64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


BYTES, FIRST, SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xD1B54A32D192ED03), Powers(0xAEF17502108EF2D9)


class Rolling:
    """Hashes of any slice of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], dtype=np.uint64, out=self.sums[1:])

    def slices(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """The hash of every run of ``n`` values, by its start."""
        count = max(0, len(self.sums) - n)
        return self.slices(slice(0, count), slice(n, n + count))


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of ``data``; no word crosses the row starts given."""
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[starts[starts < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = starts[(starts > 0) & (starts <= len(data))]
    after[ends - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return Rolling(data.astype(np.uint64) + np.uint64(1), BYTES).slices(first, last)


def row_groups(offsets: np.ndarray, limit: int):
    """Consecutive row ranges of about ``limit`` bytes each; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` written in the order given, with ``place``, its row's number from 0.

    Rows are counted per range partition; only those counts, one per partition, meet in one task.
    """
    rows = saved(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    parts = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("rows"))
    before = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return (rows.withColumn("part", F.shiftright("at", 33)).join(before, "part")
            .withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "before"))


def running_total(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``amount`` over all rows that come earlier in the order given.

    As in ``numbered``, a window runs inside each range partition and over one row per partition.
    """
    rows = saved(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
                 .withColumn("part", F.shiftright("at", 33)), name)
    parts = rows.groupBy("part").agg(F.sum(amount).alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("earlier"))
    inside = F.sum(amount).over(Window.partitionBy("part").orderBy("at")) - F.col(amount)
    return (rows.withColumn("inside", inside).join(before, "part")
            .withColumn("before", F.col("earlier") + F.col("inside")).drop("at", "part", "inside", "earlier"))
