"""First-N per group, exact under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Up to the N of this setting Catalyst itself trims each group before the shuffle.
_TRIMMED_BY_CATALYST = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 64


def cap_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """Keeps the first ``n`` rows of every group in ``order`` (a total order within the group).

    For a large ``n`` the group is first cut into salts, each trimmed to ``n`` on its own, so one
    group holding most rows never sorts in one task; the first ``n`` of the salts' first ``n`` are
    the group's first ``n``.
    """
    def trim(rows: DataFrame, partition: list) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")

    if n <= int(df.sparkSession.conf.get(_TRIMMED_BY_CATALYST)):
        return trim(df, keys)
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys] or keys), F.lit(_SALTS))
    salted = trim(df.withColumn("_salt", salt), [*keys, "_salt"]).drop("_salt")
    return trim(salted, keys)
