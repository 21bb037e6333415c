"""Pages over a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 10000


def page(df: DataFrame, order: list[str], limit: int = 1000, offset: int = 0,
         after: tuple | None = None) -> DataFrame:
    """Rows ``[offset, offset + limit)`` of ``df`` in ``order``, with ``total_count`` on each row.

    Planned as a distributed top-k: each task keeps offset + limit rows. To read far into a large
    table pass the last row's order values as ``after`` instead of an offset; each page then costs
    one filtered scan, however deep. The total is an uncorrelated scalar subquery; nothing is joined.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    total = df.agg(F.count("*")).scalar()
    if after is not None:
        last = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)])
        df = df.filter(F.struct(*order) > last)
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total_count", total)
