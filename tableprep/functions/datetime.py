"""Date parts of a timestamp column (weekday counts Monday as 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def datetime_parts(col: str) -> list[Column]:
    c = F.col(col)
    return [
        F.year(c).cast("bigint").alias(f"{col}_year"),
        F.month(c).cast("bigint").alias(f"{col}_month"),
        F.dayofmonth(c).cast("bigint").alias(f"{col}_day"),
        F.weekday(c).cast("bigint").alias(f"{col}_weekday"),
    ]
