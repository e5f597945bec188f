"""Snapshot differences for incremental stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of either snapshot that differ, with op insert, update or delete; one full outer join on the key, nulls equal to nulls."""
    values = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*values).alias("was"))
    b = new.select(*key, F.struct(*values).alias("is"))
    both = a.join(b, key, "full_outer")
    differs = reduce(lambda x, y: x | y, [~F.col(f"was.{c}").eqNullSafe(F.col(f"is.{c}")) for c in values], F.lit(False))
    op = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").when(differs, "update")
    return both.withColumn("op", op).where("op IS NOT NULL").select(*key, "op", "is.*")
