"""Scores of stories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-life and candidate cut of the feed over order dates, whose windows are stretched from hours to days.
HALF_LIFE_HOURS, CANDIDATES = 480.0, 150


def recency(age_hours: Column, half_life: float = HALF_LIFE_HOURS) -> Column:
    return F.pow(F.lit(0.5), age_hours / half_life)


def breadth(sources: Column) -> Column:
    return 0.35 + 0.65 * F.least(F.lit(1.0), F.log1p(sources) / F.log(F.lit(25.0)))


def interest(picked: list[str], home: str, inside: list[int]) -> Column:
    """0.8, 1 in a picked category, at least 0.95 at home, and 1.15 inside a picked place."""
    broad = F.greatest(F.when(F.col("category").isin(picked), 1.0).otherwise(0.8), F.when(F.col("country") == home, 0.95).otherwise(0.0))
    return F.when(F.col("place_id").isin(inside), 1.15).otherwise(broad)


def macro_lift(pattern: str) -> Column:
    """Up to a quarter more, by outlets, for stories that move markets."""
    return F.when(F.lower("topic").rlike(pattern), 1 + 0.25 * F.least(F.lit(1.0), F.col("source_count") / 6)).otherwise(1.0)


def desk_weight(desks: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col("category") == c, w) for c, w in desks.items()], F.lit(1.0))


def rank(picked: list[str], home: str, inside: list[int], macro: str, desks: dict[str, float]) -> Column:
    prominence = 1 + 0.5 * F.least(F.lit(1.0), F.col("prominence") / 2)
    return recency(F.col("age_hours")) * (0.5 + 0.1 * F.col("importance")) * interest(picked, home, inside) * prominence * macro_lift(macro) * desk_weight(desks)
