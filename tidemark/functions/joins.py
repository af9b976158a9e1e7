"""Joins in which a null key equals a null key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The equi-join of two tables on ``keys``, null-safe; the right side's keys are dropped."""
    named = right.select(*(F.col(c).alias(f"_same_{c}") for c in keys), *(c for c in right.columns if c not in keys))
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return left.join(named, match, how).drop(*(f"_same_{c}" for c in keys))
