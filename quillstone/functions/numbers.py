"""Rounding that matches half-up on binary doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Round half towards positive infinity; Spark's own round goes away from zero on decimals."""
    if not places:
        return F.floor(x + F.lit(0.5)).cast("double")
    scale = F.lit(float(10**places))
    return F.floor(x * scale + F.lit(0.5)) / scale


def or_else(x: Column, other: Column | float) -> Column:
    """``other`` where x is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(other) if isinstance(other, (int, float)) else other)
