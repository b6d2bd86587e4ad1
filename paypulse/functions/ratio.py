"""Ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent, rounded half up; NULL where ``whole`` is 0."""
    return F.round(part / F.nullif(whole, F.lit(0)) * 100, digits)
