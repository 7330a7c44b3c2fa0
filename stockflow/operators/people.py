"""Technician and customer filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.enums import INACTIVE, ON_LEAVE


def tech_available(t: DataFrame) -> DataFrame:
    """active, not OnLeave, not Inactive."""
    return t.where(F.col("is_active") & ~F.col("status").isin(ON_LEAVE, INACTIVE))


def tech_candidates(t: DataFrame) -> DataFrame:
    """active and not OnLeave; capacity is *not* tested here (A5 does that)."""
    return t.where(F.col("is_active") & (F.col("status") != ON_LEAVE))


def tech_by_skill(t: DataFrame, level: int) -> DataFrame:
    """active technicians of one skill level."""
    return t.where(F.col("is_active") & (F.col("skill_level") == level))
