"""Enum codes and their names.

Fixed values that must equal the source application's codes, in natural order:

  work-order priority: 1 Low, 2 Normal, 3 High, 4 Critical
  work-order status:   0 Pending, 1 Assigned, 2 InProgress, 3 OnHold, 4 Completed, 5 Cancelled
  technician skill:    1 Junior, 2 Intermediate, 3 Senior, 4 Expert
  technician status:   0 Available, 1 Busy, 2 OnJob, 3 OnLeave, 4 Inactive
  ledger type:         Receipt, Issue, Reservation, Release, Adjustment, Return
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIORITY = {1: "Low", 2: "Normal", 3: "High", 4: "Critical"}
WO_STATUS = {0: "Pending", 1: "Assigned", 2: "InProgress", 3: "OnHold", 4: "Completed", 5: "Cancelled"}
SKILL = {1: "Junior", 2: "Intermediate", 3: "Senior", 4: "Expert"}
TECH_STATUS = {0: "Available", 1: "Busy", 2: "OnJob", 3: "OnLeave", 4: "Inactive"}
LEDGER_TYPES = ("Receipt", "Issue", "Reservation", "Release", "Adjustment", "Return")

PENDING, ASSIGNED, IN_PROGRESS, ON_HOLD, COMPLETED, CANCELLED = range(6)
AVAILABLE, BUSY, ON_JOB, ON_LEAVE, INACTIVE = range(5)
LOW, NORMAL, HIGH, CRITICAL = 1, 2, 3, 4

ENUMS = {"priority": PRIORITY, "status": WO_STATUS, "skill": SKILL, "technician_status": TECH_STATUS}


def decode_enum(c: Column | str, enum: str) -> Column:
    """Code -> name through a literal map (NULL for unknown codes)."""
    mapping = ENUMS[enum]
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    col = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(m, col.cast("int"))


def encode_enum(c: Column | str, enum: str) -> Column:
    """Name -> code (case-sensitive, as the names are stored)."""
    mapping = ENUMS[enum]
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(v), F.lit(k))])
    col = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(m, col)


def enum_case_sql(col: str, enum: str) -> str:
    """The same decode as a SQL CASE (for oracle texts)."""
    mapping = ENUMS[enum]
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} END"
