"""Guards of the stock commands, once as a Python step and once as a SQL step. Names and order of the checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QTY_COMMANDS = ("receive", "reserve", "release", "issue")


def step(cmd: str, x, oh: int, rs: int):
    """One guarded command -> (reason or None, on_hand, reserved)."""
    if x is None:
        return "invalid_quantity", oh, rs
    if cmd == "adjust" or cmd == "adjust_by":
        target = x if cmd == "adjust" else oh + x
        if target < 0:
            return "negative_target", oh, rs
        if target < rs:
            return "target_below_reserved", oh, rs
        return None, target, rs
    if cmd not in QTY_COMMANDS:
        return "unknown_command", oh, rs
    if x <= 0:
        return "invalid_quantity", oh, rs
    if cmd == "receive":
        return None, oh + x, rs
    if cmd == "reserve":
        return ("insufficient_available", oh, rs) if x > oh - rs else (None, oh, rs + x)
    if cmd == "release":
        return ("insufficient_reserved", oh, rs) if x > rs else (None, oh, rs - x)
    # issue
    if x > rs:
        return "insufficient_reserved", oh, rs
    if x > oh:
        return "insufficient_on_hand", oh, rs
    return None, oh - x, rs - x


def reason(command: Column, quantity: Column, oh: Column, rs: Column) -> Column:
    """Why a stock command is rejected at (oh, rs); null when it is accepted."""
    target = F.when(command == "adjust", quantity).otherwise(oh + quantity)
    adjust = command.isin("adjust", "adjust_by")
    return (F.when(quantity.isNull(), F.lit("invalid_quantity"))
             .when(adjust & (target < 0), F.lit("negative_target"))
             .when(adjust & (target < rs), F.lit("target_below_reserved"))
             .when(adjust, F.lit(None).cast("string"))
             .when(~F.coalesce(command.isin(*QTY_COMMANDS), F.lit(False)), F.lit("unknown_command"))
             .when(quantity <= 0, F.lit("invalid_quantity"))
             .when((command == "reserve") & (quantity > oh - rs), F.lit("insufficient_available"))
             .when(command.isin("release", "issue") & (quantity > rs), F.lit("insufficient_reserved"))
             .when((command == "issue") & (quantity > oh), F.lit("insufficient_on_hand")))


def on_hand_after(command: Column, quantity: Column, oh: Column) -> Column:
    return (F.when(command == "adjust", quantity.cast("bigint")).when(command.isin("receive", "adjust_by"), oh + quantity)
             .when(command == "issue", oh - quantity).otherwise(oh))


def reserved_after(command: Column, quantity: Column, rs: Column) -> Column:
    return F.when(command == "reserve", rs + quantity).when(command.isin("release", "issue"), rs - quantity).otherwise(rs)
