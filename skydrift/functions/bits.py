"""Event-class bit masks in the three ways they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_from_flags(flags: Column) -> Column:
    """Integer of an array of booleans, most significant bit first; null flags are unset."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, b: acc * 2 + F.when(b, F.lit(1)).otherwise(F.lit(0)))


def class_from_bytes(packed: Column) -> Column:
    """Integer of up to seven packed bytes, most significant first."""
    return F.conv(F.hex(packed), 16, 10).cast("long")


def any_bit(event_class: Column, bits: int) -> Column:
    """Whether any of the bits asked for is set; all rows pass where none is asked for."""
    if bits <= 0:
        return F.lit(True)
    return event_class.cast("long").bitwiseAND(F.lit(bits).cast("long")) > 0
