"""Positions on a dial, as hours modulo twelve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a position is written.
PATTERN = r"^(\d{1,2})(?::(\d{2})|(\.\d+))?$"


def hours(position: Column) -> Column:
    """Hours of "3", "3.8" or "4:30"; null for anything else or out of 1 to 12."""
    p = F.trim(position)
    get = lambda k: F.regexp_extract(p, PATTERN, k)
    hour = F.when(get(1) != "", get(1).cast("double"))
    part = F.when(get(2) != "", get(2).cast("double") / 60).when(get(3) != "", F.concat(F.lit("0"), get(3)).cast("double")).otherwise(0.0)
    return F.when((hour >= 1) & (hour <= 12) & (part < 1), F.pmod(hour + part, F.lit(12.0)))


def clock_gap(a: Column, b: Column) -> Column:
    """The shorter way round between two positions."""
    d = F.abs(a - b) % 12
    return F.least(d, 12 - d)
