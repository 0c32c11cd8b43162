"""Column functions whose null and calendar rules the operators rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(condition: Column) -> Column:
    """A comparison with missing data is false, not unknown."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return is_true(condition).cast("int")


def complete(*columns: Column) -> Column:
    """Whether none is null."""
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))


def strict_max(*columns: Column) -> Column:
    """Largest of the columns, null if any is null (greatest alone passes nulls over)."""
    return F.when(complete(*columns), F.greatest(*columns))


def at_least(column: Column, low: float) -> Column:
    """column, but no less than low; null stays null."""
    return F.when(column < low, F.lit(float(low))).otherwise(column)


def truncated(unit: str, ts: Column) -> Column:
    """date_trunc that keeps the zone-less type."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hours_before(ts: Column, hours: int | Column) -> Column:
    step = F.lit(hours) if isinstance(hours, int) else hours
    return ts - F.make_dt_interval(hours=step)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def cyclic(value: Column, period: int, name: str) -> list[Column]:
    angle = 2 * F.pi() * value / period
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def is_weekend(ts: Column) -> Column:
    return weekday(ts) >= 5


def is_work_start(ts: Column) -> Column:
    """Working days from 07:00 up to 09:59."""
    return (weekday(ts) < 5) & F.hour(ts).between(7, 9)


def production_state(now: Column, before: Column) -> Column:
    """startup, shutdown, running or idle, from production in this hour and the one before; missing counts as none."""
    on, was = is_true(now > 0), is_true(before > 0)
    return F.when(on & ~was, "startup").when(~on & was, "shutdown").when(on & was, "running").otherwise("idle")


def day_type(ts: Column) -> Column:
    return F.when(is_weekend(ts), "weekend").otherwise("weekday")


def lead_bucket(lead: Column) -> Column:
    return F.when(lead <= 6, "01-06").when(lead <= 12, "07-12").otherwise("13-24")


def six(column: Column | str) -> Column:
    """To six digits. The little that is added moves exact halves off the edge, on which engines round differently."""
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(1e-9), 6)
