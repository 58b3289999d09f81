"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def or_zero(column: str) -> Column:
    """0 for null, NaN and infinity; one expression string, as it is made for hundreds of columns."""
    return F.expr(f"if(abs(`{column}`) < double('infinity'), double(`{column}`), 0.0D)")


def sure(condition: Column) -> Column:
    """A comparison with null counts as false."""
    return F.coalesce(condition, F.lit(False))


def parse_ts(column: str | Column, fmt: str | None = None, strict: bool = False) -> Column:
    """Text to timestamp; bad text gives null, or fails when ``strict``."""
    c = col(column)
    args = [F.lit(fmt)] if fmt else []
    return (F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)) if strict else F.try_to_timestamp(c, *args)


def parse_time_of_day(column: str | Column, day: str = "2000-01-01") -> Column:
    """Time-of-day text on a fixed date; bad text gives null."""
    return F.try_to_timestamp(F.concat(F.lit(day + " "), col(column)), F.lit("yyyy-MM-dd HH:mm:ss"))


def to_naive(column: str | Column) -> Column:
    """Drop the time zone, keep the wall clock of the session zone."""
    return col(column).cast("timestamp_ntz")


def round_ts(column: str | Column, millis: int = 500) -> Column:
    """Round to a multiple of ``millis``, half to even."""
    step = millis * 1000
    micros = F.unix_micros(col(column).cast("timestamp"))
    rest = F.pmod(micros, F.lit(step))
    base = (micros - rest) / F.lit(step)
    whole = base.cast("long")
    up = (rest * 2 > step) | ((rest * 2 == step) & (whole % 2 != 0))
    return F.timestamp_micros((whole + F.when(up, 1).otherwise(0)) * F.lit(step))


def to_double(column: str | Column) -> Column:
    return col(column).try_cast("double")


def epoch_seconds(column: str | Column) -> Column:
    return F.unix_seconds(col(column).cast("timestamp"))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    micros = F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))
    return micros.cast("double") / F.lit(float(DAY_MICROS))


def safe_segment(column: str | Column) -> Column:
    """A value usable as one segment of a path."""
    return F.regexp_replace(col(column).cast("string"), "/", "_")


def motion_regime(speed: str | Column, idle_max: float, move_min: float) -> Column:
    s = col(speed)
    return F.when(s <= idle_max, "idle").when(s >= move_min, "move").otherwise("maneuver")


def work_regime(boom: str | Column, arm: str | Column) -> Column:
    b, a = F.abs(col(boom)), F.abs(col(arm))
    return (F.when((b < 1e-6) & (a < 1e-6), "no_tool_activity")
            .when(b + a > 0, "tool_activity").otherwise("unknown"))
