"""Targets and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigpulse.functions.columns import days_between, sure
from rigpulse.schemas import FUEL_CASE


def prepare_events(idles: DataFrame, case: str = FUEL_CASE) -> DataFrame:
    return idles.where(F.col("case") == case).withColumnRenamed("event_time", "event_dt")


def in_horizon(first: float, last: float, days: str = "days_to_event") -> Column:
    return sure(F.col(days).between(first, last))


def label_windows(df: DataFrame, empty_days: float = 7, target_days: float = 30) -> DataFrame:
    """Target 1 when the next event is ``empty_days`` to ``target_days`` ahead.

    Windows closer to their event are dropped; windows without an event stay, with target 0.
    """
    days = df.withColumn("days_to_event", days_between("event_dt", "timestamp"))
    close = sure((F.col("days_to_event") >= 0) & (F.col("days_to_event") < empty_days))
    return days.where(~close).withColumn("target", in_horizon(empty_days, target_days).cast("int"))


def label_horizons(df: DataFrame, horizons: Sequence[float] = (7, 14, 30)) -> DataFrame:
    """One label per horizon: an event within that many days."""
    days = df.withColumn("days_to_event", days_between("event_dt", "timestamp"))
    return days.select("*", *[in_horizon(0, h).cast("int").alias(f"event_within_{h:g}d") for h in horizons])


def time_split(df: DataFrame, until: str, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows before a date, and from that date on."""
    edge = F.lit(until).cast("timestamp")
    return df.where(F.col(ts) < edge), df.where(F.col(ts) >= edge)


def group_folds(df: DataFrame, key: str, folds: int, name: str = "fold") -> DataFrame:
    """The same fold for all rows of a machine."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn(name, (digest % folds).cast("int"))
