"""Technical values: sentinels, impossible readings, infinities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from rigpulse.functions.columns import or_zero, sure
from rigpulse.schemas import INCLINOMETERS, SENTINEL


def null_sentinels(df: DataFrame, sentinel: float = SENTINEL) -> DataFrame:
    """Null instead of the sentinel in every numeric column."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, NumericType):
            c = F.when(c != F.lit(sentinel), c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def flag_technical_values(df: DataFrame) -> DataFrame:
    """Set ``flag_invalid`` and null the readings no sensor can mean.

    A missing heading is flagged as well; a missing speed or angle is not.
    """
    bad = {c: sure(F.col(c) == SENTINEL) for c in INCLINOMETERS if c in df.columns}
    if "heading_angle_deg" in df.columns:
        bad["heading_angle_deg"] = ~sure(F.col("heading_angle_deg").between(0, 360))
    if "gps_speed_kmh" in df.columns:
        bad["gps_speed_kmh"] = sure(F.col("gps_speed_kmh") < 0)
    flag = F.lit(False)
    for condition in bad.values():
        flag = flag | condition
    return df.select(
        *[F.when(~bad[c], F.col(c)).alias(c) if c in bad else F.col(f"`{c}`") for c in df.columns],
        flag.cast("int").alias("flag_invalid"),
    )


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, NaN and infinity become 0."""
    wanted = set(columns)
    return df.select(*[or_zero(c).alias(c) if c in wanted else F.col(f"`{c}`") for c in df.columns])
