"""Missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigpulse.functions.quantiles import group_quantiles
from rigpulse.functions.series import ROW, Series, nearest_known, number_rows
from rigpulse.operators.stats import mode_min, null_profile_row


def fill_forward_backward(df: DataFrame, series: Series, columns: Sequence[str]) -> DataFrame:
    """Last known value of the machine, else its next one."""
    near = nearest_known(df, series, {c: F.col(c) for c in columns})
    filled = {c: F.coalesce(f"{c}_before", f"{c}_after") for c in columns}
    return near.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def interpolate_linear(df: DataFrame, series: Series, columns: Sequence[str]) -> DataFrame:
    """Straight line by row position between known values of one machine.

    Leading nulls stay, trailing ones take the last value.
    """
    numbered = number_rows(df, series)
    near = nearest_known(
        numbered, series, {c: F.when(F.col(c).isNotNull(), F.struct(F.col(ROW).alias("at"), F.col(c).alias("v")))
                           for c in columns})
    filled = {}
    for c in columns:
        before, after = F.col(f"{c}_before"), F.col(f"{c}_after")
        share = (F.col(ROW) - before["at"]) / (after["at"] - before["at"])
        filled[c] = (F.when(F.col(c).isNotNull() | after.isNull(), F.coalesce(F.col(c), before["v"]))
                     .otherwise(before["v"] + (after["v"] - before["v"]) * share))
    return near.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def medians_of(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Medians of whole columns, as one row on the driver."""
    row = group_quantiles(df, [], {c: (F.col(c), 0.5) for c in columns}).first()
    return {c: (row[c] if row else None) for c in columns}


def impute_with_flags(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """Median for null features, mode for a null label, and ``<column>_is_missing`` where a column had nulls."""
    watched = [*columns, *([label] if label else [])]
    nulls = null_profile_row(df, watched)
    holes = [c for c in columns if nulls[c] > 0]
    flagged = df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_is_missing") for c in holes])
    fills = {c: m for c, m in medians_of(df, holes).items() if m is not None} if holes else {}
    if label and nulls[label] > 0:
        fills[label] = mode_min(df, [], label).first()[label]
    missing = [c for c in holes if c not in fills]
    if missing:
        raise ValueError(f"no value to fill with in {missing}")
    return flagged.na.fill(fills) if fills else flagged


def impute_median(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Median for null features and label alike; a column without any value is an error when ``strict``."""
    nulls = null_profile_row(df, columns)
    holes = [c for c in columns if nulls[c] > 0]
    if not holes:
        return df
    medians = medians_of(df, holes)
    empty = [c for c in holes if medians[c] is None]
    if empty and strict:
        raise ValueError(f"columns without any value: {empty}")
    return df.na.fill({c: m for c, m in medians.items() if m is not None})


def fill_with_group_median(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    medians = group_quantiles(df, keys, {"_median": (F.col(column), 0.5)})
    return (df.join(medians, list(keys), "left")
            .withColumn(column, F.coalesce(column, "_median")).select(*df.columns))
