"""Columns and rows: names, projections, pruning, filters, de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from rigpulse.functions.columns import sure
from rigpulse.functions.series import Series, number_rows
from rigpulse.operators.quality import null_sentinels
from rigpulse.schemas import ENGINE_COMPONENT, NOT_FEATURES, OIL_CONDITIONS
from rigpulse.session import materialize


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")])


def canonicalize(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_if_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def column_profile(df: DataFrame) -> dict[str, tuple[int, bool]]:
    """For each column its non-null count and whether it holds at most one value; one pass, one row back."""
    parts = []
    for i, c in enumerate(df.columns):
        quoted = F.col(f"`{c}`")
        parts += [F.count(quoted).alias(f"n{i}"), F.min(quoted).eqNullSafe(F.max(quoted)).alias(f"s{i}")]
    row = df.agg(*parts).first()
    return {c: (row[f"n{i}"], row[f"s{i}"]) for i, c in enumerate(df.columns)}


def prune_columns(df: DataFrame, constant: bool = True) -> DataFrame:
    """Drop columns without values and, with ``constant``, those with a single value."""
    profile = column_profile(df)
    kept = [c for c, (n, single) in profile.items() if n > 0 and not (constant and single)]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def clean_frame(df: DataFrame) -> DataFrame:
    """Names stripped, sentinels nulled, empty rows and useless columns dropped.

    A row that holds nothing but a saved index is not empty: unnamed columns go only after the empty rows.
    """
    return drop_unnamed(prune_columns(null_sentinels(strip_names(df)).na.drop("all")))


def feature_columns(df: DataFrame, excluded: set[str] | None = None) -> list[str]:
    out = NOT_FEATURES if excluded is None else excluded
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in out]


def split_features(df: DataFrame, keys: Sequence[str] = ("asset_id", "mdm_object_name", "timestamp"),
                   target: str = "target", dropped: Sequence[str] = ("event_dt", "days_to_event")
                   ) -> tuple[DataFrame, DataFrame]:
    """Features and target, both with their keys."""
    return df.drop(target, *dropped), df.select(*keys, F.col(target).cast("int").alias(target))


def prediction_table(scored: DataFrame) -> DataFrame:
    return scored.select("asset_id", "mdm_object_name", "timestamp", "event_dt", "days_to_event", "target", "proba")


def map_values(df: DataFrame, column: str, mapping: Mapping, name: str) -> DataFrame:
    """Look ``column`` up in a fixed dictionary; null when absent."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(column)))


def filter_component(df: DataFrame, column: str = "ComponentTypeField", pattern: str = ENGINE_COMPONENT) -> DataFrame:
    """Case-insensitive, also for Cyrillic; null does not match. Without the column nothing is filtered."""
    return df.where(sure(F.col(column).rlike(f"(?iu){pattern}"))) if column in df.columns else df


def oil_issues(df: DataFrame, column: str = "Condition", values: Sequence[str] = tuple(OIL_CONDITIONS)) -> DataFrame:
    return df.where(sure(F.col(column).isin(*values)))


def dedup_readings(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   scope: Sequence[str] = ()) -> DataFrame:
    """Keep the first row by ``order`` of each key, inside ``scope`` (a file column, or the whole table).

    An aggregate rather than a window, so copies shrink before the shuffle.
    """
    group = [*scope, *keys]
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    kept = df.groupBy(*group).agg(first)
    return kept.select(*[F.col(c) if c in group else F.col(f"_first.{c}").alias(c) for c in df.columns])


def decimate(df: DataFrame, series: Series, n: int = 2) -> DataFrame:
    """Every ``n``-th row of each machine, from the first. Numbering reads the rows twice, so they are written once."""
    return number_rows(materialize(df), series).where(F.col("_row") % n == 0).drop("_row")
