"""From exported files to the tables the other plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigpulse.functions.columns import parse_time_of_day, parse_ts, to_naive
from rigpulse.functions.series import Series
from rigpulse.operators.impute import interpolate_linear
from rigpulse.operators.joins import attach_oil_exact, attach_repairs
from rigpulse.operators.resample import resample_means
from rigpulse.operators.shaping import (canonicalize, clean_frame, dedup_readings, drop_if_present, filter_component,
                                        map_values, oil_issues, prune_columns, strip_names)
from rigpulse.schemas import (EVENT_CASES, IDLE_NAMES, OIL_CASE, OIL_NAMES, OIL_UNIT_ASSETS, REPAIR_COLUMNS,
                              TRUCK_NAMES, TRUCK_UNUSED)
from rigpulse.session import materialize
from rigpulse.sources.readers import FILE, ORDER

EXCAVATOR_RAW_SENSORS = ["speed_gps", "direction", "inclinom_platx", "inclinom_platy", "inclinom_boomx", "inclinom_arm"]


def failure_events(idles: DataFrame) -> DataFrame:
    """Downtime log to events of the cases under study."""
    timed = clean_frame(idles).withColumn("GMTBEGINTIME", parse_ts("GMTBEGINTIME")).na.drop(subset=["GMTBEGINTIME"])
    cased = map_values(canonicalize(timed, IDLE_NAMES), "event_name", EVENT_CASES, "case")
    return cased.na.drop(subset=["case"]).select("asset_id", "mdm_object_name", "event_time", "case").distinct()


def oil_events(oil: DataFrame) -> DataFrame:
    """Laboratory log to events of bad engine oil, with the asset of the unit where known."""
    timed = clean_frame(oil).withColumn("TakenDate", parse_ts("TakenDate")).na.drop(subset=["TakenDate"])
    named = filter_component(canonicalize(timed, OIL_NAMES))
    issues = oil_issues(named).withColumn("case", F.lit(OIL_CASE)).select("mdm_object_name", "event_time", "case")
    return map_values(issues.distinct(), "mdm_object_name", OIL_UNIT_ASSETS, "asset_id")


def truck_telemetry(raw: DataFrame, scope: str = "file") -> DataFrame:
    """Raw readings of all files: names, unused columns, times, copies (inside a file, or overall)."""
    named = drop_if_present(canonicalize(strip_names(raw), TRUCK_NAMES), TRUCK_UNUSED)
    timed = named.withColumn("timestamp", parse_ts("timestamp")).na.drop(subset=["timestamp"])
    unique = dedup_readings(timed, ["asset_id", "timestamp"], [FILE, ORDER], [FILE] if scope == "file" else [])
    return clean_frame(materialize(unique.drop(FILE, ORDER)))


def engine_repairs(sheet: DataFrame) -> DataFrame:
    pruned = prune_columns(strip_names(sheet).na.drop("all"), constant=False)
    return pruned.select(*[F.col(f"`{c}`") for c in REPAIR_COLUMNS]).na.drop("any")


def barge_trips(sheet: DataFrame) -> DataFrame:
    return sheet.withColumn("BEGIN", parse_ts("BEGIN", strict=True)).withColumn("END", parse_time_of_day("END"))


def excavator_dataset(tele: DataFrame, oil: DataFrame | None = None, repairs: DataFrame | None = None) -> DataFrame:
    """Readings on a dense 5 second grid, gaps interpolated, laboratory and repair data attached."""
    grid = materialize(resample_means(tele, ["mdm_object_uuid"], "create_dt", 5, EXCAVATOR_RAW_SENSORS))
    smooth = interpolate_linear(grid, Series(("mdm_object_uuid",), "create_dt"), EXCAVATOR_RAW_SENSORS)
    result = smooth.withColumn("create_dt", to_naive("create_dt"))
    if oil is not None:
        result = attach_oil_exact(result, oil.withColumn("ReportedDate", to_naive("ReportedDate")),
                                  "mdm_object_uuid", "create_dt")
    if repairs is not None:
        result = attach_repairs(result, repairs, "mdm_object_uuid", f"`{REPAIR_COLUMNS[0]}`")
    return result


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
