"""Regular time grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigpulse.functions.series import beside
from rigpulse.schemas import EXCAVATOR_SENSORS

_SPAN = 4096


def bin_start(ts: str, seconds: int) -> Column:
    """Start of the left-closed bin, aligned to the epoch."""
    index = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(seconds)).cast("long")
    return F.timestamp_seconds(index * F.lit(seconds))


def time_spine(bins: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Every bin between the first and the last one of each group.

    Ranges are cut into spans first, so no row holds the whole range of a machine. The bins are shuffled by what they
    are joined on: a planner takes a row for a span until it has seen the bins, and would broadcast millions of them.
    """
    extent = bins.groupBy(*keys).agg(
        (F.unix_seconds(F.min(ts)) / seconds).cast("long").alias("_a"),
        (F.unix_seconds(F.max(ts)) / seconds).cast("long").alias("_b"),
    )
    def span(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(_SPAN)).cast("long")

    tasks = int(bins.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or few spans end in one task
    spans = extent.withColumn("_span", F.explode(F.sequence(span("_a"), span("_b")))).repartition(tasks, *keys, "_span")
    first = F.greatest(F.col("_a"), F.col("_span") * _SPAN)
    last = F.least(F.col("_b"), F.col("_span") * _SPAN + (_SPAN - 1))
    return spans.select(*keys, F.explode(F.sequence(first, last)).alias("_i")).select(
        *keys, F.timestamp_seconds(F.col("_i") * F.lit(seconds)).alias(ts)).repartition(*keys, ts)


def resample(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, aggregates: Sequence[Column],
             dense: bool = True) -> DataFrame:
    """Aggregate per bin; with ``dense`` the empty bins of a group are kept, as nulls."""
    binned = (df.where(F.col(ts).isNotNull()).withColumn("_bin", bin_start(ts, seconds))
              .groupBy(*keys, "_bin").agg(*aggregates).withColumnRenamed("_bin", ts))
    if not dense:
        return binned
    return beside(time_spine(binned, keys, ts, seconds), binned, [*keys, ts], "left")


def resample_means(df: DataFrame, keys: Sequence[str] = ("excavator_id",), ts: str = "timestamp", seconds: int = 5,
                   columns: Sequence[str] = tuple(EXCAVATOR_SENSORS), dense: bool = True) -> DataFrame:
    return resample(df, keys, ts, seconds, [F.avg(c).alias(c) for c in columns], dense)


TRUCK_KEYS = ("asset_id", "mdm_object_name")

# The aggregates of the window table.
WINDOW_OUTPUTS = {
    "rail_pressure_std": ("std", "rail_pressure"),
    "rail_pressure_min": ("min", "rail_pressure"),
    "rail_pressure_max": ("max", "rail_pressure"),
    "rail_pressure_target_mean": ("mean", "rail_pressure_target"),
    "rail_error_mean": ("mean", "rail_error"),
    "rail_error_std": ("std", "rail_error"),
    "rail_error_max": ("max", "rail_error"),
    "rail_diff_std": ("std", "rail_diff"),
    "rail_diff_max": ("max", "rail_diff"),
    "temp_engine_mean": ("mean", "temp_engine"),
    "temp_engine_max": ("max", "temp_engine"),
    "pres_coolant_nn_mean": ("mean", "pres_coolant_nn"),
}
_FUNCTIONS = {"std": F.stddev_samp, "min": F.min, "max": F.max, "mean": F.avg}


def window_aggregate(tele: DataFrame, seconds: int = 900, dense: bool = True) -> DataFrame:
    """Pressure, error and temperature per machine and bin."""
    return resample(tele, TRUCK_KEYS, "timestamp", seconds,
                    [_FUNCTIONS[fn](c).alias(name) for name, (fn, c) in WINDOW_OUTPUTS.items()], dense)


def steady_fuel_features(tele: DataFrame, seconds: int = 900, dense: bool = True) -> DataFrame:
    """Fuel rate of nearly standing machines under medium load, per bin."""
    steady = tele.where((F.col("vehicle_speed") < 1) & F.col("engine_load").between(20, 60))
    return resample(steady, TRUCK_KEYS, "timestamp", seconds,
                    [F.avg("fuel_rate").alias("fuel_rate_mean"), F.stddev_samp("fuel_rate").alias("fuel_rate_std")],
                    dense)


def fuel_drift(tele: DataFrame, seconds: int) -> DataFrame:
    """Slope of fuel over load in steady state, and of fuel over hours, per bin."""
    steady = tele.where((F.col("vehicle_speed") < 1) & F.col("engine_load").between(20, 60))
    hours = (F.unix_micros("timestamp") - F.unix_micros(bin_start("timestamp", seconds))) / F.lit(3.6e9)
    steady = steady.withColumn("_hours", hours)
    return resample(steady, TRUCK_KEYS, "timestamp", seconds, [
        F.regr_slope("fuel_rate", "engine_load").alias("fuel_per_load"),
        F.regr_slope("fuel_rate", "_hours").alias("fuel_per_hour"),
    ], dense=False)


def pressure_spectrum(tele: DataFrame, seconds: int, cycles: Sequence[int], column: str = "rail_pressure") -> DataFrame:
    """Amplitude of chosen frequencies, in cycles per bin, of the deviation of ``column`` from its bin mean.

    Sums of sines and cosines shrink on the map side, unlike a transform of collected samples.
    """
    offset = F.unix_micros("timestamp") - F.unix_micros(bin_start("timestamp", seconds))
    phase = offset / F.lit(seconds * 1e6) * F.lit(2.0) * F.pi()
    waves = tele.where(F.col(column).isNotNull()).withColumn("_phase", phase)
    sums = []
    for k in cycles:
        cosine, sine = F.cos(F.col("_phase") * k), F.sin(F.col("_phase") * k)
        sums += [F.sum(F.col(column) * cosine).alias(f"_xc{k}"), F.sum(F.col(column) * sine).alias(f"_xs{k}"),
                 F.sum(cosine).alias(f"_c{k}"), F.sum(sine).alias(f"_s{k}")]
    bins = resample(waves, TRUCK_KEYS, "timestamp", seconds,
                    [F.count(column).alias("n"), F.avg(column).alias("_mean"), *sums], dense=False)

    def amplitude(k: int) -> Column:
        real = F.col(f"_xc{k}") - F.col("_mean") * F.col(f"_c{k}")
        imaginary = F.col(f"_xs{k}") - F.col("_mean") * F.col(f"_s{k}")
        return (F.sqrt(real * real + imaginary * imaginary) * 2 / F.col("n")).alias(f"amplitude_{k}")

    return bins.select(*TRUCK_KEYS, "timestamp", "n", *[amplitude(k) for k in cycles])
