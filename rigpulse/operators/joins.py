"""Joins between series, events and reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigpulse.functions.series import CHUNK, Series, beside

WINDOW_KEYS = ("asset_id", "mdm_object_name", "timestamp")


#: Levels of cells: one slot at the lowest, 2^39 slots at the highest, more than all times a timestamp can hold.
_LEVELS = 40


def _cover(low: Column, high: Column) -> Column:
    """The fewest aligned cells that make up the slots from ``low`` to ``high``: at most two (level, cell) a level."""
    def of_level(level: Column) -> Column:
        left = -F.call_function("shiftright", -low, level)
        right = F.call_function("shiftright", high + 1, level)
        first = F.when((left < right) & (left.bitwiseAND(F.lit(1)) == 1), left)
        last = F.when((left < right) & (right.bitwiseAND(F.lit(1)) == 1), right - 1)
        return F.array(*[F.struct(level.alias("level"), c.alias("cell")) for c in (first, last)])

    levels = F.sequence(F.lit(0), F.lit(_LEVELS - 1))
    return F.filter(F.flatten(F.transform(levels, of_level)), lambda c: c["cell"].isNotNull())


def attach_trips(tele: DataFrame, trips: DataFrame, key: str = "excavator_id", ts: str = "timestamp",
                 trip_key: str = "object_uuid", slot_seconds: int = 3600) -> DataFrame:
    """Trips that are under way at each reading (``start_time <= ts < end_time``); readings without one are kept.

    Both sides meet in time slots of the machine, so the join is an equi-join whatever the machine's size. A trip is
    covered by aligned cells of doubling length, a number that grows with the logarithm of its length, so an open end or
    a reading with a wrong clock costs nothing. Only the slots that hold readings look for trips, one cell a level.
    """
    def slot(c: str):
        return F.floor(F.unix_seconds(F.col(c)) / F.lit(slot_seconds)).cast("long")

    cells = (trips.where(F.col("end_time") > F.col("start_time")).withColumnRenamed(trip_key, "_object")
             .withColumn("_c", F.explode(_cover(slot("start_time"), slot("end_time"))))
             .select("*", F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell")).drop("_c"))
    in_use = cells.groupBy("_object").agg(F.collect_set("_level").alias("_levels"))
    probes = (tele.select(F.col(key).alias("_object"), slot(ts).alias("_slot")).where("_slot IS NOT NULL").distinct()
              .join(in_use, "_object").withColumn("_level", F.explode("_levels"))
              .withColumn("_cell", F.call_function("shiftright", F.col("_slot"), F.col("_level"))).drop("_levels"))
    spread = cells.join(probes, ["_object", "_level", "_cell"]).drop("_level", "_cell")
    rows = tele.withColumn("_at", slot(ts))
    on = ((F.col(key) == F.col("_object")) & (F.col("_at") == F.col("_slot"))
          & (F.col(ts) >= F.col("start_time")) & (F.col(ts) < F.col("end_time")))
    return rows.join(spread, on, "left").drop("_at", "_slot", "_object")


def attach_oil_exact(tele: DataFrame, oil: DataFrame, key: str = "excavator_id", ts: str = "timestamp",
                     oil_key: str = "CustomerId", oil_ts: str = "ReportedDate") -> DataFrame:
    """Laboratory results reported at exactly the time of a reading."""
    return tele.join(oil, (F.col(key) == F.col(oil_key)) & (F.col(ts) == F.col(oil_ts)), "left")


def attach_repairs(tele: DataFrame, repairs: DataFrame, key: str, repair_key: str) -> DataFrame:
    return tele.join(repairs, F.col(key) == F.col(repair_key), "left")


def merge_window_features(base: DataFrame, fuel: DataFrame, keys: Sequence[str] = WINDOW_KEYS) -> DataFrame:
    """Fuel features of the fuel bin that starts with the window."""
    return beside(base, fuel, keys, "left")


def next_event_asof(windows: DataFrame, events: DataFrame, by: Sequence[str] = ("asset_id",), ts: str = "timestamp",
                    event_ts: str = "event_dt", chunk_seconds: int = 7 * 86400) -> DataFrame:
    """The first event of the machine at or after each window.

    Inside a time chunk a range frame from the last row back finds it; else it is the first event of a later chunk, which
    travels through a table of one row per machine and chunk.
    """
    series = Series(tuple(by), ts, chunk_seconds=chunk_seconds)
    moments = series.chunked(events.where(F.col(event_ts).isNotNull())
                             .select(*by, F.col(event_ts).alias(ts)).distinct())
    rows = series.chunked(windows.where(F.col(ts).isNotNull()))
    chunks = rows.select(*series.chunk_keys).distinct().withColumn("_first", F.lit(None).cast("timestamp"))
    firsts = series.summary(moments, F.min(ts).alias("_first"))
    later = (chunks.unionByName(firsts).groupBy(*series.chunk_keys).agg(F.min("_first").alias("_first"))
             .select(*series.chunk_keys, F.min("_first").over(series.later_chunks).alias("_later")))
    both = rows.withColumn("_event", F.lit(None).cast("timestamp")).unionByName(
        moments.withColumn("_event", F.col(ts)), allowMissingColumns=True).withColumn("_us", F.unix_micros(ts))
    ahead = (Window.partitionBy(*series.chunk_keys).orderBy(F.col("_us").desc())
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_next", F.min("_event").over(ahead)).where(F.col("_event").isNull())
    return (beside(found, later, series.chunk_keys)
            .select(*windows.columns, F.coalesce("_next", "_later").alias(event_ts)))


def alert_rows(features: DataFrame, predictions: DataFrame, report: DataFrame) -> DataFrame:
    """The feature row of the first alert of every detected event; of several objects at that time the smallest name."""
    alerts = report.where("detected").select("asset_id", "event_dt", F.col("first_alert_ts").alias("timestamp"))
    named = (alerts.join(predictions.select("asset_id", "event_dt", "timestamp", "mdm_object_name"),
                         ["asset_id", "event_dt", "timestamp"])
             .groupBy("asset_id", "event_dt", "timestamp").agg(F.min("mdm_object_name").alias("mdm_object_name")))
    return features.join(named, list(WINDOW_KEYS))
