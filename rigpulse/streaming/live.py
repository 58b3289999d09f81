"""Live window aggregates and alerts with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rigpulse.operators.resample import TRUCK_KEYS
from rigpulse.session import shared_folder


def open_stream(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    """Files as they arrive in a folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", files).parquet(folder))


def live_windows(stream: DataFrame, window: str = "720 minutes", late: str = "1 hour",
                 keys: Sequence[str] = TRUCK_KEYS) -> DataFrame:
    """Window table of a stream; the state of a window goes once ``late`` has passed after its end."""
    error = F.col("rail_pressure") - F.col("rail_pressure_target")
    return (stream.withWatermark("timestamp", late)
            .groupBy(*keys, F.window("timestamp", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("rail_pressure").alias("rail_pressure_min"),
                 F.max("rail_pressure").alias("rail_pressure_max"), F.stddev_samp("rail_pressure").alias("rail_pressure_std"),
                 F.avg(error).alias("rail_error_mean"), F.max("temp_engine").alias("temp_engine_max"))
            .select(*keys, F.col("w.start").alias("timestamp"), "n", "rail_pressure_min", "rail_pressure_max",
                    "rail_pressure_std", "rail_error_mean", "temp_engine_max"))


def live_alerts(windows: DataFrame, limits: DataFrame, column: str = "rail_pressure_std",
                key: str = "asset_id") -> DataFrame:
    """Windows above the limit of their machine; ``limits`` is a table fitted on history."""
    return windows.join(limits, key).where(F.col(column) > F.col("limit"))


def drain(windows: DataFrame, keys: Sequence[str] = (*TRUCK_KEYS, "timestamp"), path: str | None = None) -> DataFrame:
    """Run a stream of windows over all that is there now and read each window's last state, also of windows still open.

    Each batch writes the windows it changed under its own number, so a repeated batch replaces itself. With the same
    ``path`` a later run goes on where this one ended.
    """
    spark = windows.sparkSession
    base = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    query = (windows.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", f"{base}/checkpoint").start())
    query.awaitTermination()
    schema = StructType([*windows.schema.fields]).add("batch", "long")
    states = spark.read.schema(schema).parquet(f"{base}/data")
    rest = [c for c in windows.columns if c not in keys]
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*[c if c in keys else F.col(f"_last.{c}").alias(c) for c in windows.columns])
