"""The test tables seen as machine telemetry, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigpulse.config import EpisodeConfig
from rigpulse.operators.joins import next_event_asof
from rigpulse.operators.labels import label_windows
from rigpulse.operators.resample import TRUCK_KEYS, resample
from rigpulse.schemas import EXCAVATOR_SENSORS

# Windows and gates that fit the sampling of the test tables (one step of 60 s).
CFG = EpisodeConfig(win_seconds=(240, 480, 900), min_regime_rows=100, min_healthy_rows=200, score_quantile=0.95,
                    trees=100)
WIDTHS = {240: 4, 480: 8, 900: 15}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("double")))


def trucks(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, d).select(
        "event_id", F.col("user_id").alias("asset_id"), F.col("user_id").alias("mdm_object_name"),
        F.col("ts").alias("timestamp"), F.col("value").alias("rail_pressure"), F.col("k").alias("rail_pressure_target"),
        (F.col("value") / 10).alias("fuel_rate"), F.col("k").alias("engine_load"),
        ((e % 5) * F.lit(0.5)).alias("vehicle_speed"), (F.lit(60.0) + F.col("k") / 5).alias("temp_engine"),
        (F.col("value") / 100).alias("pres_coolant_nn"), "event_type")


TELE = """tele AS (
  SELECT event_id, user_id AS asset_id, user_id AS mdm_object_name, ts AS "timestamp", value AS rail_pressure,
    k AS rail_pressure_target, value / 10 AS fuel_rate, k AS engine_load,
    (event_id % 5) * CAST(0.5 AS DOUBLE) AS vehicle_speed, 60 + k / 5 AS temp_engine, value / 100 AS pres_coolant_nn,
    event_type
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""


def failures(tele: DataFrame) -> DataFrame:
    return tele.where((F.col("event_type") == "error") & (F.col("engine_load") >= 80)).select(
        "asset_id", F.col("timestamp").alias("event_dt"))


FAIL = """fail AS (
  SELECT asset_id, "timestamp" AS event_dt FROM tele WHERE event_type = 'error' AND engine_load >= 80)"""

RAIL = """rail AS (
  SELECT *, rail_pressure - rail_pressure_target AS rail_error,
    rail_pressure - lag(rail_pressure) OVER (PARTITION BY asset_id, mdm_object_name ORDER BY "timestamp", event_id)
      AS rail_diff
  FROM tele)"""


def sql_bin(column: str, seconds: int) -> str:
    return f"make_timestamp((epoch_us({column}) // {seconds * 1_000_000}) * {seconds * 1_000_000})"


def excavators(spark: SparkSession, d: str, machine: str = "user_id") -> DataFrame:
    e = F.col("event_id")
    return events(spark, d).select(
        "event_id", F.expr(machine).cast("string").alias("excavator_id"), F.col("ts").alias("timestamp"),
        F.when(e % 41 == 0, F.lit(-1.0)).otherwise((e % 5) * F.lit(0.5)).alias("gps_speed_kmh"),
        F.when(e % 43 != 0, ((e * 37) % 401).cast("double")).alias("heading_angle_deg"),
        F.when(e % 50 == 0, F.lit(-1e6)).otherwise(F.col("k") - 50).alias("platform_inclination_x_deg"),
        (F.col("value") / 10).alias("platform_inclination_y_deg"),
        F.when(e % 3 == 0, F.lit(0.0)).otherwise(F.col("k")).alias("boom_inclination_x_deg"),
        F.when(e % 53 == 0, F.lit(-1e6)).when(e % 3 == 0, F.lit(0.0)).otherwise(F.col("k")).alias("arm_inclination_deg"))


def exc_sql(machine: str = "user_id") -> str:
    return f"""exc AS (
  SELECT event_id, CAST({machine} AS VARCHAR) AS excavator_id, ts AS "timestamp",
    CASE WHEN event_id % 41 = 0 THEN CAST(-1 AS DOUBLE) ELSE (event_id % 5) * CAST(0.5 AS DOUBLE) END AS gps_speed_kmh,
    CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST((event_id * 37) % 401 AS DOUBLE) END AS heading_angle_deg,
    CASE WHEN event_id % 50 = 0 THEN CAST(-1000000 AS DOUBLE) ELSE k - 50 END AS platform_inclination_x_deg,
    value / 10 AS platform_inclination_y_deg,
    CASE WHEN event_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE k END AS boom_inclination_x_deg,
    CASE WHEN event_id % 53 = 0 THEN CAST(-1000000 AS DOUBLE) WHEN event_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE k END
      AS arm_inclination_deg
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""


S = EXCAVATOR_SENSORS
_ANGLES = S[2:]

FLAGGED = f"""flagged AS (
  SELECT event_id, excavator_id, "timestamp",
    CASE WHEN gps_speed_kmh >= 0 THEN gps_speed_kmh END AS gps_speed_kmh,
    CASE WHEN heading_angle_deg BETWEEN 0 AND 360 THEN heading_angle_deg END AS heading_angle_deg,
    {", ".join(f"CASE WHEN {c} <> -1000000 THEN {c} END AS {c}" for c in _ANGLES)},
    CASE WHEN {" OR ".join(f"coalesce({c} = -1000000, false)" for c in _ANGLES)}
      OR NOT coalesce(heading_angle_deg BETWEEN 0 AND 360, false) OR coalesce(gps_speed_kmh < 0, false)
      THEN 1 ELSE 0 END AS flag_invalid
  FROM exc)"""

# first reading of each moment, gaps filled forward, then backward
CLEAN = f"""uniq AS (
  SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY excavator_id, "timestamp" ORDER BY event_id) = 1),
clean AS (
  SELECT event_id, excavator_id, "timestamp", flag_invalid,
    {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a) AS {c}" for c in S)}
  FROM uniq
  WINDOW b AS (PARTITION BY excavator_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY excavator_id ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

REGIMES = """reg AS (
  SELECT *, regime_motion || '__' || regime_work AS regime FROM (
    SELECT *,
      CASE WHEN gps_speed_kmh <= CAST(0.3 AS DOUBLE) THEN 'idle' WHEN gps_speed_kmh >= 1 THEN 'move' ELSE 'maneuver' END
        AS regime_motion,
      CASE WHEN abs(boom_inclination_x_deg) < 1e-6 AND abs(arm_inclination_deg) < 1e-6 THEN 'no_tool_activity'
        WHEN abs(boom_inclination_x_deg) + abs(arm_inclination_deg) > 0 THEN 'tool_activity' ELSE 'unknown' END
        AS regime_work
    FROM clean))"""


def healthy_sql(days: int, least: int) -> str:
    return f"""marked AS (
  SELECT r.*, CASE WHEN g.early >= {least} THEN (flag_invalid = 0 AND "timestamp" < g.t0 + INTERVAL {days} DAY)
    ELSE flag_invalid = 0 END AS is_train
  FROM reg r JOIN (
    SELECT x.excavator_id, t0, count(*) FILTER (WHERE flag_invalid = 0 AND "timestamp" < t0 + INTERVAL {days} DAY) AS early
    FROM reg x JOIN (SELECT excavator_id, min("timestamp") AS t0 FROM reg GROUP BY 1) s USING (excavator_id)
    GROUP BY 1, 2) g USING (excavator_id))"""


def sliding_sql(source: str, widths: dict[int, int] = WIDTHS) -> str:
    names, frames = [], []
    for s, w in widths.items():
        least = max(2, w // 3)
        frames.append(f"w{s} AS (PARTITION BY excavator_id ORDER BY \"timestamp\" ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)")
        for c in S:
            def gate(x, fn):
                return f"CASE WHEN count({x}) OVER w{s} >= {least} THEN {fn}({x}) OVER w{s} END"
            names += [f"{gate(c, fn)} AS {c}_{kind}_{s}s" for fn, kind in (
                ("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))]
            names += [f"{gate('d_' + c, fn)} AS {c}_diff_{kind}_{s}s" for fn, kind in (("avg", "mean"), ("stddev_samp", "std"))]
            names.append(f"({c} - lag({c}, {w}) OVER o) / {s} AS {c}_slope_{s}s")
    return f"""changed AS (
  SELECT *, {", ".join(f"{c} - lag({c}) OVER (PARTITION BY excavator_id ORDER BY \"timestamp\") AS d_{c}" for c in S)}
  FROM {source}),
sliding AS (
  SELECT * EXCLUDE ({", ".join("d_" + c for c in S)}),
    {", ".join(names)}
  FROM changed
  WINDOW o AS (PARTITION BY excavator_id ORDER BY "timestamp"), {", ".join(frames)})"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a fixed score, their next failure and target."""
    tele = trucks(spark, d)
    score = ((F.col("event_id") * 7919) % 1000) / F.lit(1000.0)
    wins = resample(tele.withColumn("_p", score), TRUCK_KEYS, "timestamp", 43200, [F.max("_p").alias("proba")], False)
    return label_windows(next_event_asof(wins, failures(tele))).select(
        "asset_id", "mdm_object_name", "timestamp", "event_dt", "days_to_event", "target", "proba")


PRED = f"""{TELE}, {FAIL},
wins AS (
  SELECT asset_id, mdm_object_name, {sql_bin('"timestamp"', 43200)} AS ts, max(((event_id * 7919) % 1000) / CAST(1000 AS DOUBLE)) AS proba
  FROM tele GROUP BY ALL),
ahead AS (
  SELECT w.asset_id, w.mdm_object_name, w.ts AS "timestamp", f.event_dt,
    (epoch_us(f.event_dt) - epoch_us(w.ts)) / CAST(86400000000 AS DOUBLE) AS days_to_event, w.proba
  FROM wins w ASOF LEFT JOIN fail f ON w.asset_id = f.asset_id AND w.ts <= f.event_dt),
pred AS (
  SELECT *, CASE WHEN days_to_event BETWEEN 7 AND 30 THEN 1 ELSE 0 END AS target FROM ahead
  WHERE NOT coalesce(days_to_event >= 0 AND days_to_event < 7, false))"""
