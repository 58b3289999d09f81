"""Physical plausibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The range each quantity can really take. Values outside are sensor errors.
PHYSICAL_LIMITS = {
    "gps_speed_kmh": (0.0, 10.0),
    "platform_inclination_x_deg": (-35.0, 35.0),
    "platform_inclination_y_deg": (-35.0, 35.0),
    "platform_tilt_magnitude": (0.0, 35.0),
    "boom_inclination_x_deg": (0.0, 120.0),
    "arm_inclination_deg": (0.0, 120.0),
    "boom_angle_delta_5s": (-10.0, 10.0),
    "arm_angle_delta_5s": (-10.0, 10.0),
    "boom_angle_diff": (-5.0, 5.0),
    "arm_angle_diff": (-5.0, 5.0),
    "boom_vibration_std_60s": (0.0, 5.0),
    "arm_vibration_std_60s": (0.0, 5.0),
    "alt": (0.0, float("inf")),
}
NONZERO = ("lat", "lon")
REAL, ERROR = "real_anomaly", "sensor_error"


def classify_outliers(outliers: DataFrame, limits: Mapping[str, tuple[float, float]] | None = None,
                      feature: str = "feature", value: str = "value") -> DataFrame:
    """``outlier_class`` of a long table of outliers: possible value or sensor error; null for unknown features."""
    rules = PHYSICAL_LIMITS if limits is None else limits
    low = F.create_map(*[F.lit(x) for f, (a, _) in rules.items() for x in (f, a)])
    high = F.create_map(*[F.lit(x) for f, (_, b) in rules.items() for x in (f, b)])
    name, v = F.col(feature), F.col(value)
    inside = v.between(F.try_element_at(low, name), F.try_element_at(high, name))
    known = F.when(name.isin(*NONZERO), F.when(v != 0, REAL).otherwise(ERROR)).when(inside, REAL).when(~inside, ERROR)
    return outliers.withColumn("outlier_class", F.when(v.isNotNull(), known))


def bank_asymmetry(df: DataFrame, banks: Sequence[str], name: str = "bank_asymmetry") -> DataFrame:
    """Largest minus smallest temperature of the engine banks; nulls ignored."""
    columns: list[Column] = [F.col(c) for c in banks]
    return df.withColumn(name, F.greatest(*columns) - F.least(*columns))
