"""Features over the rows before."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rigpulse.config import EpisodeConfig, min_rows, rows_in_window
from rigpulse.functions.columns import col, motion_regime, sure, work_regime
from rigpulse.functions.frames import trailing_frames
from rigpulse.functions.quantiles import group_quantiles
from rigpulse.functions.ranks import RangeOrder
from rigpulse.functions.series import Series, gated, map_blocks, number_rows, over_rows, with_previous
from rigpulse.schemas import EXCAVATOR_SENSORS
from rigpulse.session import materialize

EXCAVATOR = Series(("excavator_id",))
TRUCK = Series(("asset_id", "mdm_object_name"))
STEP = "_step"


def add_rail_features(tele: DataFrame, series: Series = TRUCK) -> DataFrame:
    """Deviation from the wanted pressure, and change since the machine's previous reading."""
    return (with_previous(tele, series, {"rail_pressure": "_before"})
            .withColumn("rail_error", F.col("rail_pressure") - F.col("rail_pressure_target"))
            .withColumn("rail_diff", F.col("rail_pressure") - F.col("_before")).drop("_before"))


def lag_features(df: DataFrame, series: Series = EXCAVATOR, columns: Sequence[str] = tuple(EXCAVATOR_SENSORS),
                 steps: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Values ``n`` rows earlier and differences to them."""
    def build(w: WindowSpec) -> list[Column]:
        made = []
        for c in columns:
            made += [F.lag(c, n).over(w).alias(f"{c}_shift_{n}") for n in steps]
            made += [(F.col(c) - F.lag(c, n).over(w)).alias(f"{c}_diff_{n}") for n in steps]
        return made
    return over_rows(df, series, max(steps), build)


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def rolling(df: DataFrame, series: Series, specs: dict[str, tuple[str, str, int, int]]) -> DataFrame:
    """``{name: (column, mean|std|min|max, rows, least known rows)}``."""
    functions = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}

    def build(w: WindowSpec) -> list[Column]:
        return [gated(functions[fn](c), F.col(c), trailing(w, rows), least).alias(name)
                for name, (c, fn, rows, least) in specs.items()]
    return over_rows(df, series, max(rows for _, _, rows, _ in specs.values()), build)


# The trailing features of the feature table.
TRAILING = {
    "rolling_mean_speed": ("gps_speed_kmh", "mean", 10, 10),
    "rolling_std_speed": ("gps_speed_kmh", "std", 10, 10),
    "avg_speed_last_5min": ("gps_speed_kmh", "mean", 5, 5),
    "max_heading_last_hour": ("heading_angle_deg", "max", 60, 60),
}


def interaction_features(df: DataFrame) -> DataFrame:
    speed, heading = F.col("gps_speed_kmh"), F.col("heading_angle_deg")
    tilt_x, tilt_y = F.col("platform_inclination_x_deg"), F.col("platform_inclination_y_deg")
    return df.select(
        "*",
        F.try_divide(speed, heading + F.lit(1e-5)).alias("speed_direction_ratio"),
        (tilt_x - tilt_y).alias("platform_inclination_diff"),
        (speed * tilt_x).alias("speed_inclination_interaction"),
        (speed * heading).alias("speed_heading_interaction"),
    )


def additional_features(df: DataFrame, series: Series = EXCAVATOR) -> DataFrame:
    """Lags, trailing statistics and interactions; rows with any null are dropped."""
    numbered = number_rows(df, series)
    lagged = lag_features(numbered, series)
    return interaction_features(rolling(lagged, series, TRAILING)).drop("_row").na.drop("any")


def sliding_medians(values: np.ndarray, known: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ma.MaskedArray:
    """Median of the known values in ``values[first:end]`` for every pair of bounds; masked where none is known."""
    count = np.concatenate([[0], np.cumsum(known)])
    low, high = count[first], count[end]
    some = high > low
    made = np.ma.masked_all(len(first), np.float64)
    if some.any():
        made[some] = RangeOrder(values[known]).medians(low[some], high[some])
    return made


def time_rolling(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], seconds: int,
                 rows_at_once: int = 1 << 16) -> DataFrame:
    """Mean, std and median of the last ``seconds`` before and at each reading; rows without a time have none.

    Time slots as long as the frame split a machine; each slot also gets the readings of the one before it, which is as
    far back as a frame can reach. Means and deviations come from a time-range frame, medians from ``sliding_medians``
    over the same partitioning, whole slots of about ``rows_at_once`` rows at a time, and at least one slot and the one
    before it.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    untimed = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(1024)) - F.lit(1 << 62)
    rows = (df.withColumn("_us", micros).withColumn("_slot", F.floor(F.col("_us") / F.lit(float(span))).cast("long"))
            .withColumn("_part", F.explode(F.when(F.col("_us").isNull(), F.array(untimed))
                                           .otherwise(F.array(F.col("_slot"), F.col("_slot") + 1)))))
    ordered = Window.partitionBy(*keys, "_part").orderBy("_us")
    frame = ordered.rangeBetween(-(span - 1), 0)
    timed = F.col("_us").isNotNull()
    made = [F.row_number().over(ordered).alias("_place")]
    for c in columns:
        made += [F.when(timed, F.avg(c).over(frame)).alias(f"{c}_mean"),
                 F.when(timed, F.stddev_samp(c).over(frame)).alias(f"{c}_std")]
    framed = (rows.repartition(*keys, "_part").select("*", *made, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
              .sortWithinPartitions(*keys, "_part", "_place"))
    kept = [f for f in framed.schema if f.name in df.columns or f.name.endswith(("_mean", "_std"))]
    schema = StructType([StructField(f.name, f.dataType) for f in kept]
                        + [StructField(f"{c}_median", DoubleType()) for c in columns])

    def medians(table: pa.Table, starts: np.ndarray) -> pa.Table:
        us, part = (table[c].fill_null(0).to_numpy() for c in ("_us", "_part"))
        timed = table["_us"].is_valid().to_numpy()
        group = np.cumsum(np.isin(np.arange(len(us)), starts)) - 1
        own = ~timed | (table["_slot"].fill_null(0).to_numpy() == part)
        # a machine's slot and the one before it: from 0 to below two spans; three spans hold the groups apart
        at = group * (3 * span) + np.where(timed, us - (np.where(timed, part, 0) - 1) * span, 0)
        first, end = np.searchsorted(at, at[own] - (span - 1)), np.searchsorted(at, at[own], "right")
        result = table.select([f.name for f in kept]).filter(pa.array(own))
        for i, c in enumerate(columns):
            x = table[f"_x{i}"]
            m = sliding_medians(x.fill_null(0.0).to_numpy(), x.is_valid().to_numpy() & timed, first, end)
            result = result.append_column(f"{c}_median", pa.array(m.filled(0.0), pa.float64(), mask=np.ma.getmaskarray(m)))
        return result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, rows_at_once
        apart = max(1, (1 << 61) // (3 * span))
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
            if not rows or (batch is not None and rows < enough):
                continue
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(table["_place"].to_numpy() == 1)
            cuts = [*starts[::apart].tolist(), len(table) if batch is None else int(starts[-1])]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    inside = starts[(starts >= low) & (starts < high)] - low
                    yield from medians(table.slice(low, high - low), inside).to_batches()
            held = table.slice(cuts[-1]).to_batches()
            rows = len(table) - cuts[-1]
            enough = max(rows_at_once, 2 * rows)

    names = [f"{c}_{kind}" for c in columns for kind in ("mean", "std", "median")]
    return framed.mapInArrow(run, schema).select(*df.columns, *names)


def sampling_step(df: DataFrame, series: Series = EXCAVATOR) -> DataFrame:
    """Median seconds between readings of a machine, clipped to 1..60, whole part; 5 for a single reading."""
    micros = F.unix_micros(F.col(series.ts).cast("timestamp"))
    timed = df.select(*series.keys, series.ts, *series.ties, micros.alias("_us"))
    gaps = with_previous(timed, series, {"_us": "_us_before"}).select(
        *series.keys, ((F.col("_us") - F.col("_us_before")) / F.lit(1e6)).alias("_gap"))
    typical = group_quantiles(gaps, series.keys, {"_gap": (F.col("_gap"), 0.5)})
    machines = df.select(*series.keys).distinct()
    clipped = F.least(F.greatest(F.col("_gap"), F.lit(1.0)), F.lit(60.0)).cast("int")
    step = F.when(F.col("_gap").isNotNull(), clipped).otherwise(5)
    return machines.join(typical, list(series.keys), "left").select(*series.keys, step.alias("step"))


def _values(table: pa.Table, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and which of them are known, rows x columns."""
    known = [table[c].is_valid().to_numpy() for c in columns]
    return np.column_stack([table[c].fill_null(0.0).to_numpy() for c in columns]), np.column_stack(known)


def _by_step(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each sampling step and its rows; a block has one."""
    steps = table["step"].fill_null(0).to_numpy()
    for step in np.unique(steps[steps > 0]):
        yield int(step), np.flatnonzero(steps == step)


def sliding_features(df: DataFrame, cfg: EpisodeConfig, series: Series = EXCAVATOR,
                     columns: Sequence[str] = tuple(EXCAVATOR_SENSORS)) -> DataFrame:
    """Mean, std, min, max, change mean, change std and slope of each sensor in each window.

    ``df`` needs a column ``step`` of whole seconds, at least 1; machines of all steps share one plan.
    """
    names, width = sliding_names(cfg, columns), len(columns)
    inputs = [f"_v{i}" for i in range(width)]
    as_double = df.select("*", *[F.col(c).cast("double").alias(v) for c, v in zip(columns, inputs)])

    def features(table: pa.Table, place: np.ndarray) -> list[pa.Array]:
        x, known = _values(table, inputs)
        made, blank = np.zeros((len(names), len(place))), np.ones((len(names), len(place)), bool)
        for step, rows in _by_step(table):
            at = place[rows]
            for k, column, some in _window_features(x[rows], known[rows], at, cfg, step):
                made[k, rows], blank[k, rows] = column, ~some
        return [pa.array(v, mask=m) for v, m in zip(made, blank)]

    reach = max(rows_in_window(s, 1) for s in cfg.win_seconds) + 1
    return map_blocks(as_double, series, reach, names, features).select(*df.columns, *names)


def _window_features(x: np.ndarray, known: np.ndarray, place: np.ndarray, cfg: EpisodeConfig, step: int
                     ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place among ``sliding_names``, values and where there are any, of rows of one sampling step."""
    def earlier(rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The values so many rows before."""
        there = place >= rows
        source = np.flatnonzero(there) - rows
        value, some = np.zeros(x.shape), np.zeros(x.shape, bool)
        value[there], some[there] = x[source], known[source]
        return value, some

    width, kinds = x.shape[1], 7
    before, moved = earlier(1)
    moved &= known
    with np.errstate(invalid="ignore"):
        both, some = np.column_stack([x, x - before]), np.column_stack([known, moved])
    widths = {seconds: rows_in_window(seconds, step) for seconds in cfg.win_seconds}
    frames = trailing_frames(both, some, place, sorted(set(widths.values())), width)
    for number, (seconds, rows) in enumerate(widths.items()):
        frame = frames[rows]
        full, mean, std = frame.n >= min_rows(rows), frame.mean, frame.std
        old, had = earlier(rows)
        with np.errstate(invalid="ignore"):
            slope = (x - old) / float(max(1, seconds))
        for c in range(width):
            d, first = width + c, (number * width + c) * kinds
            for kind, (value, shown) in enumerate((
                    (mean[:, c], full[:, c]), (std[:, c], full[:, c]), (frame.low[:, c], full[:, c]), (frame.high[:, c], full[:, c]),
                    (mean[:, d], full[:, d]), (std[:, d], full[:, d]), (slope[:, c], known[:, c] & had[:, c]))):
                yield first + kind, value, shown


def sliding_names(cfg: EpisodeConfig, columns: Sequence[str] = tuple(EXCAVATOR_SENSORS)) -> list[str]:
    kinds = ("mean", "std", "min", "max", "diff_mean", "diff_std", "slope")
    return [f"{c}_{kind}_{s}s" for s in cfg.win_seconds for c in columns for kind in kinds]


def episode_score(df: DataFrame, cfg: EpisodeConfig, series: Series = EXCAVATOR, score: str = "anomaly_score",
                  name: str = "anomaly_score_episode") -> DataFrame:
    """Mean score of the last ``agg_minutes`` worth of rows; a null score counts as the machine's median.

    ``df`` needs a column ``step``. Medians and frames read the rows several times, so they are written once.
    """
    df = materialize(df)
    medians = materialize(group_quantiles(df, series.keys, {"_median": (F.col(score), 0.5)}))
    filled = df.join(medians, list(series.keys), "left").withColumn("_score", F.coalesce(score, "_median").cast("double"))

    seconds = cfg.agg_minutes * 60

    def means(table: pa.Table, place: np.ndarray) -> list[pa.Array]:
        x, known = _values(table, ["_score"])
        made, some = np.zeros(len(place)), np.zeros(len(place), bool)
        for step, rows in _by_step(table):
            width = rows_in_window(seconds, step)
            frame = trailing_frames(x[rows], known[rows], place[rows], [width], 0)[width]
            made[rows], some[rows] = frame.mean[:, 0], frame.n[:, 0] >= min_rows(width)
        return [pa.array(made, mask=~some)]

    return map_blocks(filled, series, rows_in_window(seconds, 1), [name], means).drop("_median", "_score")


def anomaly_density(df: DataFrame, rows: int, series: Series = EXCAVATOR, point: str = "anomaly_point") -> DataFrame:
    """Share of anomalous readings among the last ``rows``."""
    return rolling(df.withColumn("_p", col(point).cast("double")), series,
                   {"anomaly_density": ("_p", "mean", rows, min_rows(rows))}).drop("_p")


def label_regime(df: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Motion and tool regime of each reading."""
    return df.select(
        "*",
        motion_regime("gps_speed_kmh", cfg.idle_max_kmh, cfg.move_min_kmh).alias("regime_motion"),
        work_regime("boom_inclination_x_deg", "arm_inclination_deg").alias("regime_work"),
    ).withColumn("regime", F.concat_ws("__", "regime_motion", "regime_work"))


def healthy_proxy(df: DataFrame, cfg: EpisodeConfig, series: Series = EXCAVATOR) -> DataFrame:
    """Mark the rows that stand for normal work in ``is_train``.

    They are the valid rows of a machine's first days, or all its valid rows when those are too few.
    """
    keys, ts = list(series.keys), series.ts
    valid = F.col("flag_invalid") == 0
    starts = df.groupBy(*keys).agg(F.min(ts).alias("_start"))
    early = valid & (F.col(ts) < F.col("_start") + F.expr(f"INTERVAL {int(cfg.healthy_days)} DAYS"))
    marked = df.join(starts, keys)
    sizes = marked.groupBy(*keys).agg((F.count_if(early) >= cfg.min_healthy_rows).alias("_enough"))
    return (marked.join(sizes, keys)
            .withColumn("is_train", sure(F.when(F.col("_enough"), early).otherwise(valid)).cast("int"))
            .drop("_start", "_enough"))
