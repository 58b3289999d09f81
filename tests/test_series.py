"""Series helpers: independence of chunk, block and partition bounds; machines never mix."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigpulse.config import EpisodeConfig, min_rows, rows_in_window
from rigpulse.functions.series import Series, nearest_known, number_rows, with_previous
from rigpulse.operators.episodes import assign_episode_id, episode_intervals
from rigpulse.operators.evaluate import ranked_scores
from rigpulse.operators.impute import fill_forward_backward, interpolate_linear
from rigpulse.operators.joins import attach_trips, merge_window_features, next_event_asof
from rigpulse.operators.resample import resample, resample_means
from rigpulse.functions.frames import trailing_frames
from rigpulse.functions.ranks import RangeOrder
from rigpulse.operators import stats
from rigpulse.operators.rolling import episode_score, rolling, sampling_step, sliding_features, sliding_medians, time_rolling
from rigpulse.operators.shaping import decimate
from rigpulse.plans.excavators import clean_readings
from rigpulse.schemas import EXCAVATOR_SENSORS

T0 = datetime(2024, 1, 1)
FINE = Series(("m",), "ts", ("i",), chunk_seconds=7, block_rows=4)
WIDE = Series(("m",), "ts", ("i",))


@pytest.fixture(scope="module")
def readings(spark):
    """A hot machine with most rows, a small one, interleaved, with gaps and nulls."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        machine = "hot" if rng.random() < 0.85 else "cold"
        value = None if rng.random() < 0.4 else round(rng.uniform(-5, 5), 2)
        rows.append((i, machine, T0 + timedelta(seconds=i // 2 + (3600 if i > 150 else 0)), value, rng.randint(0, 1)))
    return spark.createDataFrame(rows, "i long, m string, ts timestamp, v double, on int").repartition(5)


def per_machine(df, *columns):
    rows = sorted(df.collect(), key=lambda r: (r["m"], r["ts"], r["i"]))
    return {m: [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows if r["m"] == m]
            for m in {r["m"] for r in rows}}


@pytest.mark.parametrize("series", [FINE, WIDE])
def test_row_numbers_and_previous(readings, series):
    numbers = per_machine(number_rows(readings, series), "_row")
    assert all(n == list(range(len(n))) for n in numbers.values())
    before = per_machine(with_previous(readings, series, {"v": "p"}), "v", "p")
    for rows in before.values():
        assert [p for _, p in rows] == [None, *[v for v, _ in rows][:-1]]


@pytest.mark.parametrize("series", [FINE, WIDE])
def test_fill(readings, series):
    source = per_machine(readings, "v")
    filled = per_machine(fill_forward_backward(readings, series, ["v"]), "v")
    for m, values in source.items():
        last, expected = None, []
        for v in values:
            last = v if v is not None else last
            expected.append(last)
        first = next(v for v in values if v is not None)
        assert filled[m] == [first if v is None else v for v in expected]


@pytest.mark.parametrize("series", [FINE, WIDE])
def test_interpolation(spark, readings, series):
    source = per_machine(readings, "v")
    made = per_machine(interpolate_linear(readings, series, ["v"]), "v")
    for m, values in source.items():
        known = [i for i, v in enumerate(values) if v is not None]
        expected = np.interp(range(len(values)), known, [values[i] for i in known])
        got = np.array([np.nan if v is None else v for v in made[m]])
        assert np.isnan(got[: known[0]]).all()
        assert np.allclose(got[known[0]:], expected[known[0]:])


@pytest.mark.parametrize("series", [FINE, WIDE])
def test_islands(readings, series):
    rows = assign_episode_id(readings, series, "on")
    for points in per_machine(rows, "on", "episode_id").values():
        current, was = 0, 0
        for on, episode in points:
            current += on == 1 and was == 0
            assert episode == (current if on else 0)
            was = on
    inside = rows.where("episode_id > 0").count()
    assert inside == rows.where("on = 1").count() == episode_intervals(rows, series).agg(F.sum("n_points")).first()[0]


def test_missing_label_is_an_error(readings):
    with pytest.raises(ValueError):
        assign_episode_id(readings, WIDE, "absent")


@pytest.mark.parametrize("rows, least", [(6, 2), (3, 3)])
def test_rolling_gate(readings, rows, least):
    made = per_machine(rolling(readings, FINE, {"r": ("v", "mean", rows, least)}), "v", "r")
    for points in made.values():
        values = [v for v, _ in points]
        for i, (_, r) in enumerate(points):
            frame = [v for v in values[max(0, i - rows + 1): i + 1] if v is not None]
            assert (r is None) == (len(frame) < least)
            assert r is None or r == pytest.approx(np.mean(frame))


def test_window_lengths():
    assert [rows_in_window(s, step) for s, step in ((30, 5), (60, 5), (120, 5), (30, 60), (150, 60))] == [6, 12, 24, 2, 2]
    assert [min_rows(w) for w in (2, 6, 24)] == [2, 2, 8]


def test_sampling_step(spark):
    rows = [("a", T0 + timedelta(seconds=5 * i), i) for i in range(9)] + [("b", T0, 1)]
    rows += [("c", T0 + timedelta(minutes=9 * i), i) for i in range(4)] + [("d", T0 + timedelta(milliseconds=200 * i), i) for i in range(4)]
    steps = sampling_step(spark.createDataFrame(rows, "m string, ts timestamp, i int"), WIDE)
    assert {r["m"]: r["step"] for r in steps.collect()} == {"a": 5, "b": 5, "c": 60, "d": 1}


def test_sliding_features_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(m, T0 + timedelta(seconds=step * i), i, None if rng.random() < 0.2 else rng.uniform(0, 9), step)
            for m, step in (("x", 5), ("y", 10), ("fine", 1), ("odd", 7), ("half", 12), ("coarse", 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "m string, ts timestamp, i int, v double, step int")
    made = sliding_features(df, EpisodeConfig(win_seconds=(30,)), FINE, ["v"])
    points = per_machine(made, "v", "v_mean_30s", "v_diff_std_30s", "v_slope_30s")
    for m, w in (("x", 6), ("y", 3), ("fine", 30), ("odd", 4), ("half", 2), ("coarse", 2)):
        least = min_rows(w)
        values = [p[0] for p in points[m]]
        changes = [None if i == 0 or values[i] is None or values[i - 1] is None else values[i] - values[i - 1] for i in range(40)]
        for i, (_, mean, spread, slope) in enumerate(points[m]):
            frame = [v for v in values[max(0, i - w + 1): i + 1] if v is not None]
            moved = [v for v in changes[max(0, i - w + 1): i + 1] if v is not None]
            assert mean == (pytest.approx(np.mean(frame)) if len(frame) >= least else None)
            assert spread == (pytest.approx(np.std(moved, ddof=1)) if len(moved) >= least else None)
            old = values[i - w] if i >= w else None
            assert slope == (None if old is None or values[i] is None else pytest.approx((values[i] - old) / 30))


def test_time_rolling_bounds(spark):
    rows = [("a", T0 + timedelta(minutes=m), float(m)) for m in (0, 20, 29, 30, 59)]
    made = time_rolling(spark.createDataFrame(rows, "m string, ts timestamp, v double"), ["m"], "ts", ["v"], 1800)
    assert [r["v_mean"] for r in made.orderBy("ts").collect()] == [0.0, 10.0, pytest.approx(49 / 3), pytest.approx(79 / 3), pytest.approx(44.5)]


def test_asof_against_all_pairs(spark):
    rng = random.Random(5)
    windows = [(rng.choice("ab"), T0 + timedelta(hours=rng.randint(0, 900))) for _ in range(80)] + [("none", T0)]
    events = [(rng.choice("ab"), T0 + timedelta(hours=rng.randint(0, 800))) for _ in range(9)] + [("a", None)]
    w = spark.createDataFrame(windows, "asset_id string, timestamp timestamp")
    e = spark.createDataFrame(events, "asset_id string, event_dt timestamp")
    for chunk in (3600, 86400, 10**9):
        got = sorted(((r[0], r[1], r[2]) for r in next_event_asof(w, e, chunk_seconds=chunk).collect()), key=str)
        expected = sorted(((a, t, min((x for b, x in events if b == a and x and x >= t), default=None)) for a, t in windows), key=str)
        assert got == expected


def test_dense_bins(spark):
    rows = [("a", datetime(2024, 1, 1, 13, 10), 1.0), ("a", datetime(2024, 1, 3, 1, 0), 2.0), ("b", datetime(2024, 1, 1, 0, 0), 3.0)]
    df = spark.createDataFrame(rows, "m string, ts timestamp, v double")
    bins = resample_means(df, ["m"], "ts", 43200, ["v"]).orderBy("m", "ts").collect()
    assert [(r["m"], r["ts"].day, r["ts"].hour, r["v"]) for r in bins] == [
        ("a", 1, 12, 1.0), ("a", 2, 0, None), ("a", 2, 12, None), ("a", 3, 0, 2.0), ("b", 1, 0, 3.0)]


def test_sliding_medians():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 1000):
        values, known = rng.integers(0, 20, n) / 4.0, rng.random(n) < 0.8
        first = rng.integers(0, n, 200)
        end = np.minimum(n, first + rng.integers(0, n + 1, 200))
        made = sliding_medians(values, known, first, end)
        for i, (a, b) in enumerate(zip(first, end)):
            inside = values[a:b][known[a:b]]
            assert made.mask[i] if not len(inside) else made[i] == np.median(inside)


def test_one_plan_for_all_steps(spark):
    def windows(steps):
        df = spark.createDataFrame([(str(s), T0, s, 1.0, s) for s in steps], "m string, ts timestamp, i int, v double, step int")
        plan = sliding_features(df, EpisodeConfig(win_seconds=(30, 60)), FINE, ["v"])._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Window [")
    assert windows([5]) == windows(range(1, 31)) > 0


def test_range_order():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 65, 1000):
        values = rng.integers(-9, 9, n) / 8.0 if n % 2 else rng.normal(size=n)
        low = rng.integers(0, n, 300)
        high = low + 1 + rng.integers(0, n - low)
        order = RangeOrder(values)
        medians = order.medians(low, high)
        distances = order.deviations(low, high, medians)
        for a, b, m, d in zip(low, high, medians, distances):
            assert m == np.median(values[a:b])
            assert d == np.median(np.abs(values[a:b] - m))


@pytest.mark.parametrize("at_once", [5, 1 << 16])
def test_time_rolling_medians(spark, at_once):
    """Ties in time, nulls, a lone machine, rows without a time, against a plain loop."""
    rng = np.random.default_rng(4)
    rows = [(i, "a" if i % 4 else "b", T0 + timedelta(seconds=int(rng.integers(0, 900))) if i % 11 else None,
             float(rng.integers(0, 30)) if i % 7 else None) for i in range(300)] + [(300, "c", T0, None)]
    df = spark.createDataFrame(rows, "id int, machine string, ts timestamp, v double")
    made = {r["id"]: r for r in time_rolling(df, ["machine"], "ts", ["v"], 60, at_once).collect()}
    assert len(made) == 301
    for i, machine, ts, _ in rows:
        near = [v for _, m, t, v in rows if ts and t and m == machine and 0 <= (ts - t).total_seconds() < 60 and v is not None]
        assert made[i]["v_median"] == (float(np.median(near)) if near else None)
        assert made[i]["v_mean"] == (pytest.approx(np.mean(near)) if near else None)


def test_open_trips(spark):
    """Trips of every length around slot borders, one without an end, a reading with a wrong clock."""
    readings = [(i, "a", T0 + timedelta(minutes=17 * i)) for i in range(200)] + [(900, "a", T0 + timedelta(days=30000)), (901, "b", T0), (902, "a", None)]
    trips = [(n, "a", T0 + timedelta(minutes=s), T0 + timedelta(minutes=s + length))
             for n, (s, length) in enumerate((s, length) for s in (-100, 0, 59, 60, 61, 500) for length in (0, 1, 59, 60, 61, 120, 1000))]
    trips += [(99, "a", T0 + timedelta(days=1), T0 + timedelta(days=2_000_000)), (98, "a", T0, None)]
    made = attach_trips(spark.createDataFrame(readings, "id int, excavator_id string, timestamp timestamp"),
                        spark.createDataFrame(trips, "trip int, object_uuid string, start_time timestamp, end_time timestamp"))
    expected = []
    for i, machine, t in readings:
        inside = [n for n, m, s, e in trips if t and e and m == machine and s <= t < e]
        expected += [(i, n) for n in inside] or [(i, None)]
    assert sorted(((r["id"], r["trip"]) for r in made.collect()), key=str) == sorted(expected, key=str)


def test_frames_grow(spark):
    """Frames that shrink are computed anew for every row, so none may run from a row to the end of its part."""
    series = Series(("m",), "t", ("i",), chunk_seconds=100)
    rows = [(i, "a" if i % 3 else "b", T0 + timedelta(seconds=i // 2), None if i % 7 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, m string, t timestamp, v double")
    near = nearest_known(df, series, {"v": F.col("v")})
    events = df.where("v is not null and i % 4 = 0").select("m", F.col("t").alias("event_dt"))
    ahead = next_event_asof(df.drop("v"), events, ("m",), "t", "event_dt", 100)
    for made in (near, ahead, ranked_scores(df.selectExpr("v as proba", "i % 2 as target"))):
        assert "currentrow$(), unboundedfollowing$()" not in made._jdf.queryExecution().executedPlan().toString()
    known = {m: [r for r in rows if r[1] == m and r[3] is not None] for m in "ab"}
    for r in near.collect():
        assert r["v_after"] == next((k[3] for k in known[r["m"]] if k[0] >= r["i"]), None)
        assert r["v_before"] == next((k[3] for k in reversed(known[r["m"]]) if k[0] <= r["i"]), None)
    for r in ahead.collect():
        assert r["event_dt"] == next((k[2] for k in known[r["m"]] if k[0] % 4 == 0 and k[2] >= r["t"]), None)


def test_what_grows_with_the_input_is_not_broadcast(spark):
    """Tables of chunks, bins and fuel windows are small here, so a planner left to their size would broadcast them."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("m"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
                                    F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("v"))
    series = Series(("m",))
    events = rows.where("v % 50 = 1").select("m", F.col("timestamp").alias("event_dt"))
    bins = resample(rows, ["m"], "timestamp", 7200, [F.max("v").alias("v")])
    for made in (number_rows(rows, series), with_previous(rows, series, {"v": "u"}), nearest_known(rows, series, {"v": F.col("v")}),
                 next_event_asof(rows, events, ["m"]), bins, merge_window_features(bins.drop("v"), bins, ["m", "timestamp"])):
        assert made.count()
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_shared_rows_are_worked_out_once(spark):
    """What reads its rows several times must not work them out several times: a counter sees each row once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    days = spark.range(400).select((F.col("id") % 3).cast("string").alias("excavator_id"), F.lit(60).alias("step"),
                                   F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"), F.col("id").cast("double").alias("v"))
    rows = days.withColumn("x", counted("v"))
    by, machine = ["excavator_id"], Series(("excavator_id",))
    raw = rows.select("*", *[F.col("x").alias(c) for c in EXCAVATOR_SENSORS])
    for made in (lambda: stats.standardize(rows, ["x"], by), lambda: stats.min_max_scale(rows, ["x"], by),
                 lambda: stats.robust_scale(rows, ["x"], by), lambda: episode_score(rows, EpisodeConfig(), score="x"),
                 lambda: decimate(rows, machine), lambda: clean_readings(raw, ["v"]),
                 lambda: assign_episode_id(rows.withColumn("on", F.col("x") % 7 > 3), machine, "on")):
        before = seen.value
        made().collect()
        assert seen.value - before == 400


def test_trailing_frames():
    rng = np.random.default_rng(4)
    place = np.concatenate([np.arange(n) for n in (1, 90, 2, 40)])
    x, known = rng.integers(0, 9, (len(place), 2)) / 8.0, rng.random((len(place), 2)) < 0.7
    x[60:80, 1] = 0.1
    for width, frame in trailing_frames(x, known, place, [2, 3, 8, 13, 64]).items():
        for i, at in enumerate(place):
            rows = slice(i - min(at, width - 1), i + 1)
            for c in range(2):
                values = x[rows, c][known[rows, c]]
                assert frame.n[i, c] == len(values)
                if len(values) > 1:
                    assert (frame.low[i, c], frame.high[i, c]) == (values.min(), values.max())
                    assert (frame.mean[i, c], frame.std[i, c]) == pytest.approx((values.mean(), values.std(ddof=1)), abs=1e-12)
                    assert frame.std[i, c] == 0 or len(set(values)) > 1


def test_windows_take_no_step_for_each_row_they_hold(spark):
    """A window of 15 minutes holds 900 rows at a step of a second; a sliding frame of Spark goes through all of them for each row."""
    days = spark.range(50).select(F.lit("a").alias("excavator_id"), F.timestamp_seconds("id").alias("timestamp"), F.lit(1).alias("step"),
                                  *[F.col("id").cast("double").alias(c) for c in [*EXCAVATOR_SENSORS, "anomaly_score"]])
    cfg = EpisodeConfig(win_seconds=(240, 900))
    for made in (sliding_features(days, cfg), episode_score(days, cfg)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "RangeFrame, -" not in plan and "specifiedwindowframe(RangeFrame" not in plan
