"""Readers, writers, cleaning, labels, alerts on hand-made rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigpulse import schemas
from rigpulse.config import EpisodeConfig
from rigpulse.functions.columns import parse_ts, round_ts
from rigpulse.operators import evaluate, impute, labels, quality, shaping
from rigpulse.operators.episodes import baseline_statistics, episode_baseline, episode_contributions, three_digits
from rigpulse.operators.joins import alert_rows, merge_window_features
from rigpulse.operators.resample import TRUCK_KEYS, resample
from rigpulse.operators.rolling import label_regime
from rigpulse.operators.stats import standardize
from rigpulse.plans import ingest
from rigpulse.sources.readers import FILE, read_csv, read_reference, read_telemetry
from rigpulse.sources.writers import narrow_types, write_report, write_table

T0 = datetime(2024, 1, 1)


def column(df, name, by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_technical_values(spark):
    rows = [(0, None, 1.0, 1.0), (1, 0.0, 1.0, 1.0), (2, 360.0, 1.0, 1.0), (3, 360.01, 1.0, 1.0), (4, -0.1, 1.0, 1.0),
            (5, 5.0, None, 1.0), (6, 5.0, -1.0, 1.0), (7, 5.0, 1.0, -1e6), (8, 5.0, 1.0, -999999.0), (9, 5.0, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, heading_angle_deg double, gps_speed_kmh double, arm_inclination_deg double")
    made = quality.flag_technical_values(df)
    assert column(made, "flag_invalid") == [1, 0, 0, 1, 1, 0, 1, 1, 0, 0]
    assert column(made, "arm_inclination_deg")[7:] == [None, -999999.0, None]
    assert column(made, "gps_speed_kmh")[6] is None


def test_regimes(spark):
    rows = [(0, 0.3, 0.0, 0.0), (1, 0.31, 0.0, 5.0), (2, 1.0, None, 5.0), (3, None, -3.0, 3.0)]
    df = spark.createDataFrame(rows, "i int, gps_speed_kmh double, boom_inclination_x_deg double, arm_inclination_deg double")
    assert column(label_regime(df, EpisodeConfig()), "regime") == [
        "idle__no_tool_activity", "maneuver__tool_activity", "move__unknown", "maneuver__tool_activity"]


def test_first_reading_wins(spark):
    rows = [(0, "a", 1, 1.0), (1, "a", 1, 2.0), (2, "a", 2, 3.0), (3, "b", 1, None), (4, "b", 1, 4.0)]
    df = spark.createDataFrame(rows, "i int, m string, t int, v double")
    assert column(shaping.dedup_readings(df, ["m", "t"], ["i"]), "v") == [1.0, 3.0, None]
    assert column(shaping.dedup_readings(df, ["m", "t"], [-F.col("i")]), "v") == [2.0, 3.0, 4.0]


def test_labels(spark):
    days = [None, 0.0, 6.99, 7.0, 30.0, 30.01]
    rows = [(i, T0, None if d is None else T0 + timedelta(days=d)) for i, d in enumerate(days)]
    made = labels.label_windows(spark.createDataFrame(rows, "i int, timestamp timestamp, event_dt timestamp"))
    assert {r["i"]: r["target"] for r in made.collect()} == {0: 0, 3: 1, 4: 1, 5: 0}


def test_component_filter(spark):
    df = spark.createDataFrame([(0, "ДВИГАТЕЛЬ"), (1, "Engine"), (2, None), (3, "насос")], "i int, ComponentTypeField string")
    assert column(shaping.filter_component(df), "i") == [0, 1]
    assert shaping.filter_component(df.drop("ComponentTypeField")).count() == 4


def test_pruning(spark):
    df = spark.createDataFrame([(1, None, 5, -1000000.0, 7), (2, None, 5, 2.0, 8), (3, None, 5, 3.0, 9),
                                (None, None, None, -1000000.0, 10), (None, None, None, None, None)],
                               "` a ` int, empty double, same int, b double, `Unnamed: 0` int")
    made = shaping.clean_frame(df)
    assert made.columns == ["a", "b"]
    assert column(made, "b", "a") == [None, None, 2.0, 3.0]


def test_times(spark):
    df = spark.createDataFrame([(0, "bad"), (1, "2024-01-01 00:00:00.250"), (2, "2024-01-01 00:00:00.750")], "i int, t string")
    made = column(df.select("i", round_ts(parse_ts("t")).alias("t")), "t")
    assert made == [None, T0, T0 + timedelta(seconds=1)]
    with pytest.raises(Exception):
        df.select(parse_ts("t", strict=True)).collect()


def test_median_needs_a_value(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    with pytest.raises(ValueError):
        impute.impute_median(df, ["a", "b"])
    assert impute.impute_median(df, ["a"]).where("a is null").count() == 0


def test_standardize_constant(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0)], "i int, a double, b double")
    made = standardize(df, ["a", "b"])
    assert column(made, "a") == [-1.0, 1.0] and column(made, "b") == [0.0, 0.0]


def test_narrowing_keeps_large_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, 3000000000, 1.5)], "small long, large long, x double")
    assert [f.dataType.simpleString() for f in narrow_types(df).schema] == ["int", "bigint", "float"]
    write_table(df, str(tmp_path / "a" / "t"))
    assert spark.read.parquet(str(tmp_path / "a" / "t")).first()["large"] == 3000000000
    write_report(spark.createDataFrame([("a/b", 1)], "excavator_id string, n int"), str(tmp_path / "r"))
    assert (tmp_path / "r" / "excavator_id=a_b").exists()


def test_report_again_for_one_machine(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "excavator_id string, n int"
    write_report(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema), path)
    write_report(spark.createDataFrame([("a", 4)], schema), path)
    broken = spark.createDataFrame([("b", 5)], schema).withColumn("n", F.expr("if(n = 5, raise_error('stop'), n)").cast("int"))
    with pytest.raises(Exception, match="stop"):
        write_report(broken, path)
    assert sorted((r["excavator_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 4), ("b", 3)]


def test_digits_and_reports(spark):
    """Three significant digits of small, large, tied, signed and unknown numbers."""
    shown = {0.0: "0", 0.00012: "0.00012", 1.005: "1.01", 12.25: "12.3", -0.04567: "-0.0457", 999.6: "1000", 123456.0: "123000", None: "unknown"}
    df = spark.createDataFrame([(x,) for x in shown], "x double")
    assert {r["x"]: r["t"] for r in df.select("x", three_digits(F.col("x")).alias("t")).collect()} == shown
    assert df.where("x = 12.25").select(three_digits(F.col("x"), True)).first()[0] == "+12.3"


def test_one_alert_row_for_two_objects(spark):
    pred = spark.createDataFrame([(1, n, T0, T0 + timedelta(days=9)) for n in (12, 11)],
                                 "asset_id int, mdm_object_name int, timestamp timestamp, event_dt timestamp")
    report = spark.createDataFrame([(1, T0 + timedelta(days=9), T0, True)],
                                   "asset_id int, event_dt timestamp, first_alert_ts timestamp, detected boolean")
    assert [r["mdm_object_name"] for r in alert_rows(pred.drop("event_dt"), pred, report).collect()] == [11]


def test_truck_ingest(spark, tmp_path):
    folder = tmp_path / "telemetry"
    folder.mkdir()
    (folder / "telemetry_1.csv").write_text(
        "mdm_object_id,mdm_object_name, create_dt ,load_engine,pres_turbo\n"
        "1,11,2024-01-01 00:00:00,50,3\n1,11,2024-01-01 00:00:00,60,3\n2,12,bad,70,3\n2,12,2024-01-02 00:00:00,-1000000,3\n"
        "3,13,2024-01-04 00:00:00,70,3\n")
    (folder / "telemetry_2.csv").write_text("create_dt,mdm_object_id,mdm_object_name,inst_fuel, hydraulic_temp\n2024-01-01 00:00:00,1,11,9.5,71\n2024-01-03 00:00:00,1,11,NaN,x\n")
    (folder / "notes.csv").write_text("x\n1\n")
    raw = read_telemetry(spark, str(folder), schemas.TRUCK_RAW)
    assert raw.select(FILE).distinct().count() == 2 and raw.count() == 7
    assert sorted(r[0] or "" for r in raw.select("hydraulic_temp").collect()) == ["", "", "", "", "", "71", "x"]
    made = ingest.truck_telemetry(raw).orderBy("timestamp", "engine_load").collect()
    assert [(r["asset_id"], r["engine_load"]) for r in made] == [(1, None), (1, 50.0), (2, None), (1, None), (3, 70.0)]
    assert "boost_pressure" not in made[0].asDict() and "fuel_rate" not in made[0].asDict()
    assert ingest.truck_telemetry(raw, scope="table").count() == 4


def test_event_ingest(spark, tmp_path):
    (tmp_path / "idles.csv").write_text(
        "OBJECTID,OBJECTNAME,GMTBEGINTIME,IDLETYPENAME\n1,11,2024-01-01 00:00:00,Топливная система\n"
        "1,11,2024-01-01 00:00:00,Топливная система\n2,12,bad,Топливная система\n3,13,2024-01-02 00:00:00,Шины\n")
    events = ingest.failure_events(read_csv(spark, str(tmp_path / "idles.csv"), schemas.IDLES)).collect()
    assert [(r["asset_id"], r["mdm_object_name"], r["case"]) for r in events] == [(1, 11, "fuel_degradation")]
    (tmp_path / "oil.csv").write_text(
        "UnitNumberField,TakenDate,ComponentTypeField,Condition\n1374,2024-01-01 00:00:00,Двигатель,Severe\n"
        "9,2024-01-02 00:00:00,ENGINE,Abnormal\n9,2024-01-03 00:00:00,насос,Severe\n9,2024-01-04 00:00:00,engine,Normal\n")
    oil = ingest.oil_events(read_reference(spark, str(tmp_path / "oil.csv"), schemas.OIL)).orderBy("event_time").collect()
    assert [(r["mdm_object_name"], r["asset_id"]) for r in oil] == [(1374, 1383), (9, None)]


def test_excavator_ingest(spark):
    names = ["mdm_object_uuid", "create_dt", *ingest.EXCAVATOR_RAW_SENSORS]
    rows = [("a", T0, *[0.0] * 6), ("a", T0 + timedelta(seconds=15), *[3.0] * 6), ("b", T0 + timedelta(seconds=5), *[9.0] * 6)]
    tele = spark.createDataFrame(rows, ", ".join([f"{names[0]} string", f"{names[1]} timestamp", *[f"{c} double" for c in names[2:]]]))
    oil = spark.createDataFrame([("a", T0, 7)], "CustomerId string, ReportedDate timestamp, iron int")
    repairs = spark.createDataFrame([("b", 2.0, 100.0)], schemas.ENGINE_REPAIRS)
    made = ingest.excavator_dataset(tele, oil, repairs).orderBy("mdm_object_uuid", "create_dt").collect()
    assert [r["speed_gps"] for r in made] == [0.0, 1.0, 2.0, 3.0, 9.0]
    assert [r["iron"] for r in made] == [7, None, None, None, None]
    assert made[-1][schemas.REPAIR_COLUMNS[1]] == 2.0


def test_early_warning(spark):
    event = T0 + timedelta(days=40)
    rows = [(1, 1, event - timedelta(days=d), event, float(d), int(7 <= d <= 30), p)
            for d, p in ((35, 0.9), (25, 0.7), (20, 0.1), (10, 0.9), (3, 0.9))]
    rows += [(2, 2, event - timedelta(days=9), event, 9.0, 1, 0.2), (3, 3, T0, None, None, 0, 0.99)]
    pred = spark.createDataFrame(rows, "asset_id int, mdm_object_name int, timestamp timestamp, event_dt timestamp, "
                                       "days_to_event double, target int, proba double")
    report = {r["asset_id"]: r for r in evaluate.early_warning_report(pred).collect()}
    assert set(report) == {1, 2}
    assert report[1]["lead_days"] == 25 and report[1]["first_alert_proba"] == 0.7 and report[1]["detected"]
    assert report[2]["lead_days"] is None and not report[2]["detected"]
    counts = evaluate.alert_precision(pred).first()
    assert (counts["true_positive"], counts["false_positive"], counts["false_negative"], counts["precision"]) == (3, 2, 1, 0.6)
    assert evaluate.event_recall(pred).first()["recall"] == 0.5
    empty = evaluate.alert_precision(pred.where("false")).first()
    assert empty["precision"] == 0.0


def test_ranking_against_all_pairs(spark):
    rows = [((i * 37) % 50 / 50.0, int((i * 13) % 7 < 3)) for i in range(400)]
    pred = spark.createDataFrame(rows, "proba double, target int").repartition(3)
    positive, negative = [p for p, t in rows if t], [p for p, t in rows if not t]
    won = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    assert evaluate.roc_auc(pred).first()["roc_auc"] == pytest.approx(won / len(positive) / len(negative))
    total = seen = 0.0
    for s in sorted({p for p, _ in rows}, reverse=True):
        chosen = [t for p, t in rows if p >= s]
        recall = sum(chosen) / len(positive)
        total, seen = total + (recall - seen) * sum(chosen) / len(chosen), recall
    assert evaluate.average_precision(pred).first()["average_precision"] == pytest.approx(total)


def test_baseline_levels(spark):
    """Level 3 at the start of a regime, 2 after a long gap, 1 otherwise."""
    rows = [("a", T0 + timedelta(hours=h), "r", float(h), e) for h, e in
            ((0, 1), (1, 1), (2, 0), (3, 0), (4, 2), (5, 0), (500, 3), (501, 3), (502, 0))]
    points = spark.createDataFrame(rows, "excavator_id string, timestamp timestamp, regime string, v double, episode_id int")
    episodes = points.where("episode_id > 0").groupBy("excavator_id", "episode_id", "regime").agg(F.min("timestamp").alias("start_ts"))
    base = episode_baseline(points, episodes, features=["v"])
    found = {(r["episode_id"], r["level"]): r["n"] for r in base.groupBy("episode_id", "level").agg(F.count("*").alias("n")).collect()}
    assert found == {(1, 3): 9, (2, 1): 4, (3, 2): 6}
    top = episode_contributions(points, episodes, features=["v"]).where("episode_id = 2").first()
    assert top["baseline_median"] == 1.5 and top["episode_median"] == 4.0 and top["direction"] == "up"


def test_baseline_statistics_against_a_loop(spark):
    """An episode each hour, nulls, ties, another machine, a gap of weeks, episodes before any reading."""
    rng = np.random.default_rng(8)
    hours = [*range(0, 400), *range(1500, 1700)]
    rows = [(m, T0 + timedelta(hours=h, minutes=int(rng.integers(0, 30))), "r" if rng.random() < 0.7 else None if rng.random() < 0.1 else "s",
             float(rng.integers(0, 40)) if rng.random() < 0.9 else None, float(rng.normal()) if m == "a" else None, 0)
            for m in ("a", "b") for h in hours]
    points = spark.createDataFrame(rows, "excavator_id string, timestamp timestamp, regime string, v double, w double, episode_id int")
    asked = [(m, i + 1, r, T0 + timedelta(hours=int(h))) for m, r in (("a", "r"), ("a", "s"), ("b", "r"), ("c", "r"))
             for i, h in enumerate(range(-3, 1750, 7))]
    episodes = spark.createDataFrame(asked, "excavator_id string, episode_id int, regime string, start_ts timestamp")
    made = {(r["excavator_id"], r["regime"], r["episode_id"]): r for r in baseline_statistics(
        points, episodes.where("regime = 'r'"), features=["v", "w"]).withColumn("regime", F.lit("r")).unionByName(baseline_statistics(
            points, episodes.where("regime = 's'"), features=["v", "w"]).withColumn("regime", F.lit("s"))).collect()}
    expected = 0
    for machine, episode, regime, start in asked:
        own = [r for r in rows if r[0] == machine and r[2] == regime]
        before = [r for r in own if r[1] < start]
        near = [r for r in before if r[1] >= start - timedelta(days=7)]
        chosen = near or before or own
        if not chosen:
            assert (machine, regime, episode) not in made
            continue
        expected += 1
        found = made[machine, regime, episode]
        assert found["level"] == (1 if near else 2 if before else 3)
        for name, at in (("v", 3), ("w", 4)):
            x = np.array([r[at] for r in chosen if r[at] is not None])
            middle = float(np.median(x)) if len(x) else None
            assert found[f"{name}_median"] == (pytest.approx(middle) if len(x) else None)
            assert found[f"{name}_mad"] == pytest.approx(max(1.4826 * float(np.median(np.abs(x - middle))), 1e-9) if len(x) else 1e-9)
    assert len(made) == expected


def test_merged_spine_is_not_broadcast(spark):
    """A planner that takes a span of bins for a row would send all of them through the driver."""
    fuel = resample(spark.createDataFrame([(1, 1, T0 - timedelta(days=20 * 365), 1.0), (1, 1, T0, 2.0)],
                                          "asset_id int, mdm_object_name int, timestamp timestamp, fuel double"),
                    TRUCK_KEYS, "timestamp", 900, [F.max("fuel").alias("fuel")])
    base = spark.range(5000).select(F.lit(1).alias("asset_id"), F.lit(1).alias("mdm_object_name"),
                                    (F.lit(T0) - F.make_dt_interval("id")).alias("timestamp"))
    merged = merge_window_features(base, fuel)
    rows = merged.collect()
    assert len(rows) == 5000 and [r["fuel"] for r in rows if r["fuel"] is not None] == [2.0]
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan.split("Generate")[0]
