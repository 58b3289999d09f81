"""Trucks: windows, joins, labels, alerts, ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rigpulse.functions.columns import safe_segment
from rigpulse.operators import evaluate, joins, labels, resample, risk, shaping, stats
from rigpulse.operators.rolling import add_rail_features as rail_features
from rigpulse.operators.rolling import time_rolling as rolling_in_time
from rigpulse.functions.series import Series
from rigpulse.plans import trucks as plan
from suite.registry import query
from suite.views import FAIL, PRED, RAIL, TELE, events, failures, predictions, sql_bin, table, trucks

TIES = Series(("asset_id", "mdm_object_name"), ties=("event_id",))
OUT = list(resample.WINDOW_OUTPUTS)
FUEL = ["fuel_rate_mean", "fuel_rate_std"]
_FN = {"std": "stddev_samp", "min": "min", "max": "max", "mean": "avg"}
_AGGS = ", ".join(f"{_FN[fn]}({c}) AS {name}" for name, (fn, c) in resample.WINDOW_OUTPUTS.items())


def dense_sql(source: str, aggregates: str, seconds: int, name: str, where: str = "true") -> str:
    """CTEs for one dense resample: ``name`` has (asset_id, mdm_object_name, ts, aggregates)."""
    return f"""{name}_b AS (
  SELECT asset_id, mdm_object_name, {sql_bin('"timestamp"', seconds)} AS ts, {aggregates}
  FROM {source} WHERE {where} GROUP BY ALL),
{name}_s AS (
  SELECT asset_id, mdm_object_name, unnest(generate_series(min(ts), max(ts), INTERVAL {seconds} SECOND)) AS ts
  FROM {name}_b GROUP BY asset_id, mdm_object_name),
{name} AS (
  SELECT * FROM {name}_s LEFT JOIN {name}_b USING (asset_id, mdm_object_name, ts))"""


_STEADY = "vehicle_speed < 1 AND engine_load BETWEEN 20 AND 60"
_BASE = dense_sql("rail", _AGGS, 43200, "base")
_FUEL_AGG = "avg(fuel_rate) AS fuel_rate_mean, stddev_samp(fuel_rate) AS fuel_rate_std"
_FUEL15 = dense_sql("tele", _FUEL_AGG, 900, "fuel", _STEADY)


def _rail(spark, d):
    return rail_features(trucks(spark, d), TIES)


@query(f"WITH {TELE}, {RAIL} SELECT event_id, asset_id, rail_error, rail_diff FROM rail", "rail_error rail_diff")
def add_rail_features(spark, d):
    return _rail(spark, d).select("event_id", "asset_id", "rail_error", "rail_diff")


@query(f'WITH {TELE}, {RAIL}, {_BASE} SELECT * EXCLUDE (ts), ts AS "timestamp" FROM base', OUT)
def window_aggregate(spark, d):
    return resample.window_aggregate(_rail(spark, d), 43200)


@query(f"""WITH {TELE}, {dense_sql("tele", "avg(rail_pressure) AS rail_pressure, avg(fuel_rate) AS fuel_rate", 3600, "grid")}
SELECT * EXCLUDE (ts), ts AS "timestamp" FROM grid""", "rail_pressure fuel_rate")
def resample_dense(spark, d):
    return resample.resample_means(trucks(spark, d), ["asset_id", "mdm_object_name"], "timestamp", 3600,
                                   ["rail_pressure", "fuel_rate"])


@query(f"""WITH {TELE}, {dense_sql("tele", "count(*) AS n", 720, "grid")} SELECT asset_id, ts AS "timestamp" FROM grid""")
def time_spine(spark, d):
    bins = trucks(spark, d).select("asset_id", resample.bin_start("timestamp", 720).alias("timestamp")).distinct()
    return resample.time_spine(bins, ["asset_id"], "timestamp", 720)


@query(f'WITH {TELE}, {_FUEL15} SELECT * EXCLUDE (ts), ts AS "timestamp" FROM fuel', FUEL)
def steady_fuel_features(spark, d):
    return resample.steady_fuel_features(trucks(spark, d))


@query(f"""WITH {TELE}, {RAIL}, {_BASE}, {_FUEL15}
SELECT base.* EXCLUDE (ts), base.ts AS "timestamp", fuel_rate_mean, fuel_rate_std
FROM base LEFT JOIN fuel USING (asset_id, mdm_object_name, ts)""", OUT + FUEL)
def merge_window_features(spark, d):
    tele = trucks(spark, d)
    return joins.merge_window_features(resample.window_aggregate(_rail(spark, d), 43200), resample.steady_fuel_features(tele))


_WINDOWS = f"""{TELE}, {FAIL}, {RAIL}, {_BASE}, {_FUEL15},
merged AS (SELECT base.*, fuel_rate_mean, fuel_rate_std FROM base LEFT JOIN fuel USING (asset_id, mdm_object_name, ts)),
next_fail AS (
  SELECT m.*, f.event_dt, (epoch_us(f.event_dt) - epoch_us(m.ts)) / CAST(86400000000 AS DOUBLE) AS days_to_event
  FROM merged m ASOF LEFT JOIN fail f ON m.asset_id = f.asset_id AND m.ts <= f.event_dt),
labelled AS (
  SELECT * EXCLUDE (ts), ts AS "timestamp", CASE WHEN days_to_event BETWEEN 7 AND 30 THEN 1 ELSE 0 END AS target FROM next_fail
  WHERE NOT coalesce(days_to_event >= 0 AND days_to_event < 7, false))"""


def _features(spark, d):
    tele = trucks(spark, d)
    return joins.merge_window_features(resample.window_aggregate(_rail(spark, d), 43200), resample.steady_fuel_features(tele))


def _labelled(spark, d):
    return labels.label_windows(joins.next_event_asof(_features(spark, d), failures(trucks(spark, d))))


@query(f'WITH {_WINDOWS} SELECT asset_id, mdm_object_name, ts AS "timestamp", event_dt FROM next_fail')
def next_event_asof(spark, d):
    return joins.next_event_asof(_features(spark, d).select("asset_id", "mdm_object_name", "timestamp"), failures(trucks(spark, d)))


@query(f"WITH {_WINDOWS} SELECT * FROM labelled", OUT + FUEL + ["days_to_event"])
def label_windows(spark, d):
    return _labelled(spark, d)


@query(f"""WITH {_WINDOWS} SELECT asset_id, count(*) AS n_windows, count(event_dt) AS n_with_event, CAST(sum(target) AS BIGINT) AS n_positive,
  avg(rail_pressure_std) AS mean_pressure_std, min(days_to_event) AS min_days FROM labelled GROUP BY 1""",
       "mean_pressure_std min_days")
def window_positives(spark, d):
    return _labelled(spark, d).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count("event_dt").alias("n_with_event"),
        F.sum("target").alias("n_positive"), F.avg("rail_pressure_std").alias("mean_pressure_std"),
        F.min("days_to_event").alias("min_days"))


@query(f"""WITH {TELE}, {FAIL} SELECT event_id, event_dt,
  (epoch_us(event_dt) - epoch_us("timestamp")) / CAST(86400000000 AS DOUBLE) AS days_to_event,
  CASE WHEN days_to_event BETWEEN 0 AND 7 THEN 1 ELSE 0 END AS event_within_7d,
  CASE WHEN days_to_event BETWEEN 0 AND 14 THEN 1 ELSE 0 END AS event_within_14d,
  CASE WHEN days_to_event BETWEEN 0 AND 30 THEN 1 ELSE 0 END AS event_within_30d
FROM tele t ASOF LEFT JOIN fail f ON t.asset_id = f.asset_id AND t."timestamp" <= f.event_dt""", "days_to_event")
def label_horizons(spark, d):
    rows = trucks(spark, d).select("event_id", "asset_id", "timestamp")
    return labels.label_horizons(joins.next_event_asof(rows, failures(trucks(spark, d)))).drop("asset_id", "timestamp")


@query(f"""WITH {TELE} SELECT 'train' AS part, count(*) AS n, sum(rail_pressure) AS total FROM tele WHERE "timestamp" < TIMESTAMP '2024-01-20'
UNION ALL SELECT 'test', count(*), sum(rail_pressure) FROM tele WHERE "timestamp" >= TIMESTAMP '2024-01-20'""", "total")
def time_split(spark, d):
    parts = zip(("train", "test"), labels.time_split(trucks(spark, d), "2024-01-20"))
    train, test = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("rail_pressure").alias("total"))
                   for n, p in parts]
    return train.unionByName(test)


@query("""SELECT user_id, CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold,
  count(*) AS n FROM events GROUP BY ALL""")
def group_folds(spark, d):
    return labels.group_folds(events(spark, d), "user_id", 5).groupBy("user_id", "fold").agg(F.count(F.lit(1)).alias("n"))


_TRIPS = """trips AS (
  SELECT user_id AS object_uuid, event_id AS trip, ts AS start_time, ts + INTERVAL 150 MINUTE AS end_time
  FROM events WHERE event_type = 'view')"""


def _trips(spark, d):
    return events(spark, d).where("event_type = 'view'").select(
        F.col("user_id").alias("object_uuid"), F.col("event_id").alias("trip"), F.col("ts").alias("start_time"),
        (F.col("ts") + F.expr("INTERVAL 150 MINUTES")).alias("end_time"))


@query(f"""WITH {TELE}, {_TRIPS} SELECT event_id, asset_id, trip, start_time, end_time
FROM tele LEFT JOIN trips ON asset_id = object_uuid AND "timestamp" >= start_time AND "timestamp" < end_time""")
def attach_trips(spark, d):
    joined = joins.attach_trips(trucks(spark, d), _trips(spark, d), key="asset_id")
    return joined.select("event_id", "asset_id", "trip", "start_time", "end_time")


_OPEN = """trips AS (SELECT user_id AS object_uuid, event_id AS trip, ts AS start_time,
  CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '9999-01-01' ELSE ts + to_minutes(CAST(event_id % 5000 AS INTEGER)) END AS end_time
  FROM events WHERE event_type = 'error' AND event_id % 4 < 2),
late AS (SELECT event_id, asset_id, CASE WHEN event_id % 997 = 0 THEN TIMESTAMP '2099-01-01' ELSE "timestamp" END AS "timestamp" FROM tele)"""


@query(f"""WITH {TELE}, {_OPEN} SELECT asset_id, trip, count(*) AS readings, max("timestamp") AS last_reading
FROM late JOIN trips ON asset_id = object_uuid AND "timestamp" >= start_time AND "timestamp" < end_time GROUP BY ALL""")
def attach_open_trips(spark, d):
    """Trips of any length, some without an end, and readings whose clock is decades ahead."""
    e = F.col("event_id")
    end = F.when(e % 3 == 0, F.lit("9999-01-01").cast("timestamp")).otherwise(
        F.timestamp_micros(F.unix_micros("ts") + (e % 5000) * 60_000_000))
    trips = events(spark, d).where("event_type = 'error' AND event_id % 4 < 2").select(
        F.col("user_id").alias("object_uuid"), e.alias("trip"), F.col("ts").alias("start_time"), end.alias("end_time"))
    late = trucks(spark, d).withColumn("timestamp", F.when(e % 997 == 0, F.lit("2099-01-01").cast("timestamp")).otherwise(F.col("timestamp")))
    joined = joins.attach_trips(late, trips, key="asset_id").where("trip IS NOT NULL")
    return joined.groupBy("asset_id", "trip").agg(F.count("*").alias("readings"), F.max("timestamp").alias("last_reading"))


@query("""SELECT l_orderkey, l_linenumber, s.s_name AS lab, s.day AS reported FROM lineitem LEFT JOIN (
  SELECT DISTINCT l_suppkey AS k, l_shipdate AS day, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1) s
  ON l_suppkey = s.k AND l_shipdate = s.day""")
def attach_oil_exact(spark, d):
    rows = table(spark, d, "lineitem")
    lab = (rows.where("l_linenumber = 1").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
           .select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("reported"), F.col("s_name").alias("lab")).distinct())
    return joins.attach_oil_exact(rows, lab, "l_suppkey", "l_shipdate", "k", "reported").select(
        "l_orderkey", "l_linenumber", "lab", "reported")


@query("""SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3)
  ON c_nationkey = n_nationkey""")
def attach_repairs(spark, d):
    sheet = table(spark, d, "nation").where("n_regionkey < 3")
    return joins.attach_repairs(table(spark, d, "customer"), sheet, "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name")


_SIGNAL = ["rail_pressure", "fuel_rate"]


@query(f"""WITH {TELE} SELECT event_id, """ + ", ".join(
    f"avg({c}) OVER w AS {c}_mean, stddev_samp({c}) OVER w AS {c}_std, quantile_cont({c}, 0.5) OVER w AS {c}_median" for c in _SIGNAL) + """
FROM tele WINDOW w AS (PARTITION BY asset_id ORDER BY epoch_us("timestamp") RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
       [f"{c}_{k}" for c in _SIGNAL for k in ("mean", "std", "median")])
def time_rolling(spark, d):
    made = [f"{c}_{k}" for c in _SIGNAL for k in ("mean", "std", "median")]
    return rolling_in_time(trucks(spark, d), ["asset_id"], "timestamp", _SIGNAL, 86400).select("event_id", *made)


@query(f"""WITH {TELE}, slopes AS (SELECT asset_id, mdm_object_name, {sql_bin('"timestamp"', 604800)} AS b,
  regr_slope(fuel_rate, engine_load) AS per_load,
  regr_slope(fuel_rate, (epoch_us("timestamp") % 604800000000) / CAST(3600000000 AS DOUBLE)) AS per_hour
FROM tele WHERE {_STEADY} GROUP BY ALL)
SELECT asset_id, mdm_object_name, b AS "timestamp", CASE WHEN NOT isnan(per_load) THEN per_load END AS fuel_per_load,
  CASE WHEN NOT isnan(per_hour) THEN per_hour END AS fuel_per_hour FROM slopes""", "fuel_per_load fuel_per_hour")
def fuel_drift(spark, d):
    return resample.fuel_drift(trucks(spark, d), 604800)


@query(f"""WITH {TELE}, w AS (
  SELECT asset_id, mdm_object_name, {sql_bin('"timestamp"', 604800)} AS b, rail_pressure AS x,
    2 * pi() * (epoch_us("timestamp") % 604800000000) / CAST(604800000000 AS DOUBLE) AS ph FROM tele),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY asset_id, b) AS y FROM w)
SELECT asset_id, mdm_object_name, b AS "timestamp", count(*) AS n,
  2 * sqrt(sum(y * cos(ph)) ** 2 + sum(y * sin(ph)) ** 2) / count(*) AS amplitude_1,
  2 * sqrt(sum(y * cos(7 * ph)) ** 2 + sum(y * sin(7 * ph)) ** 2) / count(*) AS amplitude_7
FROM c GROUP BY ALL""", "amplitude_1 amplitude_7")
def pressure_spectrum(spark, d):
    return resample.pressure_spectrum(trucks(spark, d), 604800, [1, 7])


@query("SELECT event_id, greatest(value, value * 2 - 10, k) - least(value, value * 2 - 10, k) AS bank_asymmetry FROM "
       "(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)", "bank_asymmetry")
def bank_asymmetry(spark, d):
    from rigpulse.operators.physics import bank_asymmetry as asymmetry
    banks = events(spark, d).select("event_id", F.col("value").alias("a"), (F.col("value") * 2 - 10).alias("b"), F.col("k").alias("c"))
    return asymmetry(banks, ["a", "b", "c"]).select("event_id", "bank_asymmetry")


@query(f"""WITH {_WINDOWS} SELECT 'rail_pressure_std' AS "column", corr(rail_pressure_std, target) AS corr FROM labelled
UNION ALL SELECT 'temp_engine_mean', corr(temp_engine_mean, target) FROM labelled
UNION ALL SELECT 'rail_diff_max', corr(rail_diff_max, target) FROM labelled""", "corr")
def correlations(spark, d):
    return stats.correlations(_labelled(spark, d), ["rail_pressure_std", "temp_engine_mean", "rail_diff_max"], "target")


# evaluation on a fixed score

_RANKED = f"""{PRED}, sc AS (
  SELECT proba AS score, count(*) FILTER (WHERE target = 1) AS p, count(*) FILTER (WHERE target = 0) AS n FROM pred GROUP BY 1),
ranked AS (
  SELECT *, CAST(sum(p) OVER d AS BIGINT) AS tp, CAST(sum(n) OVER d AS BIGINT) AS fp,
    row_number() OVER (ORDER BY score) - 1 AS position, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n, count(*) OVER () AS scores
  FROM sc WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {PRED} SELECT * FROM pred", "days_to_event proba")
def prediction_table(spark, d):
    from rigpulse.operators.shaping import prediction_table as predicted
    return predicted(predictions(spark, d))


@query(f"WITH {_RANKED} SELECT sum((all_n - fp + n / 2) * p) / max(all_p * all_n) AS roc_auc FROM ranked", "roc_auc")
def roc_auc(spark, d):
    return evaluate.roc_auc(predictions(spark, d))


@query(f"WITH {_RANKED} SELECT sum(p / all_p * tp / (tp + fp)) AS average_precision FROM ranked", "average_precision")
def average_precision(spark, d):
    return evaluate.average_precision(predictions(spark, d))


@query(f'WITH {_RANKED} SELECT position, score AS threshold, tp / (tp + fp) AS "precision", tp / all_p AS recall FROM ranked',
       "threshold precision recall")
def pr_curve(spark, d):
    return evaluate.pr_curve(predictions(spark, d))


@query(f"""WITH {_RANKED}, k(share) AS (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)))
SELECT share, tp / (tp + fp) AS "precision" FROM ranked, k WHERE position = floor((scores + 1) * share)""", "share precision")
def pr_curve_at(spark, d):
    return evaluate.pr_curve_at(predictions(spark, d))


@query(f"""WITH {_RANKED}, k(share) AS (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)))
SELECT share, arg_min(tp / (tp + fp), tp + fp) AS "precision" FROM ranked, k
WHERE tp + fp >= ceil((all_p + all_n) * share) GROUP BY 1""", "share precision")
def precision_at_top(spark, d):
    return evaluate.precision_at_top(predictions(spark, d))


@query(f"""WITH {_RANKED} SELECT arg_max(tp / (tp + fp), score) AS "precision", max(score) AS threshold FROM ranked
WHERE tp / all_p >= CAST(0.8 AS DOUBLE)""", "precision threshold")
def precision_at_recall(spark, d):
    return evaluate.precision_at_recall(predictions(spark, d))


@query(f"""WITH {PRED}, h AS (
  SELECT asset_id, event_dt, max(CASE WHEN proba >= CAST(0.9 AS DOUBLE) THEN 1 ELSE 0 END) AS alert FROM pred
  WHERE days_to_event BETWEEN 7 AND 30 GROUP BY ALL),
j AS (SELECT alert, target FROM h JOIN pred USING (asset_id, event_dt)),
c AS (SELECT count(*) FILTER (WHERE alert = 1 AND target = 1) AS true_positive,
  count(*) FILTER (WHERE alert = 1 AND target = 0) AS false_positive,
  count(*) FILTER (WHERE alert = 0 AND target = 1) AS false_negative FROM j)
SELECT *, coalesce(true_positive / nullif(true_positive + false_positive, 0), 0) AS "precision" FROM c""", "precision")
def alert_precision(spark, d):
    return evaluate.alert_precision(predictions(spark, d), 0.9)


@query(f"""WITH {PRED}, h AS (
  SELECT asset_id, event_dt, max(CASE WHEN proba >= CAST(0.9 AS DOUBLE) THEN 1 ELSE 0 END) AS alert FROM pred
  WHERE days_to_event BETWEEN 7 AND 30 GROUP BY ALL)
SELECT count(*) AS events, count(*) FILTER (WHERE alert = 1) AS alerted, avg(alert) AS recall FROM h""", "recall")
def event_recall(spark, d):
    return evaluate.event_recall(predictions(spark, d), 0.9)


_REPORT = f"""{PRED}, inside AS (SELECT * FROM pred WHERE days_to_event BETWEEN 7 AND 30),
firsts AS (
  SELECT asset_id, event_dt, "timestamp" AS first_alert_ts, days_to_event AS lead_days, proba AS first_alert_proba
  FROM inside WHERE proba >= CAST(0.9 AS DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY asset_id, event_dt ORDER BY days_to_event DESC) = 1),
report AS (
  SELECT e.asset_id, e.event_dt, first_alert_ts, lead_days, first_alert_proba, lead_days IS NOT NULL AS detected
  FROM (SELECT DISTINCT asset_id, event_dt FROM inside WHERE target = 1) e LEFT JOIN firsts USING (asset_id, event_dt))"""


@query(f"WITH {_REPORT} SELECT * FROM report", "lead_days first_alert_proba")
def early_warning_report(spark, d):
    return evaluate.early_warning_report(predictions(spark, d), 0.9)


@query(f"""WITH {_REPORT} SELECT count(*) AS events, count(*) FILTER (WHERE detected) AS detected,
  avg(CASE WHEN detected THEN 1 ELSE 0 END) AS detection_rate, avg(lead_days) AS mean_lead_days, median(lead_days) AS median_lead_days
FROM report""", "detection_rate mean_lead_days median_lead_days")
def lead_time_summary(spark, d):
    return evaluate.lead_time_summary(evaluate.early_warning_report(predictions(spark, d), 0.9))


@query(f"""WITH {_REPORT}, f AS (SELECT asset_id, mdm_object_name, ts AS "timestamp", proba AS feature FROM wins)
SELECT f.asset_id, f.mdm_object_name, f."timestamp", f.feature, r.event_dt FROM f
JOIN (SELECT asset_id, event_dt, "timestamp", min(mdm_object_name) AS mdm_object_name FROM pred GROUP BY ALL) p USING (asset_id, mdm_object_name, "timestamp")
JOIN report r ON r.detected AND r.asset_id = p.asset_id AND r.event_dt = p.event_dt AND r.first_alert_ts = p."timestamp" """, "feature")
def alert_rows(spark, d):
    pred = predictions(spark, d)
    features = pred.select("asset_id", "mdm_object_name", "timestamp", F.col("proba").alias("feature"))
    return joins.alert_rows(features, pred, evaluate.early_warning_report(pred, 0.9))


_FACTORS = ["rail_pressure", "fuel_rate", "engine_load", "temp_engine", "pres_coolant_nn"]
_PUSH = {c: f"CAST((event_id * {11 + 6 * i}) % 41 - 20 AS DOUBLE) / 4" for i, c in enumerate(_FACTORS)}
_HINTED = [("rail_pressure", "fuel_rate", "engine_load", "temp_engine", "pres_coolant_nn"),
           ("rail_error_max", "fuel_rate_mean", "rail_diff_std", "temp_engine_max", "load")]
_KINDS = dict(zip(*_HINTED))
_MOVED = " UNION ALL ".join(f"SELECT event_id, {i} AS position, '{_KINDS[c]}' AS feature, {x} AS contribution FROM events"
                            for i, (c, x) in enumerate(_PUSH.items()))
_TOLD = {"rail_diff": "rail pressure swings more between readings", "fuel_rate": "steady work burns more fuel than it used to",
         "rail_error": "rail pressure follows its set point less closely"}


@query(f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(contribution) DESC, position) AS r FROM ({_MOVED})),
tops AS (SELECT event_id, string_agg(feature || ' (' || CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END || ')', ', ' ORDER BY r) AS factors,
  concat_ws('; ', {", ".join(f"max(CASE WHEN contains(feature, '{k}') THEN '{t}' END)" for k, t in _TOLD.items())}) AS hints
  FROM ranked WHERE r <= 3 GROUP BY 1)
SELECT event_id, 'Main factors: ' || factors || CASE WHEN hints <> '' THEN chr(10) || 'Possible reasons: ' || hints || '.' ELSE '' END AS text FROM tops""")
def alert_text(spark, d):
    """Factors, hints and text of an alert at every event, from contributions that follow from its number."""
    wide = table(spark, d, "events").select("event_id", *[F.expr(x).alias(c) for c, x in _PUSH.items()])
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(_KINDS[c]).alias("feature"), F.col(c).alias("contribution"))
                        for i, c in enumerate(_PUSH)])
    moved = wide.select("event_id", F.inline(entries))
    return risk.alert_text(risk.domain_hints(risk.top_factors(moved, ["event_id"], 3))).select("event_id", "text")


@query(f"""WITH {TELE} SELECT event_id, rail_pressure, rail_pressure_target, fuel_rate, engine_load, temp_engine, pres_coolant_nn,
  replace(event_type, 'e', '/') AS raw, replace(replace(event_type, 'e', '/'), '/', '_') AS folder,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS target FROM tele""",
       "rail_pressure rail_pressure_target fuel_rate engine_load temp_engine pres_coolant_nn")
def split_features(spark, d):
    """Numeric inputs and target apart and together again by their key; names as folders."""
    rows = trucks(spark, d).withColumn("target", F.expr("if(event_type = 'error', 1, 0)")).withColumn(
        "raw", F.regexp_replace("event_type", "e", "/"))
    rows = shaping.drop_if_present(rows, ["event_type", "no_such_column"])
    inputs, target = shaping.split_features(rows, ["event_id"])
    kept = [c for c in shaping.feature_columns(inputs, {"event_id", "asset_id", "mdm_object_name", "vehicle_speed"})]
    made = inputs.select("event_id", *kept, "raw", safe_segment("raw").alias("folder"))
    return made.join(target, "event_id")
