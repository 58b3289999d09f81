"""Excavators: features, statistics, scores, episodes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from rigpulse.functions.series import Series
from rigpulse.operators import episodes as E
from rigpulse.operators import physics, rolling, scoring, stats
from rigpulse.operators.rolling import EXCAVATOR, TRAILING, sliding_names
from rigpulse.plans import excavators as plan
from rigpulse.schemas import EXCAVATOR_SENSORS as S
from rigpulse.schemas import FEATURE_TITLES
from suite.registry import query
from suite.views import (CFG, CLEAN, FLAGGED, REGIMES, TELE, exc_sql, excavators, healthy_sql, sliding_sql, table,
                         trucks)

FIVE = "user_id % 5"
# many test features are constant; a floor well above rounding noise keeps their deviations comparable
FLOOR = 1e-3
STAT_CFG = replace(CFG, forest_weight=0.0, stat_weight=1.0, mad_floor=FLOOR)
_CLEAN5 = f"{exc_sql(FIVE)}, {FLAGGED}, {CLEAN}"
_CLEAN = f"{exc_sql()}, {FLAGGED}, {CLEAN}"


def clean(spark, d, machine=FIVE):
    return plan.clean_readings(excavators(spark, d, machine), ["event_id"])


def regimes(spark, d, machine=FIVE):
    return rolling.label_regime(clean(spark, d, machine), CFG)


@query(f"WITH {_CLEAN} SELECT event_id, " + ", ".join(
    f"lag({c}, {n}) OVER w AS {c}_shift_{n}, {c} - lag({c}, {n}) OVER w AS {c}_diff_{n}" for c in S for n in (1, 2, 3))
    + ' FROM clean WINDOW w AS (PARTITION BY excavator_id ORDER BY "timestamp")',
    [f"{c}_{k}_{n}" for c in S for n in (1, 2, 3) for k in ("shift", "diff")])
def lag_features(spark, d):
    rows = rolling.lag_features(clean(spark, d, "user_id"), EXCAVATOR)
    return rows.drop("excavator_id", "timestamp", "flag_invalid", *S)


def _trail(c, fn, n):
    f = {"mean": "avg", "std": "stddev_samp", "max": "max"}[fn]
    frame = f'(PARTITION BY excavator_id ORDER BY "timestamp" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'
    return f"CASE WHEN count({c}) OVER {frame} >= {n} THEN {f}({c}) OVER {frame} END"


@query(f"WITH {_CLEAN5} SELECT event_id, " + ", ".join(f"{_trail(c, fn, n)} AS {name}" for name, (c, fn, n, _) in TRAILING.items())
       + " FROM clean", list(TRAILING))
def rolling_features(spark, d):
    return rolling.rolling(clean(spark, d), Series(("excavator_id",), block_rows=500), TRAILING).select("event_id", *TRAILING)


_MIX = {"speed_direction_ratio": "gps_speed_kmh / (heading_angle_deg + CAST(1e-5 AS DOUBLE))",
        "platform_inclination_diff": "platform_inclination_x_deg - platform_inclination_y_deg",
        "speed_inclination_interaction": "gps_speed_kmh * platform_inclination_x_deg",
        "speed_heading_interaction": "gps_speed_kmh * heading_angle_deg"}


@query(f"WITH {_CLEAN} SELECT event_id, " + ", ".join(f"{x} AS {n}" for n, x in _MIX.items()) + " FROM clean", list(_MIX))
def interaction_features(spark, d):
    return rolling.interaction_features(clean(spark, d, "user_id")).select("event_id", *_MIX)


_LAGS = {f"{c}_{kind}_{n}": f"{sign}lag({c}, {n}) OVER m" for c in S for n in (1, 2, 3)
         for kind, sign in (("shift", ""), ("diff", f"{c} - "))}
_MORE = {**_LAGS, **{name: _trail(c, fn, n) for name, (c, fn, n, _) in TRAILING.items()}, **_MIX}


@query(f"WITH {_CLEAN5}, made AS (SELECT event_id, flag_invalid, {', '.join(S)}, " + ", ".join(f"{x} AS {n}" for n, x in _MORE.items())
       + ' FROM clean WINDOW m AS (PARTITION BY excavator_id ORDER BY "timestamp")) SELECT event_id, ' + ", ".join(_MORE)
       + " FROM made WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in [*S, *_MORE]), list(_MORE))
def additional_features(spark, d):
    return rolling.additional_features(clean(spark, d)).select("event_id", *_MORE)


@query(f"WITH {_CLEAN}, {REGIMES} SELECT event_id, regime_motion, regime_work, regime FROM reg")
def label_regime(spark, d):
    return regimes(spark, d, "user_id").select("event_id", "regime_motion", "regime_work", "regime")


@query("""SELECT l_suppkey, CASE WHEN m IS NULL THEN 5 ELSE CAST(trunc(least(greatest(m, 1), 60)) AS INTEGER) END AS step FROM (
  SELECT l_suppkey, median(gap) AS m FROM (
    SELECT l_suppkey, (epoch_us(seen) - lag(epoch_us(seen)) OVER (PARTITION BY l_suppkey ORDER BY seen, l_orderkey, l_linenumber))
      / CAST(1000000 AS DOUBLE) AS gap
    FROM (SELECT *, make_timestamp(1704067200000000 + l_orderkey * (l_suppkey % 7) * 300000) AS seen FROM lineitem)) GROUP BY 1)""")
def sampling_step(spark, d):
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("l_orderkey") * (F.col("l_suppkey") % 7) * 300000)
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", at.alias("at"))
    return rolling.sampling_step(rows, Series(("l_suppkey",), "at", ("l_orderkey", "l_linenumber")))


@query(f"WITH {_CLEAN}, {REGIMES}, {sliding_sql('reg')} SELECT event_id, {', '.join(sliding_names(CFG))} FROM sliding",
       sliding_names(CFG), digits=8)
def sliding_features(spark, d):
    labeled = plan.materialize(regimes(spark, d, "user_id"))
    stepped = plan.materialize(labeled.join(rolling.sampling_step(labeled), "excavator_id"))
    return rolling.sliding_features(stepped, CFG).select("event_id", *sliding_names(CFG))


_MARKED = healthy_sql(CFG.healthy_days, CFG.min_healthy_rows)


@query(f"WITH {_CLEAN5}, {REGIMES}, {_MARKED} SELECT event_id, CAST(is_train AS INTEGER) AS is_train FROM marked")
def healthy_proxy(spark, d):
    return rolling.healthy_proxy(regimes(spark, d), CFG).select("event_id", "is_train")


# statistics

@query("""SELECT * FROM (VALUES ('value', (SELECT count(value) FROM events)), ('user_id', (SELECT count(user_id) FROM events))) t("column", "count")
JOIN (SELECT 'value' AS "column", avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.1) AS p10,
    quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
    quantile_cont(value, 0.9) AS p90, max(value) AS max FROM events
  UNION ALL SELECT 'user_id', avg(u), stddev_samp(u), min(u), quantile_cont(u, 0.1), quantile_cont(u, 0.25), quantile_cont(u, 0.5),
    quantile_cont(u, 0.75), quantile_cont(u, 0.9), max(u) FROM (SELECT CAST(user_id AS DOUBLE) AS u FROM events)) USING ("column")""",
       "mean std min p10 p25 p50 p75 p90 max")
def describe(spark, d):
    return stats.describe(table(spark, d, "events"), ["value", "user_id"], (0.1, 0.25, 0.5, 0.75, 0.9))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "part"), "p_type")


@query("SELECT DISTINCT event_type FROM events")
def unique_values(spark, d):
    return stats.unique_values(table(spark, d, "events"), "event_type")


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def mode_min(spark, d):
    shown = table(spark, d, "events").withColumn("event_type", F.expr("nullif(event_type, 'view')"))
    return stats.mode_min(shown, ["user_id"], "event_type")


_MAD = """meds AS (SELECT l_suppkey, median(l_quantity) AS l_quantity_median, median(l_extendedprice) AS l_extendedprice_median FROM lineitem GROUP BY 1),
mads AS (SELECT l_suppkey, median(abs(l_quantity - l_quantity_median)) AS q, median(abs(l_extendedprice - l_extendedprice_median)) AS e
  FROM lineitem JOIN meds USING (l_suppkey) GROUP BY 1)"""
_MAD_NAMES = "l_quantity_median l_quantity_mad l_extendedprice_median l_extendedprice_mad"


@query(f"""WITH {_MAD} SELECT l_suppkey, l_quantity_median, q + CAST(1e-9 AS DOUBLE) AS l_quantity_mad, l_extendedprice_median,
  e + CAST(1e-9 AS DOUBLE) AS l_extendedprice_mad FROM meds JOIN mads USING (l_suppkey)""", _MAD_NAMES)
def mad_stats(spark, d):
    return stats.mad_stats(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice"])


@query(f"""WITH {_MAD} SELECT l_suppkey, l_quantity_median, greatest(q * CAST(1.4826 AS DOUBLE), CAST(1e-9 AS DOUBLE)) AS l_quantity_mad,
  l_extendedprice_median, greatest(e * CAST(1.4826 AS DOUBLE), CAST(1e-9 AS DOUBLE)) AS l_extendedprice_mad
FROM meds JOIN mads USING (l_suppkey)""", _MAD_NAMES)
def mad_stats_scaled(spark, d):
    return stats.mad_stats(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice"], scaled=True)


@query("SELECT event_type, quantile_cont(value, CAST(0.995 AS DOUBLE)) AS threshold FROM events GROUP BY 1", "threshold")
def quantile_threshold(spark, d):
    return stats.quantile_threshold(table(spark, d, "events"), ["event_type"], "value", 0.995)


@query("""SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""", "value")
def iqr_outliers(spark, d):
    return stats.iqr_outliers(table(spark, d, "events"), "value").select("event_id", "value")


@query("""SELECT event_id, (value - m) / s AS value_zscore FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
WHERE abs((value - m) / s) > 3""", "value_zscore")
def zscore_outliers(spark, d):
    return stats.zscore_outliers(table(spark, d, "events"), "value").select("event_id", "value_zscore")


_SCALED = ["gps_speed_kmh", "platform_inclination_y_deg"]


@query(f"WITH {_CLEAN} SELECT event_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in S) + " FROM clean", S)
def standardize(spark, d):
    return stats.standardize(clean(spark, d, "user_id"), S).select("event_id", *S)


@query(f"WITH {_CLEAN5} SELECT event_id, " + ", ".join(
    f"({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) AS {c}" for c in S)
    + " FROM clean WINDOW w AS (PARTITION BY excavator_id)", S)
def min_max_scale(spark, d):
    return stats.min_max_scale(clean(spark, d), S, ["excavator_id"]).select("event_id", *S)


@query(f"WITH {_CLEAN5}, {REGIMES}, q AS (SELECT excavator_id, regime, " + ", ".join(
    f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in S)
    + " FROM reg GROUP BY ALL) SELECT event_id, " + ", ".join(
    f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in S) + " FROM reg JOIN q USING (excavator_id, regime)", S)
def robust_scale(spark, d):
    return stats.robust_scale(regimes(spark, d), S, ["excavator_id", "regime"]).select("event_id", *S)


@query("""WITH m AS (SELECT user_id, median(value) FILTER (WHERE event_id % 2 = 0) AS med FROM events GROUP BY 1),
a AS (SELECT user_id, med, median(abs(value - med)) FILTER (WHERE event_id % 2 = 0) + CAST(1e-9 AS DOUBLE) AS mad FROM events JOIN m USING (user_id) GROUP BY ALL)
SELECT event_id, (value - med) / mad AS score_norm FROM events JOIN a USING (user_id)""", "score_norm")
def robust_normalize(spark, d):
    half = F.when(F.col("event_id") % 2 == 0, F.col("value"))
    return stats.robust_normalize(table(spark, d, "events"), ["user_id"], "value", half, "score_norm").select("event_id", "score_norm")


# a value of each of the 15 rated quantities for every reading, on both sides of its limits
_RATED = [*physics.PHYSICAL_LIMITS, *physics.NONZERO]
_VALUES = {f: f"CAST((event_id * {7 + 2 * i}) % 301 - 150 AS DOUBLE) / {1 + i % 7}" for i, f in enumerate(_RATED)}
_LIMITS = ", ".join(f"('{f}', CAST('{a}' AS DOUBLE), CAST('{b}' AS DOUBLE))" for f, (a, b) in physics.PHYSICAL_LIMITS.items())


@query(f"""WITH wide AS (SELECT event_id, {", ".join(f"{x} AS {f}" for f, x in _VALUES.items())} FROM events),
long AS (UNPIVOT wide ON {", ".join(_RATED)} INTO NAME feature VALUE value),
limits AS (SELECT * FROM (VALUES {_LIMITS}) t(feature, low, high))
SELECT event_id, feature, value, CASE WHEN CASE WHEN feature IN ('lat', 'lon') THEN value <> 0 ELSE value BETWEEN low AND high END
  THEN 'real_anomaly' ELSE 'sensor_error' END AS outlier_class FROM long LEFT JOIN limits USING (feature)""", "value")
def classify_outliers(spark, d):
    wide = table(spark, d, "events").select("event_id", *[F.expr(x).alias(f) for f, x in _VALUES.items()])
    return physics.classify_outliers(wide.unpivot(["event_id"], _RATED, "feature", "value"))


# scores

_NAMES = [*S, *sliding_names(CFG)]
_K = max(3, int(0.1 * len(_NAMES)))

_STAT = f"""{_CLEAN5}, {REGIMES}, {_MARKED}, {sliding_sql('marked')},
long AS (UNPIVOT (SELECT event_id, excavator_id, is_train, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _NAMES)} FROM sliding)
  ON {", ".join(_NAMES)} INTO NAME f VALUE x),
med AS (SELECT excavator_id, f, median(x) AS m, median(x) FILTER (WHERE is_train) AS mt FROM long GROUP BY ALL),
mad AS (SELECT excavator_id, f, m, mt, median(abs(x - m)) + CAST({FLOOR} AS DOUBLE) AS d,
    median(abs(x - mt)) FILTER (WHERE is_train) + CAST({FLOOR} AS DOUBLE) AS dt
  FROM long JOIN med USING (excavator_id, f) GROUP BY ALL),
rz AS (SELECT event_id, is_train, abs(x - m) / d AS z, abs(x - mt) / dt AS zt FROM long JOIN mad USING (excavator_id, f)),
stat_all AS (SELECT event_id, avg(z) AS anomaly_score_stat FROM (
  SELECT event_id, z, row_number() OVER (PARTITION BY event_id ORDER BY z DESC) AS r FROM rz) WHERE r <= {_K} GROUP BY 1),
stat_train AS (SELECT event_id, avg(zt) AS stat_train FROM (
  SELECT event_id, zt, row_number() OVER (PARTITION BY event_id ORDER BY zt DESC) AS r FROM rz WHERE is_train) WHERE r <= {_K} GROUP BY 1),
scored AS (SELECT s.event_id, excavator_id, "timestamp", flag_invalid, regime, is_train, anomaly_score_stat, stat_train
  FROM sliding s JOIN stat_all USING (event_id) LEFT JOIN stat_train USING (event_id))"""


@query(f"WITH {_STAT} SELECT event_id, anomaly_score_stat, stat_train FROM scored", "anomaly_score_stat stat_train")
def robust_stat_score(spark, d):
    features = plan.feature_table(plan.materialize(clean(spark, d)), CFG)
    made = scoring.robust_stat_score(plan.materialize(features), ["excavator_id"], _NAMES,
                                     {"anomaly_score_stat": F.lit(True), "stat_train": F.col("is_train") == 1}, STAT_CFG.mad_floor, ["event_id"])
    return made.select("event_id", "anomaly_score_stat", "stat_train")


_Q = f"CAST({CFG.score_quantile} AS DOUBLE)"
_W = 10
_LABELED = f"""{_STAT},
ref AS (SELECT excavator_id, median(stat_train) AS rm FROM scored GROUP BY 1),
refd AS (SELECT excavator_id, rm, median(abs(stat_train - rm)) + CAST({FLOOR} AS DOUBLE) AS rd FROM scored JOIN ref USING (excavator_id) GROUP BY ALL),
norm AS (SELECT s.*, (anomaly_score_stat - rm) / rd AS anomaly_score, (stat_train - rm) / rd AS train_score FROM scored s JOIN refd USING (excavator_id)),
local AS (SELECT excavator_id, regime, quantile_cont(train_score, {_Q}) AS lt FROM norm WHERE is_train GROUP BY ALL HAVING count(*) >= {CFG.min_regime_rows}),
overall AS (SELECT excavator_id, quantile_cont(train_score, {_Q}) AS gt FROM norm WHERE is_train GROUP BY 1),
thr AS (SELECT n.*, coalesce(lt, gt) AS threshold, gt FROM norm n LEFT JOIN local USING (excavator_id, regime) LEFT JOIN overall USING (excavator_id)),
roll AS (SELECT *, CASE WHEN count(anomaly_score) OVER w >= 3 THEN avg(anomaly_score) OVER w END AS anomaly_score_episode FROM thr
  WINDOW w AS (PARTITION BY excavator_id ORDER BY "timestamp" ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW)),
final AS (SELECT event_id, excavator_id, "timestamp", flag_invalid, regime, anomaly_score_stat, anomaly_score, threshold,
    CASE WHEN anomaly_score > threshold THEN 1 ELSE 0 END AS anomaly_point, anomaly_score_episode,
    CASE WHEN coalesce(anomaly_score_episode > gt, false) THEN 1 ELSE 0 END AS anomaly_episode FROM roll)"""
_FINAL = ["event_id", "excavator_id", "timestamp", "flag_invalid", "regime", "anomaly_score_stat", "anomaly_score", "threshold",
          "anomaly_point", "anomaly_score_episode", "anomaly_episode"]


def stat_scored(spark, d):
    return plan.score_excavators(excavators(spark, d, FIVE), STAT_CFG, ["event_id"])


@query(f"WITH {_LABELED} SELECT * FROM final", "anomaly_score_stat anomaly_score threshold anomaly_score_episode")
def score_excavators_stat(spark, d):
    return stat_scored(spark, d).select(*_FINAL)


@query(f"""WITH {_LABELED} SELECT excavator_id, regime, count(*) AS n_rows, CAST(sum(anomaly_point) AS BIGINT) AS n_points,
  CAST(sum(anomaly_episode) AS BIGINT) AS n_episode_rows, max(anomaly_score) AS max_score, avg(anomaly_point) AS point_share
FROM final GROUP BY ALL""", "max_score point_share")
def fleet_summary(spark, d):
    return E.fleet_summary(stat_scored(spark, d))


@query("""WITH g AS (SELECT user_id % 5 AS machine, event_type, quantile_cont(value, CAST(0.9 AS DOUBLE)) AS lt FROM events GROUP BY ALL HAVING count(*) >= 300),
o AS (SELECT user_id % 5 AS machine, quantile_cont(value, CAST(0.9 AS DOUBLE)) AS gt FROM events GROUP BY 1)
SELECT event_id, coalesce(lt, gt) AS threshold, CASE WHEN value > coalesce(lt, gt) THEN 1 ELSE 0 END AS anomaly_point
FROM (SELECT *, user_id % 5 AS machine FROM events) e LEFT JOIN g USING (machine, event_type) LEFT JOIN o USING (machine)""", "threshold")
def regime_thresholds(spark, d):
    rows = table(spark, d, "events").withColumn("machine", F.col("user_id") % 5)
    local, overall = scoring.regime_thresholds(rows, ["machine"], "value", 0.9, 300, "event_type")
    return scoring.flag_anomalies(scoring.attach_thresholds(rows, local, overall, ["machine"], "event_type"), "value").select(
        "event_id", "threshold", "anomaly_point")


@query(f"""WITH {_CLEAN5} SELECT event_id, CASE WHEN count(*) OVER w >= 6 THEN avg(CAST(event_id % 7 = 0 AS INTEGER)) OVER w END AS anomaly_density
FROM clean WINDOW w AS (PARTITION BY excavator_id ORDER BY "timestamp" ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "anomaly_density")
def anomaly_density(spark, d):
    rows = clean(spark, d).withColumn("anomaly_point", (F.col("event_id") % 7 == 0).cast("int"))
    return rolling.anomaly_density(rows, 20).select("event_id", "anomaly_density")


@query(f"""WITH {_CLEAN5}, s AS (SELECT event_id, excavator_id, "timestamp", CASE WHEN event_id % 9 <> 0 THEN gps_speed_kmh END AS v FROM clean),
f AS (SELECT s.*, coalesce(v, m) AS x FROM s JOIN (SELECT excavator_id, median(v) AS m FROM s GROUP BY 1) USING (excavator_id))
SELECT event_id, CASE WHEN count(x) OVER w >= 3 THEN avg(x) OVER w END AS anomaly_score_episode
FROM f WINDOW w AS (PARTITION BY excavator_id ORDER BY "timestamp" ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "anomaly_score_episode")
def episode_score(spark, d):
    rows = clean(spark, d).withColumn("anomaly_score", F.when(F.col("event_id") % 9 != 0, F.col("gps_speed_kmh")))
    return rolling.episode_score(rows.withColumn("step", F.lit(60)), CFG).select("event_id", "anomaly_score_episode")


# episodes on fixed labels

_EP = f"""{_CLEAN5}, {REGIMES},
pts0 AS (SELECT *, CASE WHEN (event_id // 60) % 5 = 0 THEN 1 ELSE 0 END AS anomaly_episode,
  CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS anomaly_point FROM reg),
pts1 AS (SELECT *, CASE WHEN anomaly_episode = 1 AND coalesce(lag(anomaly_episode) OVER (PARTITION BY excavator_id ORDER BY "timestamp"), 0) = 0
  THEN 1 ELSE 0 END AS st FROM pts0),
pts AS (SELECT * EXCLUDE (st), CASE WHEN anomaly_episode = 1 THEN CAST(sum(st) OVER (PARTITION BY excavator_id ORDER BY "timestamp"
  ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS episode_id FROM pts1)"""


def labelled_points(spark, d):
    rows = regimes(spark, d).withColumn("anomaly_episode", F.expr("if((event_id div 60) % 5 = 0, 1, 0)")).withColumn(
        "anomaly_point", F.expr("if(event_id % 29 = 0, 1, 0)"))
    return E.assign_episode_id(rows)


@query(f"WITH {_EP} SELECT event_id, excavator_id, episode_id FROM pts")
def assign_episode_id(spark, d):
    return labelled_points(spark, d).select("event_id", "excavator_id", "episode_id")


@query(f"""WITH {_EP} SELECT excavator_id, episode_id, min("timestamp") AS start_ts, max("timestamp") AS end_ts, count(*) AS n_points
FROM pts WHERE episode_id > 0 GROUP BY ALL""")
def episode_intervals(spark, d):
    return E.episode_intervals(labelled_points(spark, d))


_SUM = f"""{_EP},
modes AS (SELECT excavator_id, episode_id, regime FROM (SELECT excavator_id, episode_id, regime, count(*) AS n FROM pts WHERE episode_id > 0 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY excavator_id, episode_id ORDER BY n DESC, regime) = 1),
summ AS (SELECT e.*, regime, (epoch_us(end_ts) - epoch_us(start_ts)) / CAST(1000000 AS DOUBLE) AS duration_s FROM (
    SELECT excavator_id, episode_id, min("timestamp") AS start_ts, max("timestamp") AS end_ts, count(*) AS n_points
    FROM pts WHERE episode_id > 0 GROUP BY ALL HAVING count(*) >= 5) e JOIN modes USING (excavator_id, episode_id))"""


@query(f"WITH {_SUM} SELECT * FROM summ", "duration_s")
def episode_summary(spark, d):
    return E.episode_summary(labelled_points(spark, d))


_BASELINE = f"""{_SUM},
lv AS (SELECT s.excavator_id, s.episode_id, s.regime, s.start_ts, CASE WHEN count(p.event_id) FILTER (WHERE p."timestamp" >= s.start_ts - INTERVAL 7 DAY) > 0 THEN 1
    WHEN count(p.event_id) > 0 THEN 2 ELSE 3 END AS level
  FROM summ s LEFT JOIN pts p ON p.excavator_id = s.excavator_id AND p.regime = s.regime AND p."timestamp" < s.start_ts GROUP BY ALL),
base AS (SELECT l.excavator_id, l.episode_id, l.level, p."timestamp", {", ".join("p." + c for c in S)}
  FROM lv l JOIN pts p ON p.excavator_id = l.excavator_id AND p.regime = l.regime
    AND (l.level = 3 OR p."timestamp" < l.start_ts) AND (l.level > 1 OR p."timestamp" >= l.start_ts - INTERVAL 7 DAY))"""


def _episodes(spark, d):
    points = plan.materialize(labelled_points(spark, d))
    return points, plan.materialize(E.episode_summary(points))


@query(f"WITH {_BASELINE} SELECT * FROM base", S)
def episode_baseline(spark, d):
    return E.episode_baseline(*_episodes(spark, d))


def _arms(template: str) -> str:
    return " UNION ALL ".join(template.format(i=i, c=c) for i, c in enumerate(S))


_CONTRIB = f"""{_BASELINE},
blong AS ({_arms("SELECT excavator_id, episode_id, {i} AS position, '{c}' AS feature, {c} AS x FROM base")}),
plong AS ({_arms("SELECT excavator_id, episode_id, {i} AS position, " + '"timestamp"' + ", {c} AS x FROM pts WHERE episode_id > 0")}),
bm AS (SELECT excavator_id, episode_id, position, feature, median(x) AS bmed FROM blong GROUP BY ALL),
bs AS (SELECT b.excavator_id, b.episode_id, b.position, b.feature, bmed, greatest(median(abs(x - bmed)) * CAST(1.4826 AS DOUBLE), CAST({FLOOR} AS DOUBLE)) AS bmad
  FROM blong b JOIN bm USING (excavator_id, episode_id, position) GROUP BY ALL),
cz AS (SELECT excavator_id, episode_id, position, feature, avg(abs((x - bmed) / bmad)) AS score, median(x) AS episode_median,
    bmed AS baseline_median, bmad AS baseline_mad FROM bs JOIN plong USING (excavator_id, episode_id, position) GROUP BY ALL),
contrib AS (SELECT *, CAST(row_number() OVER (PARTITION BY excavator_id, episode_id ORDER BY round(score, 9) DESC, position) AS INTEGER) AS "rank",
    episode_median - baseline_median AS delta, (episode_median - baseline_median) / baseline_mad AS sigma,
    CASE WHEN episode_median - baseline_median > 0 THEN 'up' ELSE 'down' END AS direction FROM cz)"""


@query(f"WITH {_CONTRIB} SELECT * FROM contrib", "score episode_median baseline_median baseline_mad delta sigma")
def episode_contributions(spark, d):
    return E.episode_contributions(*_episodes(spark, d), floor=FLOOR)


@query(f'WITH {_CONTRIB} SELECT excavator_id, episode_id, "rank", feature, score FROM contrib WHERE "rank" <= 3', "score")
def top_contributions(spark, d):
    made = E.episode_contributions(*_episodes(spark, d), floor=FLOOR)
    return E.top_contributions(made).select("excavator_id", "episode_id", "rank", "feature", "score")


_EXAMPLES = f"""{_CONTRIB}, tops AS (SELECT * FROM contrib WHERE "rank" <= 3),
tot AS (SELECT excavator_id, episode_id, "timestamp", sum(coalesce(abs((x - baseline_median) / baseline_mad), 0)) AS total
  FROM plong JOIN tops USING (excavator_id, episode_id, position) GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY excavator_id, episode_id ORDER BY round(total, 9) DESC, "timestamp") AS INTEGER) AS example FROM tot),
shown AS (SELECT excavator_id, episode_id, example, "timestamp", "rank", feature, x AS value, baseline_median, x - baseline_median AS delta,
    (x - baseline_median) / baseline_mad AS sigma
  FROM best JOIN tops USING (excavator_id, episode_id) JOIN plong USING (excavator_id, episode_id, position, "timestamp") WHERE example <= 2)"""


@query(f"WITH {_EXAMPLES} SELECT * FROM shown", "value baseline_median delta sigma")
def episode_examples(spark, d):
    points, episodes = _episodes(spark, d)
    return E.episode_examples(points, plan.materialize(E.episode_contributions(points, episodes, floor=FLOOR)))


@query(f"""WITH {_EP}, half AS (SELECT * FROM pts QUALIFY (row_number() OVER (PARTITION BY excavator_id ORDER BY "timestamp") - 1) % 2 = 0)
UNPIVOT (SELECT excavator_id, "timestamp", episode_id, anomaly_point, {", ".join(S)} FROM half) ON {", ".join(S)} INTO NAME feature VALUE value""", "value")
def chart_series(spark, d):
    return E.chart_series(labelled_points(spark, d))


def _digits(x: str, signed: bool = False) -> str:
    """Three significant digits in SQL."""
    unit = f"pow(CAST(10 AS DOUBLE), abs(2 - floor(log10(abs({x})) + CAST(1e-9 AS DOUBLE))))"
    half = "CAST(0.5000001 AS DOUBLE)"
    kept = (f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) WHEN abs({x}) < 1000 THEN floor(abs({x}) * {unit} + {half}) / {unit} "
            f"ELSE floor(abs({x}) / {unit} + {half}) * {unit} END")
    shown = f"regexp_replace(CAST(CAST({kept} AS DECIMAL(38, 12)) AS VARCHAR), '\\.?0+$', '')"
    return f"coalesce(CASE WHEN {x} < 0 THEN '-' ELSE '{'+' if signed else ''}' END || {shown}, 'unknown')"


_TITLE = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in FEATURE_TITLES.items()) + " ELSE feature END"
_LINE = (f"{_TITLE} || ' ' || {_digits('episode_median')} || ' against a usual ' || {_digits('baseline_median')} || ': ' || "
         f"{_digits('delta', True)} || ' (' || direction || '), ' || {_digits('sigma', True)} || ' deviations'")


@query(f"""WITH {_CONTRIB} SELECT excavator_id, episode_id, "rank", feature, direction, {_LINE} AS text FROM contrib""")
def format_report(spark, d):
    lines = E.format_report(E.episode_contributions(*_episodes(spark, d), floor=FLOOR))
    return lines.select("excavator_id", "episode_id", "rank", "feature", "direction", "text")


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_READING = (f"""'Reading ' || example || ' at ' || {_STAMP.format('"timestamp"')} || ': ' || {_TITLE} || ' ' || {_digits('value')} """
            f"|| ' (' || {_digits('delta', True)} || ', ' || {_digits('sigma', True)} || ' deviations)'")


@query(f"""WITH {_EXAMPLES},
heads AS (SELECT excavator_id, episode_id, string_agg({_LINE}, chr(10) ORDER BY "rank") AS lines FROM tops GROUP BY ALL),
tails AS (SELECT excavator_id, episode_id, string_agg({_READING}, chr(10) ORDER BY example, "rank") AS lines FROM shown GROUP BY ALL)
SELECT excavator_id, episode_id, concat_ws(chr(10), 'Episode ' || episode_id || ': ' || {_STAMP.format('start_ts')} || ' to ' ||
  {_STAMP.format('end_ts')} || ', regime ' || coalesce(regime, 'unknown') || ', ' || n_points || ' readings', heads.lines, tails.lines) AS text
FROM summ LEFT JOIN heads USING (excavator_id, episode_id) LEFT JOIN tails USING (excavator_id, episode_id)""")
def episode_reports(spark, d):
    points, episodes = _episodes(spark, d)
    made = plan.materialize(E.episode_contributions(points, episodes, floor=FLOOR))
    return E.episode_reports(episodes, made, E.episode_examples(points, made))


@query(f"""WITH {TELE}, f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['rail_diff_std', 'fuel_rate_mean'] WHEN 1 THEN ['rail_error_max'] ELSE ['temp_engine_max'] END AS factors FROM tele)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'rail pressure swings more between readings; steady work burns more fuel than it used to'
  WHEN 1 THEN 'rail pressure follows its set point less closely' ELSE '' END AS hints FROM f""")
def domain_hints(spark, d):
    from rigpulse.operators.risk import domain_hints as hints
    e = F.col("event_id") % 3
    kinds = F.when(e == 0, F.array(F.lit("rail_diff_std"), F.lit("fuel_rate_mean"))).when(e == 1, F.array(F.lit("rail_error_max"))).otherwise(
        F.array(F.lit("temp_engine_max")))
    return hints(trucks(spark, d).select("event_id", kinds.alias("factors"))).select("event_id", "hints")
