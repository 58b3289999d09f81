"""Scans, shaping, cleaning, filters, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigpulse.functions import columns as C
from rigpulse.functions.series import Series
from rigpulse.operators import impute, quality, shaping, stats
from rigpulse.operators.rolling import EXCAVATOR
from rigpulse.schemas import EXCAVATOR_SENSORS as S
from rigpulse.sources.readers import read_table as scan
from rigpulse.sources.readers import union_frames as union_all
from suite.registry import query
from suite.views import CLEAN, FLAGGED, TELE, events, exc_sql, excavators, table, trucks

BY_EVENT = Series(("user_id",), "ts", ("event_id",))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", "s_acctbal")
def read_table(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query('SELECT user_id AS asset_id, ts AS "timestamp", event_type AS event_name, value AS rail_pressure FROM events',
       "rail_pressure")
def canonicalize(spark, d):
    names = {"user_id": "asset_id", "ts": "timestamp", "event_type": "event_name", "value": "rail_pressure"}
    return shaping.canonicalize(events(spark, d), names).select(*names.values())


@query("""SELECT o_orderkey, o_totalprice, 'oil_pressure_drop' AS "case", 0 AS flag_invalid FROM orders
WHERE o_orderstatus IN ('F', 'P')""", "o_totalprice")
def oil_issues(spark, d):
    kept = shaping.oil_issues(table(spark, d, "orders"), "o_orderstatus", ["F", "P"])
    return kept.select("o_orderkey", "o_totalprice", F.lit("oil_pressure_drop").alias("case"),
                       F.lit(0).alias("flag_invalid"))


@query(f"WITH {exc_sql()} SELECT event_id, " + ", ".join(f"nullif({c}, -1000000) AS {c}" for c in S) + " FROM exc", S)
def null_sentinels(spark, d):
    return quality.null_sentinels(excavators(spark, d)).select("event_id", *S)


@query(f"WITH {exc_sql()}, {FLAGGED} SELECT * FROM flagged", S)
def flag_technical_values(spark, d):
    return quality.flag_technical_values(excavators(spark, d))


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS parsed,
  date_trunc('second', ts) AS parsed_strict FROM events""")
def parse_ts(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = events(spark, d).select("event_id", text.alias("good"),
                                   F.when(F.col("event_id") % 7 == 0, "bad").otherwise(text).alias("mixed"))
    return rows.select("event_id", C.parse_ts("mixed").alias("parsed"), C.parse_ts("good", strict=True).alias("parsed_strict"))


@query("""SELECT event_id, CASE WHEN event_id % 11 <> 0
  THEN TIMESTAMP '2000-01-01 00:00:00' + (date_trunc('second', ts) - date_trunc('day', ts)) END AS parsed FROM events""")
def parse_time_of_day(spark, d):
    text = F.when(F.col("event_id") % 11 == 0, "noon").otherwise(F.date_format("ts", "HH:mm:ss"))
    return events(spark, d).select("event_id", C.parse_time_of_day(text).alias("parsed"))


@query("SELECT event_id, ts AS wall_clock FROM events")
def to_naive(spark, d):
    return events(spark, d).select("event_id", C.to_naive("ts").alias("wall_clock"))


@query("""SELECT event_id, make_timestamp(500000 * (q + CASE WHEN r > 250000 OR (r = 250000 AND q % 2 = 1) THEN 1 ELSE 0 END))
  AS rounded FROM (SELECT event_id, epoch_us(ts) // 500000 AS q, epoch_us(ts) % 500000 AS r FROM events)""")
def round_ts(spark, d):
    return events(spark, d).select("event_id", C.round_ts("ts").alias("rounded"))


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS number
  FROM events""", "number")
def to_double(spark, d):
    text = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    return events(spark, d).select("event_id", C.to_double(text).alias("number"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events")
def epoch_features(spark, d):
    return events(spark, d).select("event_id", C.epoch_seconds("ts").alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 0 ELSE value END AS value FROM events", "value")
def zero_fill(spark, d):
    broken = (F.when(F.col("event_id") % 13 == 0, F.lit(float("inf")))
              .when(F.col("event_id") % 17 != 0, F.col("value")))
    return quality.zero_fill(events(spark, d).select("event_id", broken.alias("value")), ["value"])


@query("""SELECT a, b FROM (SELECT CASE WHEN event_id % 2 = 0 THEN value END AS a,
  CASE WHEN event_id % 3 = 0 THEN user_id END AS b FROM events) WHERE a IS NOT NULL OR b IS NOT NULL""", "a")
def drop_empty_rows(spark, d):
    e = F.col("event_id")
    rows = events(spark, d).select(F.when(e % 2 == 0, F.col("value")).alias("a"), F.when(e % 3 == 0, F.col("user_id")).alias("b"))
    return rows.na.drop("all")


@query(f"""WITH {exc_sql()} SELECT event_id, heading_angle_deg FROM exc WHERE heading_angle_deg IS NOT NULL""",
       "heading_angle_deg")
def drop_null_subset(spark, d):
    return excavators(spark, d).na.drop(subset=["heading_angle_deg"]).select("event_id", "heading_angle_deg")


_COMPONENT = "CASE event_id % 4 WHEN 0 THEN 'ДВИГАТЕЛЬ ' || event_type WHEN 1 THEN 'Engine' WHEN 2 THEN 'насос' END"


@query(f"""SELECT event_id, component FROM (SELECT event_id, {_COMPONENT} AS component FROM events)
WHERE coalesce(regexp_matches(component, 'двигатель|engine', 'i'), false)""")
def filter_component(spark, d):
    e = F.col("event_id") % 4
    name = F.when(e == 0, F.concat(F.lit("ДВИГАТЕЛЬ "), "event_type")).when(e == 1, "Engine").when(e == 2, "насос")
    return shaping.filter_component(events(spark, d).select("event_id", name.alias("component")), "component")


_TWICE = """twice AS (
  SELECT event_id, user_id, ts, value, 'a' AS file FROM events
  UNION ALL SELECT event_id + 1000000, user_id, ts, value + 1, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END FROM events)"""


def _twice(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts", "value", F.lit("a").alias("file"))
    copy = e.select((F.col("event_id") + 1_000_000).alias("event_id"), "user_id", "ts", (F.col("value") + 1).alias("value"),
                    F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("file"))
    return e.unionByName(copy)


@query(f"WITH {_TWICE} SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY file, user_id, ts ORDER BY event_id) = 1", "value")
def dedup_readings(spark, d):
    return shaping.dedup_readings(_twice(spark, d), ["user_id", "ts"], ["event_id"], ["file"])


@query(f"WITH {_TWICE} SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1", "value")
def dedup_table(spark, d):
    return shaping.dedup_readings(_twice(spark, d), ["user_id", "ts"], ["event_id"])


@query("""SELECT event_id, user_id FROM events
QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 = 0""")
def decimate(spark, d):
    return shaping.decimate(events(spark, d), BY_EVENT).select("event_id", "user_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_events(spark, d):
    return events(spark, d).select("user_id", "event_type").distinct()


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'fuel_degradation' WHEN 'view' THEN 'turbo' END AS "case" FROM events""")
def map_values(spark, d):
    return shaping.map_values(events(spark, d), "event_type", {"error": "fuel_degradation", "view": "turbo"}, "case").select(
        "event_id", "case")


@query("""SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""", "balance")
def union_frames(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
                                           F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return union_all([a, b])


@query("""SELECT CASE WHEN event_id % 3 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type
FROM events WHERE event_id % 6 <> 3""")
def prune_columns(spark, d):
    """A third of the rows hold only the saved index, half of those not even that."""
    def given(c):
        return F.when(F.col("event_id") % 3 > 0, c)

    rows = events(spark, d).select(
        given(F.col("user_id")).alias(" user_id "), given(F.col("event_type")).alias("event_type"),
        given(F.lit(1)).alias("constant"), F.lit(None).cast("double").alias("empty"),
        F.when(F.col("event_id") % 6 != 3, F.col("event_id")).alias("Unnamed: 0"))
    return shaping.clean_frame(rows)


_HOLES = """holes AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN value END AS value FROM events)"""


def _holes(spark, d):
    return events(spark, d).select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value"))


@query(f"""WITH {_HOLES},
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM holes),
near AS (SELECT *, CASE WHEN value IS NOT NULL THEN rn END AS rk FROM numbered),
sides AS (
  SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(rk IGNORE NULLS) OVER b AS r0,
    first_value(value IGNORE NULLS) OVER a AS v1, first_value(rk IGNORE NULLS) OVER a AS r1
  FROM near WINDOW
    b AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, user_id, CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * (rn - r0) / (r1 - r0) END AS value FROM sides""", "value")
def interpolate_linear(spark, d):
    return impute.interpolate_linear(_holes(spark, d), BY_EVENT, ["value"]).select("event_id", "user_id", "value")


@query(f"WITH {exc_sql()}, {FLAGGED}, {CLEAN} SELECT * FROM clean", S)
def fill_forward_backward(spark, d):
    flagged = quality.flag_technical_values(excavators(spark, d))
    unique = shaping.dedup_readings(flagged, ["excavator_id", "timestamp"], ["event_id"])
    return impute.fill_forward_backward(unique, EXCAVATOR, S)


@query("""WITH h AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS b, user_id AS c, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 2 AS INTEGER) END AS y
  FROM events),
m AS (SELECT median(a) AS ma, median(b) AS mb FROM h),
t AS (SELECT y AS my FROM h WHERE y IS NOT NULL GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
SELECT event_id, coalesce(a, ma) AS a, coalesce(b, mb) AS b, c, coalesce(y, my) AS y,
  CASE WHEN a IS NULL THEN 1 ELSE 0 END AS a_is_missing, CASE WHEN b IS NULL THEN 1 ELSE 0 END AS b_is_missing
FROM h, m, t""", "a b")
def impute_with_flags(spark, d):
    e = F.col("event_id")
    rows = events(spark, d).select(
        "event_id", F.when(e % 4 != 0, F.col("value")).alias("a"), F.when(e % 5 != 0, F.col("k")).alias("b"),
        F.col("user_id").alias("c"), F.when(e % 6 != 0, (e % 2).cast("int")).alias("y"))
    return impute.impute_with_flags(rows, ["a", "b", "c"], "y")


@query(f"""WITH {_HOLES} SELECT event_id, user_id, ts, coalesce(value, (SELECT median(value) FROM holes)) AS value FROM holes""", "value")
def impute_median(spark, d):
    return impute.impute_median(_holes(spark, d), ["value"])


@query(f"""WITH {_HOLES}, m AS (SELECT user_id, median(value) AS med FROM holes GROUP BY 1)
SELECT event_id, user_id, ts, coalesce(value, med) AS value FROM holes LEFT JOIN m USING (user_id)""", "value")
def fill_with_group_median(spark, d):
    return impute.fill_with_group_median(_holes(spark, d), ["user_id"], "value")


@query(f"""WITH {TELE}, c AS (SELECT asset_id, rail_pressure, CASE WHEN vehicle_speed > 1 THEN engine_load END AS engine_load, event_type FROM tele)
SELECT * FROM (VALUES ('asset_id', (SELECT count(*) FROM c WHERE asset_id IS NULL)),
  ('rail_pressure', (SELECT count(*) FROM c WHERE rail_pressure IS NULL)),
  ('engine_load', (SELECT count(*) FROM c WHERE engine_load IS NULL))) AS t("column", nulls)""")
def null_profile(spark, d):
    rows = trucks(spark, d).withColumn("engine_load", F.when(F.col("vehicle_speed") > 1, F.col("engine_load")))
    return stats.null_profile(rows, ["asset_id", "rail_pressure", "engine_load"])


@query("""SELECT 'event_type' AS "column", count(DISTINCT event_type) AS "distinct", count(*) AS "rows",
  count(DISTINCT event_type) / count(*) AS ratio FROM events
UNION ALL SELECT 'user_id', count(DISTINCT user_id), count(*), count(DISTINCT user_id) / count(*) FROM events
UNION ALL SELECT 'value', count(DISTINCT value), count(*), count(DISTINCT value) / count(*) FROM events""", "ratio")
def distinct_profile(spark, d):
    return stats.distinct_profile(events(spark, d), ["event_type", "user_id", "value"])
