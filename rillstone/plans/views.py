"""Sensor views over the driver tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.timeslots import floor_time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("station_id"),
        F.col("event_type").alias("direction"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("flow"),
        (F.col("k") / F.lit(100.0)).alias("occupancy"),
        (F.col("value") / (F.col("k") + 1)).alias("speed"),
        (F.col("value") > 150).alias("mask_logic"),
        (F.col("k") % 29 == 0).alias("mask_md"),
        ((F.col("user_id") + F.day("ts")) % 11 == 0).alias("mask_hf"),
        "k",
    )


READINGS = """
r AS (
  SELECT event_id, ts, user_id AS station_id, event_type AS direction, CASE WHEN event_id % 17 <> 0 THEN value END AS flow,
         k / 100e0 AS occupancy, value / (k + 1) AS speed, value > 150 AS mask_logic, k % 29 = 0 AS mask_md,
         (user_id + day(ts)) % 11 = 0 AS mask_hf, k
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
)"""

#: Flagged readings whose masked features are null.
MASKED = (
    READINGS
    + """,
m AS (
  SELECT * REPLACE (CASE WHEN NOT mask_flag THEN flow END AS flow, CASE WHEN NOT mask_flag THEN occupancy END AS occupancy,
                    CASE WHEN NOT mask_flag THEN speed END AS speed)
  FROM (SELECT *, mask_logic OR mask_md OR mask_hf OR flow IS NULL OR occupancy IS NULL OR speed IS NULL AS mask_flag FROM r)
)"""
)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station metadata; gx and gy are whole-numbered coordinates, on which distances are exact."""
    u = F.col("station_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station_id")).distinct().select(
        "station_id",
        (u * 53 % 97).alias("gx"),
        (u * 37 % 101).alias("gy"),
        (F.lit(33.7) + (u * 37 % 101) * F.lit(0.005)).alias("lat"),
        (F.lit(-118.5) + (u * 53 % 97) * F.lit(0.005)).alias("lon"),
        F.when(u % 5 != 0, (u % 9 + 1) * F.lit(0.05)).alias("length"),
        (u % 7).alias("freeway"),
        ((u * 29 % 211) * F.lit(0.1)).alias("abs_pm"),
    )


STATIONS = """
s AS (
  SELECT station_id, station_id * 53 % 97 AS gx, station_id * 37 % 101 AS gy, 33.7e0 + (station_id * 37 % 101) * 0.005e0 AS lat,
         -118.5e0 + (station_id * 53 % 97) * 0.005e0 AS lon, CASE WHEN station_id % 5 <> 0 THEN (station_id % 9 + 1) * 0.05e0 END AS length,
         station_id % 7 AS freeway, (station_id * 29 % 211) * 0.1e0 AS abs_pm
  FROM (SELECT DISTINCT user_id AS station_id FROM events)
)"""


def knn_sql(k: int) -> str:
    """Directed edges (a, b) from each station to its k nearest by whole-numbered coordinates."""
    return f"""
nn AS (
  SELECT a, b, sqrt(CAST(d AS DOUBLE)) AS dist, rank FROM (
    SELECT x.station_id AS a, y.station_id AS b, (x.gx - y.gx) * (x.gx - y.gx) + (x.gy - y.gy) * (x.gy - y.gy) AS d,
           row_number() OVER (PARTITION BY x.station_id ORDER BY (x.gx - y.gx) * (x.gx - y.gx) + (x.gy - y.gy) * (x.gy - y.gy), y.station_id) AS rank
    FROM s x JOIN s y ON x.station_id <> y.station_id
  ) WHERE rank <= {k}
)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete grid of hours and directions: (hour, direction, y), y the sum of values, 0 where there are none."""
    events = table(spark, sf_dir, "events").select(floor_time(F.col("ts"), 60).alias("hour"), F.col("event_type").alias("direction"), F.col("value").cast("decimal(18,2)").alias("v"))
    sums = events.groupBy("hour", "direction").agg(F.sum("v").cast("double").alias("y"))
    grid = events.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    kinds = F.broadcast(events.select("direction").distinct())  # a handful of directions
    return grid.join(kinds).join(sums, ["hour", "direction"], "left").select("hour", "direction", F.coalesce("y", F.lit(0.0)).alias("y"))


HOURLY = """
e AS (
  SELECT date_trunc('hour', ts) AS hour, event_type AS direction, CAST(value AS DECIMAL(18, 2)) AS v FROM events
), g AS (
  SELECT hour, direction, coalesce(y, 0) AS y
  FROM (SELECT unnest(generate_series((SELECT min(hour) FROM e), (SELECT max(hour) FROM e), INTERVAL 1 HOUR)) AS hour)
  CROSS JOIN (SELECT DISTINCT direction FROM e) LEFT JOIN (SELECT hour, direction, CAST(sum(v) AS DOUBLE) AS y FROM e GROUP BY ALL) USING (hour, direction)
)"""


def q(x: str, alias: str | None = None) -> str:
    """SQL of ``quantize``."""
    return f"floor(({x}) * 1e6 + 0.50013e0) / 1e6" + (f" AS {alias}" if alias else "")
