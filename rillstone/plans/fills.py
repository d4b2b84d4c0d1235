"""Queries of the filling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.numeric import quantize
from rillstone.functions.timeslots import floor_time
from rillstone.operators import fill, proximity
from rillstone.plans.views import MASKED, STATIONS, knn_sql, q, readings, stations

FEATURES = fill.FEATURES


def _out(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    return df.select("event_id", *(quantize(F.col(c)).alias(c) for c in columns))


def _neighbours(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    return proximity.knn_join(stations(spark, d), k, x="gx", y="gy").select("station_id", "neighbour")


def mask_flag_null_out(spark, d):
    return fill.null_out(readings(spark, d)).select("event_id", "mask_flag", *FEATURES)


def local_neighbor_fill(spark, d):
    rows = fill.null_out(readings(spark, d)).withColumn("hour", floor_time(F.col("ts"), 60))
    filled = fill.local_fill(rows, _neighbours(spark, d), time="hour")
    return _out(filled, [f"{f}_local" for f in FEATURES])


_LOCAL = f"""
h AS (SELECT *, date_trunc('hour', ts) AS hour FROM m),
l AS (
  SELECT a.station_id, a.hour, avg(b.flow) AS flow_local, avg(b.occupancy) AS occupancy_local, avg(b.speed) AS speed_local
  FROM (SELECT DISTINCT station_id, hour FROM h WHERE mask_flag) a JOIN nn ON nn.a = a.station_id
  JOIN h b ON b.station_id = nn.b AND b.hour = a.hour AND NOT b.mask_flag GROUP BY ALL
)"""

LOCAL_SQL = f"""WITH {MASKED}, {STATIONS}, {knn_sql(8)}, {_LOCAL}
SELECT event_id, {", ".join(q(f"CASE WHEN mask_flag THEN {f}_local END", f"{f}_local") for f in FEATURES)} FROM h LEFT JOIN l USING (station_id, hour)"""


def group_mean_fill(spark, d):
    return _out(fill.group_mean_fill(fill.null_out(readings(spark, d)), FEATURES, fill.GROUP))


GROUP_SQL = f"""WITH {MASKED}
SELECT event_id, {", ".join(q(f"CASE WHEN mask_flag THEN avg({f}) OVER (PARTITION BY station_id, direction) ELSE {f} END", f) for f in FEATURES)} FROM m"""


def bracket_interpolate(spark, d):
    return _out(fill.bracket_interpolate(fill.null_out(readings(spark, d)), FEATURES, fill.GROUP, "ts", tie=["event_id"]))


def _sides_sql(known: str, f: str, group: str, alias: str) -> str:
    w = f"OVER (PARTITION BY {group} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    v = f"OVER (PARTITION BY {group} ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    x = lambda c: f"CASE WHEN {known} THEN {c} END"
    return f"""last_value({x(f)} IGNORE NULLS) {w} AS {alias}_b, last_value({x("epoch_us(ts)")} IGNORE NULLS) {w} AS {alias}_tb,
         first_value({x(f)} IGNORE NULLS) {v} AS {alias}_a, first_value({x("epoch_us(ts)")} IGNORE NULLS) {v} AS {alias}_ta"""


def _line_sql(f: str) -> str:
    return f"""CASE WHEN {f}_tb IS NULL THEN {f}_a WHEN {f}_ta IS NULL THEN {f}_b WHEN {f}_ta = {f}_tb THEN {f}_b
      ELSE {f}_b + ({f}_a - {f}_b) * (CAST(epoch_us(ts) - {f}_tb AS DOUBLE) / CAST({f}_ta - {f}_tb AS DOUBLE)) END"""


_BRACKET = f"""
b AS (SELECT *, {", ".join(_sides_sql("NOT mask_flag", f, "station_id, direction", f) for f in FEATURES)} FROM m)"""

BRACKET_SQL = f"""WITH {MASKED}, {_BRACKET}
SELECT event_id, {", ".join(q(f"CASE WHEN NOT mask_flag THEN {f} ELSE {_line_sql(f)} END", f) for f in FEATURES)} FROM b"""


def np_interp_fill(spark, d):
    rows = readings(spark, d).withColumn("mask_flag", fill.mask_flag(readings(spark, d)))
    return _out(fill.interp_fill(rows, ["flow", "speed"], fill.GROUP, "ts", tie=["event_id"]), ["flow", "speed"])


NP_SQL = f"""WITH {MASKED}, f0 AS (SELECT *, mask_logic OR mask_md OR mask_hf AS masked FROM r),
b AS (SELECT *, {", ".join(_sides_sql(f"NOT masked AND {f} IS NOT NULL", f, "station_id, direction", f) for f in ("flow", "speed"))},
      {", ".join(f"count(CASE WHEN NOT masked THEN {f} END) OVER (PARTITION BY station_id, direction) AS {f}_n" for f in ("flow", "speed"))} FROM f0)
SELECT event_id, {", ".join(q(f"CASE WHEN NOT masked OR {f}_n < 2 THEN {f} ELSE {_line_sql(f)} END", f) for f in ("flow", "speed"))} FROM b"""


def ffill_bfill(spark, d):
    return _out(fill.carry_fill(fill.null_out(readings(spark, d)), ["flow", "speed"], ["station_id"], ["ts", "event_id"]), ["flow", "speed"])


def _carry_sql(f: str, group: str) -> str:
    return f"""coalesce({f}, last_value({f} IGNORE NULLS) OVER (PARTITION BY {group} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value({f} IGNORE NULLS) OVER (PARTITION BY {group} ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


CARRY_SQL = f"""WITH {MASKED} SELECT event_id, {", ".join(q(_carry_sql(f, "station_id"), f) for f in ("flow", "speed"))} FROM m"""


def fill_pipeline_full(spark, d):
    rows = readings(spark, d).withColumn("hour", floor_time(F.col("ts"), 60))
    masked = fill.fill_chain(rows.withColumn("timestamp", F.col("hour")).drop("hour"), _neighbours(spark, d), tie=["ts", "event_id"])
    return _out(masked)


#: The chain orders by hour, then exact time; its brackets lie on the line over hours.
_HOURS = lambda x: x.replace("epoch_us(ts)", "epoch_us(hour)").replace("ORDER BY ts, event_id", "ORDER BY hour, ts, event_id")

CHAIN_SQL = f"""WITH {MASKED}, {STATIONS}, {knn_sql(8)}, {_LOCAL},
b AS (SELECT *, {_HOURS(", ".join(_sides_sql("NOT mask_flag", f, "station_id, direction", f) for f in FEATURES))} FROM h),
c AS (SELECT event_id, ts, hour, station_id, direction, {", ".join(f"CASE WHEN NOT mask_flag THEN {f} ELSE coalesce({_HOURS(_line_sql(f))}, {f}_local) END AS {f}" for f in FEATURES)}
      FROM b LEFT JOIN l USING (station_id, hour)),
e AS (SELECT event_id, station_id, direction, {_HOURS(", ".join(f"{_carry_sql(f, 'station_id, direction')} AS {f}" for f in FEATURES))} FROM c),
w AS (SELECT {", ".join(f"avg({f}) AS {f}_w" for f in FEATURES)} FROM e)
SELECT event_id, {", ".join(q(f"coalesce({f}, avg({f}) OVER (PARTITION BY station_id, direction), {f}_w)", f) for f in FEATURES)} FROM e, w"""


def _refill_tables(spark, d):
    rows = readings(spark, d).withColumn("timestamp", floor_time(F.col("ts"), 60))
    interp = fill.null_out(rows).withColumns({f: F.when((F.col("event_id") % 3 == 0) | ~F.col("mask_flag"), F.coalesce(F.col(f), F.col("k") * F.lit(1.0))) for f in FEATURES})
    keys = ["timestamp", "station_id", "direction"]
    return rows.select(*keys, *FEATURES), rows.select(*keys, *fill.MASKS), interp.select(*keys, *FEATURES)


_REFILL = f"""
t0 AS (SELECT *, date_trunc('hour', ts) AS hour FROM r),
i0 AS (SELECT date_trunc('hour', ts) AS hour, station_id, direction, {", ".join(f"CASE WHEN event_id % 3 = 0 OR NOT mask_flag THEN coalesce({f}, k * 1e0) END AS {f}" for f in FEATURES)} FROM m)"""


def refill_masked(spark, d):
    out = fill.refill(*_refill_tables(spark, d))
    return out.select("timestamp", "station_id", *(quantize(F.col(f"{f}_interp")).alias(f"{f}_interp") for f in FEATURES))


REFILL_SQL = f"""WITH {MASKED}, {_REFILL},
f1 AS (SELECT hour, station_id, direction, bool_or(mask_logic OR mask_md OR mask_hf) AS masked FROM t0 GROUP BY ALL),
v AS (SELECT hour, station_id, direction, {", ".join(f"avg({f}) AS {f}" for f in FEATURES)} FROM i0 GROUP BY ALL),
j AS (SELECT hour, station_id, direction, masked, {", ".join(FEATURES)} FROM f1 LEFT JOIN v USING (hour, station_id, direction)),
a AS (SELECT hour, station_id, direction, masked, {", ".join(f"{f} AS {f}_0, CASE WHEN masked AND {f} IS NULL THEN avg({f}) OVER (PARTITION BY hour) ELSE {f} END AS {f}" for f in FEATURES)} FROM j),
c AS (SELECT hour, station_id, direction, {", ".join(f"CASE WHEN masked THEN {_carry_sql(f, 'station_id, direction')} ELSE {f}_0 END AS {f}".replace("ORDER BY ts, event_id", "ORDER BY hour") for f in FEATURES)} FROM a)
SELECT hour AS "timestamp", station_id, {", ".join(q(f"avg({f})", f"{f}_interp") for f in FEATURES)} FROM c GROUP BY hour, station_id"""


def fill_check_report(spark, d):
    raw, mask, interp = _refill_tables(spark, d)
    out = fill.fill_check(raw, mask, interp)
    return out.select(*(quantize(F.col(c)).alias(c) if c.startswith("max") else F.col(c).cast("long").alias(c) for c in out.columns))


CHECK_SQL = f"""WITH {MASKED}, {_REFILL},
f1 AS (SELECT hour, station_id, bool_or(mask_logic OR mask_md OR mask_hf) AS masked FROM t0 GROUP BY ALL),
o AS (SELECT hour, station_id, {", ".join(f"avg({f}) AS {f}_r" for f in FEATURES)} FROM t0 GROUP BY ALL),
v AS (SELECT hour, station_id, {", ".join(f"avg({f}) AS {f}" for f in FEATURES)} FROM i0 GROUP BY ALL),
c AS (SELECT count(*) AS n, count(*) - count(DISTINCT (hour, station_id)) AS dup FROM t0)
SELECT count(*) FILTER (WHERE masked) AS masked, count(*) FILTER (WHERE NOT masked) AS unmasked,
       count(*) FILTER (WHERE masked AND (flow IS NULL OR occupancy IS NULL OR speed IS NULL)) AS missing_masked,
       {", ".join(q(f"coalesce(max(CASE WHEN NOT masked THEN abs({f} - {f}_r) END), 0)", f"max_diff_{f}") for f in FEATURES)},
       {", ".join(f"any_value(c.n) AS {p}_rows, any_value(c.dup) AS {p}_duplicates" for p in ("raw", "mask", "interp"))}
FROM v LEFT JOIN f1 USING (hour, station_id) LEFT JOIN o USING (hour, station_id), c"""


QUERIES = {
    "mask_flag_null_out": (mask_flag_null_out, f"WITH {MASKED} SELECT event_id, mask_flag, flow, occupancy, speed FROM m"),
    "local_neighbor_fill": (local_neighbor_fill, LOCAL_SQL),
    "group_mean_fill": (group_mean_fill, GROUP_SQL),
    "bracket_interpolate": (bracket_interpolate, BRACKET_SQL),
    "np_interp_fill": (np_interp_fill, NP_SQL),
    "ffill_bfill": (ffill_bfill, CARRY_SQL),
    "fill_pipeline_full": (fill_pipeline_full, CHAIN_SQL),
    "refill_masked": (refill_masked, REFILL_SQL),
    "fill_check_report": (fill_check_report, CHECK_SQL),
}
