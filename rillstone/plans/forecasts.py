"""Queries of calendars, resampling, forecast features, baselines, reports and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.functions import timeslots
from rillstone.functions.numeric import quantize
from rillstone.functions.timeslots import floor_time
from rillstone.operators import evaluate, features
from rillstone.plans.views import HOURLY, READINGS, STATIONS, hourly, q, readings, stations, table
from rillstone.streaming import windows

SLOTS = 24
DELTAS = features.HORIZONS
_FED = sorted(x for y in (2023, 2024, 2025) for x in timeslots.federal_holidays(y))


def calendar_features(spark, d):
    out = timeslots.with_calendar(table(spark, d, "events").select("event_id", "ts"), "ts", 288, range(2023, 2026))
    return out.select("event_id", "slot", "weekday", "is_weekend", "is_holiday", *(quantize(F.col(c)).alias(c) for c in ("sin_day", "cos_day", "sin_week", "cos_week")))


CALENDAR_SQL = f"""WITH c AS (SELECT event_id, ts, (hour(ts) * 60 + minute(ts)) // 5 AS slot, isodow(ts) - 1 AS weekday FROM events)
SELECT event_id, slot, weekday, weekday >= 5 AS is_weekend, CAST(ts AS DATE) IN ({", ".join(f"DATE '{x}'" for x in _FED)}) AS is_holiday,
  {q("sin(slot * (2 * pi() / 288))", "sin_day")}, {q("cos(slot * (2 * pi() / 288))", "cos_day")}, {q("sin(weekday * (2 * pi() / 7))", "sin_week")}, {q("cos(weekday * (2 * pi() / 7))", "cos_week")} FROM c"""


def resample_linear(spark, d):
    """The whole hourly series, each half hour on the line between its hours."""
    out = timeslots.resample_linear(hourly(spark, d), ["direction"], "hour", ["y"], 30)
    return out.select("direction", "hour", quantize(F.col("y")).alias("y"))


LINEAR_SQL = f"""WITH {HOURLY}, n AS (SELECT *, lead(hour) OVER w AS t1, lead(y) OVER w AS y1 FROM g WINDOW w AS (PARTITION BY direction ORDER BY hour)),
p AS (SELECT *, unnest(generate_series(hour, coalesce(t1 - INTERVAL 30 MINUTE, hour), INTERVAL 30 MINUTE)) AS t FROM n)
SELECT direction, t AS hour, {q("CASE WHEN t = hour THEN y ELSE y + (y1 - y) * (CAST(date_diff('second', hour, t) AS DOUBLE) / date_diff('second', hour, t1)) END", "y")} FROM p"""


def asfreq_grid(spark, d):
    return timeslots.regular_grid(hourly(spark, d), ["direction"], "hour", 30).select("direction", "hour", "y")


_GRID = f"{HOURLY}, lo AS (SELECT direction, min(hour) AS a, max(hour) AS b FROM g GROUP BY 1), gr AS (SELECT direction, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS hour FROM lo)"
ASFREQ_SQL = f"WITH {_GRID} SELECT direction, hour, y FROM gr LEFT JOIN g USING (direction, hour)"


def resample_ffill(spark, d):
    from rillstone.operators.fill import carry_fill

    return carry_fill(asfreq_grid(spark, d), ["y"], ["direction"], ["hour"], backward=False).select("direction", "hour", "y")


FFILL_SQL = f"""WITH {_GRID}
SELECT direction, hour, last_value(y IGNORE NULLS) OVER (PARTITION BY direction ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM gr LEFT JOIN g USING (direction, hour)"""


def _indexed(spark, d):
    return features.index_panel(hourly(spark, d), "direction", "hour")


_INDEXED = f"{HOURLY}, ix AS (SELECT *, dense_rank() OVER (ORDER BY hour) - 1 AS time_idx, dense_rank() OVER (ORDER BY direction) - 1 AS node_idx FROM g)"
_LEADS = ", ".join(f"lead(y, {n}) OVER (PARTITION BY direction ORDER BY hour) AS y_{h}" for h, n in DELTAS.items())
_SUPERVISED = f"{_INDEXED}, su AS (SELECT * FROM (SELECT *, {_LEADS} FROM ix) WHERE y_30min IS NOT NULL)"


def supervised_horizons(spark, d):
    out = features.supervised(_indexed(spark, d), "direction", "hour", "y")
    return out.select("time_idx", "node_idx", "y", *(f"y_{h}" for h in DELTAS))


def supervised_by_time(spark, d):
    rows = readings(spark, d).groupBy(floor_time(F.col("ts"), 60).alias("hour"), "direction").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return features.supervised(rows, "direction", "hour", "y", by_position=False, minutes=60).select("hour", "direction", "y", *(f"y_{h}" for h in DELTAS))


BY_TIME_SQL = f"""WITH {READINGS}, c AS (SELECT date_trunc('hour', ts) AS hour, direction, CAST(count(*) AS DOUBLE) AS y FROM r GROUP BY ALL)
SELECT c.hour, c.direction, c.y, {", ".join(f"c{n}.y AS y_{h}" for h, n in DELTAS.items())} FROM c {" ".join(f"JOIN c c{n} ON c{n}.direction = c.direction AND c{n}.hour = c.hour + INTERVAL {n} HOUR" for n in DELTAS.values())}"""


def _total(spark, d) -> int:
    return hourly(spark, d).select("hour").distinct().count()


def time_split(spark, d):
    times = _indexed(spark, d).select("time_idx", "hour").distinct()
    return times.select("time_idx", "hour", features.split_label(F.col("time_idx"), _total(spark, d)).alias("split"))


_BOUNDS = """
nt AS (SELECT count(DISTINCT hour) AS total, count(DISTINCT hour) - 6 AS n FROM g),
bo AS (SELECT n, least(greatest(CAST(floor(n * 0.7e0) AS BIGINT), 1), n - 2) AS a, CAST(floor(n * (0.7e0 + 0.15e0)) AS BIGINT) AS b FROM nt)"""
_SPLIT = "CASE WHEN time_idx >= n THEN NULL WHEN time_idx < a THEN 'train' WHEN time_idx < least(greatest(b, a + 1), n - 1) THEN 'val' ELSE 'test' END"
SPLIT_SQL = f"WITH {_INDEXED}, {_BOUNDS} SELECT DISTINCT time_idx, hour, {_SPLIT} AS split FROM ix, bo"


def rolling_zscore(spark, d):
    out = features.rolling_zscore(_indexed(spark, d), ["y"], "direction", ["hour"], 48, 12)
    return out.select("time_idx", "node_idx", quantize(F.col("z_y")).alias("z_y"))


ZSCORE_SQL = f"""WITH {_INDEXED} SELECT time_idx, node_idx, {q("CASE WHEN count(y) OVER w >= 12 THEN (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) END", "z_y")} FROM ix
WINDOW w AS (PARTITION BY direction ORDER BY hour ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"""


def history_block(spark, d):
    return features.history(_indexed(spark, d), "y", "direction", ["hour"], 12).select("time_idx", "node_idx", F.array_join(F.transform("history", lambda x: F.floor(x * 100 + 0.5).cast("string")), ",").alias("history"))


HISTORY_SQL = f"""WITH {_INDEXED}, h AS (SELECT time_idx, node_idx, list(CAST(floor(y * 100 + 0.5e0) AS BIGINT)) OVER (PARTITION BY direction ORDER BY hour ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS l FROM ix)
SELECT time_idx, node_idx, array_to_string(l, ',') AS history FROM h WHERE len(l) = 12"""


def _split_samples(spark, d):
    rows = features.supervised(_indexed(spark, d), "direction", "hour", "y")
    return rows.withColumn("split", features.split_label(F.col("time_idx"), _total(spark, d)))


_SAMPLES = f"{_SUPERVISED}, {_BOUNDS}, sa AS (SELECT su.*, {_SPLIT} AS split FROM su, bo)"
_TARGETS = [f"y_{h}" for h in DELTAS]


def station_stats(spark, d):
    out = features.station_stats(_split_samples(spark, d).where("split = 'train'"), "direction", "y", _TARGETS)
    return out.select("direction", *(quantize(F.col(c)).alias(c) for c in out.columns[1:]))


_STATS_COLS = ", ".join(f"avg({c}) AS mean_{c}, greatest(stddev_pop({c}), 1e-6) AS std_{c}" for c in ["y", *_TARGETS])
STATS_SQL = f"WITH {_SAMPLES}, st AS (SELECT direction, {_STATS_COLS} FROM sa WHERE split = 'train' GROUP BY 1) SELECT direction, {', '.join(q(f'{p}_{c}', f'{p}_{c}') for c in ['y', *_TARGETS] for p in ('mean', 'std'))} FROM st"


def normalize_inverse(spark, d):
    rows = _split_samples(spark, d)
    stats = features.station_stats(rows.where("split = 'train'"), "direction", "y", _TARGETS)
    norm = features.normalize(rows.withColumn("raw", F.col("y_15min")), stats, "direction", ["y", "y_15min"])
    back = features.denormalize(norm.withColumn("back", F.col("y_15min")), stats, "direction", "back", "y_15min")
    return back.select("time_idx", "node_idx", quantize(F.col("y")).alias("y"), quantize(F.col("y_15min")).alias("target"), quantize(F.col("back"), 4).alias("back"), quantize(F.abs(F.col("back") - F.col("raw")), 4).alias("error"))


NORMAL_SQL = f"""WITH {_SAMPLES}, st AS (SELECT direction, {_STATS_COLS} FROM sa WHERE split = 'train' GROUP BY 1)
SELECT time_idx, node_idx, {q("(y - mean_y) / std_y", "y")}, {q("(y_15min - mean_y_15min) / std_y_15min", "target")}, {q("y_15min", "back").replace("1e6", "1e4")}, 0e0 AS error FROM sa JOIN st USING (direction)"""


def weather_ablation(spark, d):
    rows = _split_samples(spark, d).select("time_idx", "node_idx", "split", "y", F.col("y_5min").alias("tavg"), F.col("y_15min").alias("pcpn"))
    out = features.ablate(rows, rows.where("split = 'train'"), ["tavg", "pcpn"])
    return out.select("time_idx", "node_idx", "y", quantize(F.col("tavg")).alias("tavg"), quantize(F.col("pcpn")).alias("pcpn"))


ABLATE_SQL = f"WITH {_SAMPLES}, me AS (SELECT avg(y_5min) AS a, avg(y_15min) AS b FROM sa WHERE split = 'train') SELECT time_idx, node_idx, y, {q('a', 'tavg')}, {q('b', 'pcpn')} FROM sa, me"


def leakage_audit(spark, d):
    rows = _indexed(spark, d).withColumn("x", F.when(F.col("time_idx") % 5 == 0, F.col("y")).otherwise(F.col("y") + 1))
    out = features.leakage_audit(rows, "direction", ["hour"], "x", "y")
    return out.select(*(quantize(F.col(c)).alias(c) for c in out.columns))


_CLOSE = "CAST(abs(x - {c}) <= 1e-4 + 1e-4 * abs({c}) AS INT)"
AUDIT_SQL = f"""WITH {_INDEXED}, a AS (SELECT * FROM (SELECT *, CASE WHEN time_idx % 5 = 0 THEN y ELSE y + 1 END AS x, {_LEADS} FROM ix) WHERE y_30min IS NOT NULL)
SELECT {q(f"avg({_CLOSE.format(c='y')})", "same_rate")}, {q("avg(abs(x - y))", "mae_same")}, {", ".join(q(f"avg({_CLOSE.format(c=f'y_{h}')})", f"rate_{h}") + ", " + q(f"avg(abs(x - y_{h}))", f"mae_{h}") for h in DELTAS)} FROM a"""


def _last_value(spark, d):
    test = _split_samples(spark, d).where("split = 'test'")
    return evaluate.last_value(test, "y", ["direction", "hour"])


def _metrics_out(df):
    return df.select("horizon", *(quantize(F.col(c), 5).alias(c) for c in ("mae", "rmse", "mape")), "n")


def baseline_last_value(spark, d):
    return _metrics_out(evaluate.pooled_metrics(_last_value(spark, d)))


_Q5 = lambda x, a: q(x, a).replace("1e6", "1e5")
_METRICS = f"""{_Q5("sum(abs(p - t)) / count(*)", "mae")}, {_Q5("sqrt(sum((p - t) ** 2) / count(*))", "rmse")}, {_Q5("sum(abs(p - t) / greatest(abs(t), 1) * 100) / count(*)", "mape")}, count(*) AS n"""
_LV = f"{_SAMPLES}, pr AS (" + " UNION ALL ".join(f"SELECT '{h}' AS horizon, direction, hour, y AS p, y_{h} AS t FROM sa WHERE split = 'test'" for h in DELTAS) + ")"
_POOLED = f"SELECT coalesce(horizon, 'all') AS horizon, {_METRICS} FROM pr GROUP BY GROUPING SETS ((horizon), ())"


def _average(spark, d):
    slot = F.hour("target_hour").cast("long")
    target = lambda t, h: t.select("direction", "hour", F.timestamp_add("HOUR", F.lit(DELTAS[h]), F.col("hour")).alias("target_hour"), F.col(f"y_{h}").alias("truth"), F.lit(h).alias("horizon")).withColumn("slot", slot)
    rows = _split_samples(spark, d)
    every = lambda t: target(t, "5min").unionByName(target(t, "15min")).unionByName(target(t, "30min"))
    train = every(rows.where("split = 'train'"))
    return evaluate.historical_average(train, every(rows.where("split = 'test'")), "direction", "slot", "truth")


def baseline_hist_avg(spark, d):
    return _metrics_out(evaluate.pooled_metrics(_average(spark, d)))


_HA = f"{_SAMPLES}, al AS (" + " UNION ALL ".join(f"SELECT '{h}' AS horizon, split, direction, hour, hour(hour + INTERVAL {n} HOUR) AS slot, y_{h} AS t FROM sa" for h, n in DELTAS.items()) + """),
fi AS (SELECT direction, slot, avg(t) AS f FROM al WHERE split = 'train' GROUP BY ALL), co AS (SELECT direction, avg(t) AS c FROM al WHERE split = 'train' GROUP BY ALL),
pr AS (SELECT horizon, direction, hour, slot, coalesce(f, c) AS p, t FROM al LEFT JOIN fi USING (direction, slot) LEFT JOIN co USING (direction) WHERE split = 'test')"""


def metrics_pooled(spark, d):
    both = _last_value(spark, d).withColumn("model", F.lit("last")).select("model", "direction", "horizon", "prediction", "truth")
    out = evaluate.pooled_metrics(both, by=["direction"])
    return out.select("direction", "horizon", *(quantize(F.col(c), 5).alias(c) for c in ("mae", "rmse", "mape")), "n")


def hour_error_matrix(spark, d):
    errors = _average(spark, d).select("horizon", F.col("slot").alias("hour"), F.abs(F.col("prediction") - F.col("truth")).alias("abs_error"))
    out = evaluate.hour_matrix(errors)
    return out.select("horizon", "hour", quantize(F.col("mean_error"), 5).alias("mean_error"))


HOUR_SQL = f"""WITH {_HA}, hh AS (SELECT unnest(range(24)) AS hour), hz AS (SELECT unnest({list(DELTAS)}) AS horizon)
SELECT hz.horizon, hh.hour, {_Q5("coalesce(avg(abs(p - t)), 0)", "mean_error")} FROM hh CROSS JOIN hz LEFT JOIN pr ON pr.slot = hh.hour AND pr.horizon = hz.horizon GROUP BY hz.horizon, hh.hour"""


def shard_assignment(spark, d):
    rows = _indexed(spark, d).select("time_idx", "node_idx")
    return features.shard(rows, ["time_idx", "node_idx"], 3).select("time_idx", "node_idx", F.col("rank").cast("long").alias("rank"))


SHARD_SQL = f"WITH {_INDEXED} SELECT time_idx, node_idx, (row_number() OVER (ORDER BY time_idx, node_idx) - 1) % 3 AS rank FROM ix"


def panel_build(spark, d):
    rows = readings(spark, d).groupBy(floor_time(F.col("ts"), 60).alias("timestamp"), "station_id").agg(*(F.avg(c).alias(c) for c in ("flow", "occupancy", "speed")))
    sky = rows.where("station_id % 3 > 0").select("timestamp", "station_id", F.col("speed").alias("tavg"), F.col("occupancy").alias("pcpn"))
    out = features.build_panel(rows, sky)
    return out.select("time_idx", "node_idx", *(quantize(F.col(c)).alias(c) for c in (*features.PANEL_FEATURES, "y")))


PANEL_SQL = f"""WITH {READINGS}, h AS (SELECT date_trunc('hour', ts) AS hour, station_id, avg(flow) AS flow, avg(occupancy) AS occupancy, avg(speed) AS speed FROM r GROUP BY ALL)
SELECT dense_rank() OVER (ORDER BY hour) - 1 AS time_idx, dense_rank() OVER (ORDER BY station_id) - 1 AS node_idx, {", ".join(q(c, c) for c in ("flow", "occupancy", "speed"))},
  {q("CASE WHEN station_id % 3 > 0 THEN speed END", "tavg")}, {q("CASE WHEN station_id % 3 > 0 THEN occupancy END", "pcpn")}, CASE WHEN isodow(hour) >= 6 THEN 1e0 ELSE 0e0 END AS is_weekend, {q("flow", "y")} FROM h"""

_EPOCHS = [(1, "train", 10.0, "a"), (1, "train", 12.0, "a"), (1, "val", 3.0, ""), (2, "train", 6.0, "b"), (2, "train", 7.5, "c"), (4, "train", 4.0, "")]
_METRIC_ROWS = [("r", "test", "sage", "full", h, 1.0 + k, 2.0 + k, 3.0 + k, 10) for k, h in enumerate(("5", "15", "30", "all"))] + [("r", "test", "forest", "", "5", 4.0, 5.0, 6.0, 7)]


def scaling_report(spark, d):
    out = evaluate.scaling_report(spark.createDataFrame(_EPOCHS, "world_size int, phase string, phase_time_sec double, notes string"))
    return out.select("world_size", quantize(F.col("epoch_time")).alias("epoch_time"), quantize(F.col("speedup")).alias("speedup"), "notes")


SCALING_SQL = f"""WITH e(world_size, phase, t, notes) AS (VALUES {", ".join(map(str, _EPOCHS))}),
m AS (SELECT world_size, avg(CASE WHEN phase = 'train' THEN t END) AS epoch_time, array_to_string(list_sort(list(DISTINCT notes)), ';') AS notes FROM e GROUP BY 1)
SELECT m.world_size, {q("m.epoch_time", "epoch_time")}, {q("b.epoch_time / m.epoch_time", "speedup")}, m.notes FROM m LEFT JOIN m b ON b.world_size = 1"""


def ablation_report(spark, d):
    rows = spark.createDataFrame(_METRIC_ROWS, "run_id string, split string, model string, ablation string, horizon_min string, mae double, rmse double, mape double, n_samples long")
    rows = rows.withColumns({"train_time_sec": F.lit(None).cast("double"), "peak_gpu_mem_mb": F.lit(None).cast("double"), "notes": F.lit("")})
    return evaluate.ablation_report(rows, ["full", "without_graph", "without_weather"], {"without_graph": "forest"}).select("model", "ablation", "horizon_min", "mae", "notes")


ABLATION_SQL = f"""WITH m(run_id, split, model, ablation, horizon_min, mae, rmse, mape, n) AS (VALUES {", ".join(map(str, _METRIC_ROWS))}),
o AS (SELECT model, ablation, horizon_min, mae, '' AS notes FROM m WHERE ablation = 'full' UNION ALL SELECT model, 'without_graph', horizon_min, mae, 'proxy:forest' FROM m WHERE model = 'forest'),
w AS (SELECT unnest(['full', 'without_graph', 'without_weather']) AS ablation), h AS (SELECT unnest(['5', '15', '30', 'all']) AS horizon_min)
SELECT model, ablation, horizon_min, CAST(mae AS DOUBLE) AS mae, notes FROM o UNION ALL SELECT 'not_available', ablation, horizon_min, NULL, 'not_available' FROM w, h WHERE (ablation, horizon_min) NOT IN (SELECT (ablation, horizon_min) FROM o)"""


def window_tumbling(spark, d):
    out = windows.tumbling(readings(spark, d), "ts", "6 hours", ["direction"], "speed")
    return out.select("window_start", "direction", "n", quantize(F.col("total")).alias("total"), quantize(F.col("average")).alias("average"))


TUMBLING_SQL = f"""WITH {READINGS} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, direction, count(*) AS n, {q("sum(speed)", "total")}, {q("avg(speed)", "average")} FROM r GROUP BY ALL"""


def window_sliding(spark, d):
    out = windows.sliding(readings(spark, d), "ts", "6 hours", "2 hours", ["direction"], "speed")
    return out.select("window_start", "direction", "n", quantize(F.col("total")).alias("total"))


SLIDING_SQL = f"""WITH {READINGS}, o AS (SELECT unnest([0, 2, 4]) AS h)
SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - h * INTERVAL 1 HOUR AS window_start, direction, count(*) AS n, {q("sum(speed)", "total")} FROM r, o GROUP BY ALL"""


def session_islands(spark, d):
    return windows.sessions(readings(spark, d), "ts", "3 hours", ["direction"])


SESSION_SQL = f"""WITH {READINGS}, l AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 3 HOUR, true) AS new FROM r WINDOW w AS (PARTITION BY direction ORDER BY ts, event_id)),
i AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY direction ORDER BY ts, event_id) AS island FROM l)
SELECT direction, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM i GROUP BY direction, island"""


def event_rollup(spark, d):
    """Pooled sums over direction and day, each level of the two keys once."""
    rows = readings(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    out = rows.rollup("direction", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("total"))
    return out.select("direction", "day", "n", quantize(F.col("total")).alias("total"))


ROLLUP_SQL = f"WITH {READINGS} SELECT direction, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, {q('sum(speed)', 'total')} FROM r GROUP BY ROLLUP (direction, CAST(CAST(ts AS DATE) AS VARCHAR))"


def value_override(spark, d):
    rows = stations(spark, d).select("station_id", "lat", "lon")
    return features.override(rows, "station_id", 7, {"lat": 12.5, "lon": 0.33})


OVERRIDE_SQL = f"WITH {STATIONS} SELECT station_id, CASE WHEN station_id = 7 THEN 12.5e0 ELSE lat END AS lat, CASE WHEN station_id = 7 THEN 0.33e0 ELSE lon END AS lon FROM s"


def _forest(spark, d):
    rows = _split_samples(spark, d).withColumns({"slot": F.hour("hour") / 23.0, "weekday": F.weekday("hour") / 6.0, "node": F.col("node_idx").cast("double")})
    return rows


def _each_horizon(rows, predicted):
    """Pooled metrics of ``predicted(train, test, target)`` over all horizons."""
    train, test, named = rows.where("split = 'train'"), rows.where("split = 'test'"), None
    for h in DELTAS:
        one = predicted(train, test, f"y_{h}").select(F.lit(h).alias("horizon"), "prediction", F.col(f"y_{h}").alias("truth"))
        named = one if named is None else named.unionByName(one)
    return evaluate.pooled_metrics(named)


def rf_baseline(spark, d):
    return _each_horizon(_forest(spark, d), lambda train, test, target: evaluate.forest_baseline(train, test, ["y", "slot", "weekday", "node"], target))


def neighbor_regression(spark, d):
    """The multi-head model's inputs without its training: own value and the mean of the other directions', by a linear model."""
    rows = _forest(spark, d)
    means = rows.groupBy("time_idx").agg(F.sum("y").alias("_s"), F.count("y").alias("_n"))
    joined = rows.join(means, "time_idx").withColumn("others", F.coalesce(F.try_divide(F.col("_s") - F.col("y"), (F.col("_n") - 1).cast("double")), F.lit(0.0)))
    return _each_horizon(joined, lambda train, test, target: evaluate.graph_regression(train, test, ["y", "others", "slot", "weekday"], target))


QUERIES = {
    "calendar_features": (calendar_features, CALENDAR_SQL),
    "resample_linear": (resample_linear, LINEAR_SQL),
    "resample_ffill": (resample_ffill, FFILL_SQL),
    "asfreq_grid": (asfreq_grid, ASFREQ_SQL),
    "supervised_horizons": (supervised_horizons, f"WITH {_SUPERVISED} SELECT time_idx, node_idx, y, {', '.join(_TARGETS)} FROM su"),
    "supervised_by_time": (supervised_by_time, BY_TIME_SQL),
    "time_split": (time_split, SPLIT_SQL),
    "rolling_zscore": (rolling_zscore, ZSCORE_SQL),
    "history_block": (history_block, HISTORY_SQL),
    "station_stats": (station_stats, STATS_SQL),
    "normalize_inverse": (normalize_inverse, NORMAL_SQL),
    "weather_ablation": (weather_ablation, ABLATE_SQL),
    "leakage_audit": (leakage_audit, AUDIT_SQL),
    "baseline_last_value": (baseline_last_value, f"WITH {_LV} {_POOLED}"),
    "baseline_hist_avg": (baseline_hist_avg, f"WITH {_HA} {_POOLED}"),
    "metrics_pooled": (metrics_pooled, f"WITH {_LV} SELECT direction, coalesce(horizon, 'all') AS horizon, {_METRICS} FROM pr GROUP BY GROUPING SETS ((direction, horizon), (direction))"),
    "hour_error_matrix": (hour_error_matrix, HOUR_SQL),
    "shard_assignment": (shard_assignment, SHARD_SQL),
    "panel_build": (panel_build, PANEL_SQL),
    "scaling_report": (scaling_report, SCALING_SQL),
    "ablation_report": (ablation_report, ABLATION_SQL),
    "window_tumbling": (window_tumbling, TUMBLING_SQL),
    "window_sliding": (window_sliding, SLIDING_SQL),
    "session_islands": (session_islands, SESSION_SQL),
    "event_rollup": (event_rollup, ROLLUP_SQL),
    "value_override": (value_override, OVERRIDE_SQL),
    "rf_baseline": (rf_baseline, None),
    "neighbor_regression": (neighbor_regression, None),
}
