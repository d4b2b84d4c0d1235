"""Queries of health, rule scores, outliers, masks and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.functions.numeric import ordered_mean, quantize
from rillstone.functions.timeslots import floor_time
from rillstone.operators import fill, quality, tables
from rillstone.plans.views import MASKED, READINGS, q, readings, table

MASKS = fill.MASKS


def mask_union(spark, d):
    rows = readings(spark, d).withColumn("timestamp", floor_time(F.col("ts"), 60))
    health = rows.groupBy("station_id", F.to_date("timestamp").alias("date")).agg(ordered_mean("occupancy", "event_id").alias("health"))
    return quality.union_masks(rows, rows, rows, health, 0.3)


UNION_SQL = f"""WITH {READINGS},
h AS (SELECT station_id, CAST(ts AS DATE) AS date, avg(occupancy) < 0.3e0 AS low FROM r GROUP BY ALL),
k AS (SELECT date_trunc('hour', ts) AS "timestamp", station_id, bool_or(mask_logic) AS mask_logic, bool_or(mask_md) AS mask_md FROM r GROUP BY ALL)
SELECT "timestamp", k.station_id, mask_logic, mask_md, coalesce(low, false) AS mask_hf FROM k LEFT JOIN h ON h.station_id = k.station_id AND h.date = CAST("timestamp" AS DATE)"""


def mask_overlap(spark, d):
    out = quality.mask_overlap(readings(spark, d), MASKS)
    return out.select("masks", "rows", quantize(F.col("percent")).alias("percent"))


_SUBSETS = ["mask_logic", "mask_md", "mask_hf", "mask_logic&mask_md", "mask_logic&mask_hf", "mask_md&mask_hf", "mask_logic&mask_md&mask_hf"]
OVERLAP_SQL = f"WITH {READINGS} " + " UNION ALL ".join(
    f"SELECT '{s}' AS masks, count(*) FILTER (WHERE {s.replace('&', ' AND ')}) AS rows, {q(f'''100e0 * count(*) FILTER (WHERE {s.replace('&', ' AND ')}) / count(*)''', 'percent')} FROM r" for s in _SUBSETS
)


def _labels(spark, d):
    events = table(spark, d, "events")
    stations = events.select(F.col("user_id").alias("station_id")).distinct()
    days = events.select(F.to_date("ts").alias("slice_date")).distinct()
    good = events.select(F.col("user_id").alias("station_id"), F.to_date("ts").alias("slice_date")).distinct()
    return quality.snapshot_labels(stations, days, good)


_LABELS = """
d AS (SELECT DISTINCT CAST(ts AS DATE) AS slice_date FROM events),
good AS (SELECT DISTINCT user_id AS station_id, CAST(ts AS DATE) AS slice_date FROM events),
l AS (SELECT station_id, slice_date, CASE WHEN g.station_id IS NULL THEN -1e0 ELSE 0.9e0 END AS li
      FROM (SELECT DISTINCT user_id AS station_id FROM events) CROSS JOIN d LEFT JOIN good g USING (station_id, slice_date))"""


def health_decay(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("date")).distinct()
    out = quality.health_decay(_labels(spark, d), days, 1.0)
    return out.select("station_id", "date", quantize(F.col("score")).alias("score"), quantize(F.col("health_conf")).alias("health_conf"))


DECAY_SQL = f"""WITH {_LABELS}, c AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events),
s AS (SELECT station_id, date, sum(li * exp(-ln(2e0) * abs(datediff('day', slice_date, date)))) / sum(exp(-ln(2e0) * abs(datediff('day', slice_date, date)))) AS score
      FROM l CROSS JOIN c GROUP BY ALL)
SELECT station_id, date, {q("score", "score")}, {q("(score + 1) / 1.9e0", "health_conf")} FROM s"""

_HALF_LIVES = [0.5, 1.0, 2.0, 5.0, 7.0, 14.0]


def health_halflife_sweep(spark, d):
    out = quality.half_life_sweep(_labels(spark, d), _HALF_LIVES, exclude_snapshots=True)
    return out.select("half_life", *(quantize(F.col(c)).alias(c) for c in ("mid", "ext", "loss")))


_SWEEP = f"""WITH {_LABELS}, p AS (SELECT unnest([{", ".join(f"{h}e0" for h in _HALF_LIVES)}]) AS half_life),
w AS (SELECT a.station_id, a.slice_date AS d0, a.li AS truth, half_life, b.li, exp(-ln(2e0) / half_life * abs(datediff('day', b.slice_date, a.slice_date))) AS w
      FROM l a JOIN l b ON a.station_id = b.station_id AND a.slice_date <> b.slice_date CROSS JOIN p),
s AS (SELECT station_id, d0, truth, half_life, sum(w * li) / sum(w) AS score FROM w GROUP BY ALL),
e AS (SELECT half_life, avg(CASE WHEN d0 > lo AND d0 < hi THEN (score - truth) ** 2 END) AS mid, avg(CASE WHEN d0 = lo OR d0 = hi THEN (score - truth) ** 2 END) AS ext
      FROM s, (SELECT min(slice_date) AS lo, max(slice_date) AS hi FROM l) GROUP BY half_life),
z AS (SELECT half_life, mid, ext, 0.8e0 * coalesce(mid, 0) + 0.2e0 * coalesce(ext, 0) AS loss FROM e)
"""
SWEEP_SQL = _SWEEP + f"SELECT half_life, {q('mid', 'mid')}, {q('ext', 'ext')}, {q('loss', 'loss')} FROM z"


def health_best_halflife(spark, d):
    out = quality.half_life_sweep(_labels(spark, d), _HALF_LIVES, exclude_snapshots=True)
    return quality.best_row(out, "loss", "half_life").select("half_life", quantize(F.col("loss")).alias("loss"))


BEST_SQL = _SWEEP + f"SELECT half_life, {q('loss', 'loss')} FROM z ORDER BY loss, half_life LIMIT 1"


def _scored(spark, d):
    rows = readings(spark, d).withColumns({"samples": F.col("k"), "flow": F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("flow")), "occupancy": F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("occupancy"))})
    return quality.rule_scores(rows, time="ts", tie=["event_id"])


_SCORED = f"""{READINGS},
r1 AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 0 ELSE flow END AS flow, CASE WHEN event_id % 7 = 0 THEN 0 ELSE occupancy END AS occupancy) FROM r),
r2 AS (SELECT *, lag(flow) OVER w AS p1, lag(flow, 2) OVER w AS p2, lead(flow) OVER w AS n1, lead(flow, 2) OVER w AS n2,
       quantile_cont(speed, 0.99) OVER (PARTITION BY station_id) AS q99 FROM r1 WINDOW w AS (PARTITION BY station_id ORDER BY ts, event_id)),
z AS (SELECT quantile_cont(speed, 0.99) AS q99_all, quantile_cont(CAST(k AS DOUBLE), 0.1) AS q10 FROM r1),
sc AS (SELECT *, speed / (0.5e0 * q99 + 0.5e0 * q99_all) AS s5, CASE WHEN q10 = 0 THEN 0e0 ELSE greatest(0, (q10 - k) / q10) END AS s7,
       CASE WHEN flow = 0 AND occupancy = 0 AND p1 > 0 AND p2 > 0 AND n1 > 0 AND n2 > 0 THEN 1 ELSE 0 END AS s8 FROM r2, z)"""


def rule_scores(spark, d):
    return _scored(spark, d).select("event_id", quantize(F.col("s5")).alias("s5"), quantize(F.col("s7")).alias("s7"), "s8")


RULE_SQL = f"WITH {_SCORED} SELECT event_id, {q('s5', 's5')}, {q('s7', 's7')}, s8 FROM sc"


def rule_mask(spark, d):
    return _scored(spark, d).select("event_id", quality.score_mask((0.5, 0.5, 0.5), 0.25).alias("mask_logic"))


def f1_threshold_sweep(spark, d):
    rows = _scored(spark, d).select("station_id", F.to_date("ts").alias("date"), "s5", "s7", "s8", (F.col("mask_md") | F.col("mask_hf")).alias("true_bad"))
    out = quality.f1_sweep(rows, quality.parameter_grid(spark, [0.0, 0.5, 1.0], [0.1, 0.4, 0.7]))
    return out.select("a5", "a7", "a8", "threshold", *(quantize(F.col(c)).alias(c) for c in ("f1_time", "f1_day", "f1_sum")))


F1_SQL = f"""WITH {_SCORED}, a AS (SELECT unnest([0e0, 0.5e0, 1e0]) AS a), t AS (SELECT unnest([0.1e0, 0.4e0, 0.7e0]) AS threshold),
p AS (SELECT x.a AS a5, y.a AS a7, w.a AS a8, threshold FROM a x, a y, a w, t),
e AS (SELECT a5, a7, a8, threshold, station_id, CAST(ts AS DATE) AS date, mask_md OR mask_hf AS t, coalesce(a5 * s5 + a7 * s7 + a8 * s8 > threshold, false) AS p FROM sc, p),
dd AS (SELECT a5, a7, a8, threshold, station_id, date, bool_or(t) AS t, bool_or(p) AS p FROM e GROUP BY ALL),
f(src, a5, a7, a8, threshold, f1) AS (
  SELECT 'time', a5, a7, a8, threshold, coalesce(2e0 * count(*) FILTER (WHERE t AND p) / nullif(2 * count(*) FILTER (WHERE t AND p) + count(*) FILTER (WHERE t <> p), 0), 0) FROM e GROUP BY ALL
  UNION ALL
  SELECT 'day', a5, a7, a8, threshold, coalesce(2e0 * count(*) FILTER (WHERE t AND p) / nullif(2 * count(*) FILTER (WHERE t AND p) + count(*) FILTER (WHERE t <> p), 0), 0) FROM dd GROUP BY ALL)
SELECT a5, a7, a8, threshold, {q("max(f1) FILTER (WHERE src = 'time')", "f1_time")}, {q("max(f1) FILTER (WHERE src = 'day')", "f1_day")}, {q("sum(f1)", "f1_sum")}
FROM f GROUP BY a5, a7, a8, threshold"""


def f1_pivot(spark, d):
    out = f1_threshold_sweep(spark, d).groupBy("a5").pivot("threshold", [0.1, 0.4, 0.7]).agg(F.avg("f1_sum"))
    return out.select("a5", *(quantize(F.col(f"`{t}`")).alias(f"t{k}") for k, t in enumerate((0.1, 0.4, 0.7))))


PIVOT_SQL = f"""SELECT a5, {", ".join(q(f"avg(f1_sum) FILTER (WHERE threshold = {t}e0)", f"t{k}") for k, t in enumerate((0.1, 0.4, 0.7)))} FROM ({F1_SQL}) GROUP BY a5"""

_COV = ["flow", "occupancy", "speed"]


def covariance_matrix(spark, d):
    out = quality.covariance(quality.mean_impute(readings(spark, d), _COV), _COV, ["direction"])
    return out.select("direction", "n", *(quantize(F.col(c), 4).alias(c) for c in out.columns[2:]))


_PAIRS = [(a, b) for i, a in enumerate(_COV) for b in _COV[i:]]
_Q4 = lambda x, a: q(x, a).replace("1e6", "1e4")
_IMPUTED = f"""{READINGS}, a AS (SELECT avg(flow) AS fa FROM r), i AS (SELECT * REPLACE (coalesce(flow, fa) AS flow) FROM r, a)"""
COV_SQL = f"""WITH {_IMPUTED} SELECT direction, count(*) AS n, {", ".join(_Q4(f"avg({f})", f"mean_{f}") for f in _COV)},
  {", ".join(_Q4(f"covar_samp({a}, {b})", f"cov_{a}_{b}") for a, b in _PAIRS)} FROM i GROUP BY direction"""


def _coded(spark, d):
    return readings(spark, d).withColumn("code", quality.group_code(F.lit(False), F.col("k") % 29 == 0, F.weekday("ts") >= 5))


def mahalanobis_distance(spark, d):
    out = quality.mahalanobis(_coded(spark, d), ["flow", "occupancy"], "code")
    return out.select("event_id", "code", quantize(F.col("md_squared"), 4).alias("md_squared"))


_MD = f"""{_IMPUTED}, c AS (SELECT *, CAST(CASE WHEN k % 29 = 0 THEN 2 ELSE 0 END + CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS code FROM i),
mo AS (SELECT code, count(*) AS n, avg(flow) AS mx, avg(occupancy) AS my, var_samp(flow) + 1e-6 AS xx, var_samp(occupancy) + 1e-6 AS yy, covar_samp(flow, occupancy) AS xy FROM c GROUP BY code),
md AS (SELECT event_id, code, CASE WHEN n < 3 THEN 0 ELSE (yy * (flow - mx) ** 2 - 2 * xy * (flow - mx) * (occupancy - my) + xx * (occupancy - my) ** 2) / (xx * yy - xy * xy) END AS md_squared FROM c JOIN mo USING (code))"""
MD_SQL = f"WITH {_MD} SELECT event_id, code, {_Q4('md_squared', 'md_squared')} FROM md"


def mahalanobis_mask(spark, d):
    out = quality.mahalanobis(_coded(spark, d), ["flow", "occupancy"], "code")
    rounded = out.withColumn("md_squared", quantize(F.col("md_squared"), 4))
    return quality.knee_mask(rounded, "md_squared", ["code"]).select("event_id", "mask_md")


_KNEE = """
k1 AS (SELECT {g}, v, count(*) AS c FROM kv WHERE v IS NOT NULL GROUP BY ALL),
k2 AS (SELECT {g}, v, sum(c) OVER (PARTITION BY {g} ORDER BY v) AS rr, sum(c) OVER (PARTITION BY {g}) AS n, min(v) OVER (PARTITION BY {g}) AS lo, max(v) OVER (PARTITION BY {g}) AS hi FROM k1),
k3 AS (SELECT {g}, v, coalesce((CAST(rr - 1 AS DOUBLE) / nullif(CAST(n - 1 AS DOUBLE), 0)) - (v - lo) / nullif(hi - lo, 0), 0) AS gap FROM k2),
kt AS (SELECT {g}, v AS threshold FROM k3 QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY gap DESC, v) = 1)"""
MD_MASK_SQL = f"""WITH {_MD}, kv AS (SELECT event_id, code, {_Q4("md_squared", "v")} FROM md), {_KNEE.format(g="code")}
SELECT event_id, v > threshold AS mask_md FROM kv JOIN kt USING (code)"""


def knee_threshold(spark, d):
    return quality.knee_threshold(table(spark, d, "events"), "value", ["event_type"])


KNEE_SQL = f"WITH kv AS (SELECT event_type, value AS v FROM events), {_KNEE.format(g='event_type')} SELECT event_type, threshold FROM kt"


def quantile_profile(spark, d):
    out = tables.describe(readings(spark, d), "flow", ["direction"], (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99))
    return out.select("direction", "count", *(quantize(F.col(c)).alias(c) for c in out.columns[2:]))


PROFILE_SQL = f"""WITH {READINGS} SELECT direction, count(flow) AS count, {q("avg(flow)", "mean")}, {q("stddev_samp(flow)", "std")}, {q("min(flow)", "min")},
  {", ".join(q(f"quantile_cont(flow, {p})", f"q{round(p * 100)}") for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99))}, {q("max(flow)", "max")} FROM r GROUP BY direction"""


def ecdf_values(spark, d):
    out = tables.ecdf(readings(spark, d), "flow", ["direction"])
    return out.select("direction", "value", quantize(F.col("cdf")).alias("cdf"))


ECDF_SQL = f"""WITH {READINGS}, c AS (SELECT direction, flow AS value, count(*) AS c FROM r WHERE flow IS NOT NULL GROUP BY ALL)
SELECT direction, value, {q("(sum(c) OVER (PARTITION BY direction ORDER BY value) - 1) / CAST(sum(c) OVER (PARTITION BY direction) - 1 AS DOUBLE)", "cdf")} FROM c"""


def histogram_buckets(spark, d):
    return tables.histogram(readings(spark, d), "flow", 50, ["direction"])


HIST_SQL = f"""WITH {READINGS}, e AS (SELECT direction, min(flow) AS lo, max(flow) AS hi FROM r GROUP BY direction)
SELECT direction, CAST(least(floor((flow - lo) * 50 / (hi - lo)), 49) AS BIGINT) AS bin, count(*) AS count FROM r JOIN e USING (direction) WHERE flow IS NOT NULL GROUP BY ALL"""


def missing_report(spark, d):
    out = tables.missing_report(fill.null_out(readings(spark, d)), ["flow", "occupancy", "speed", "direction"])
    return out.select("column", "missing", quantize(F.col("percent")).alias("percent"))


MISSING_SQL = f"WITH {MASKED} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {q(f'100e0 * (count(*) - count({c})) / count(*)', 'percent')} FROM m" for c in ("flow", "occupancy", "speed", "direction"))


def value_counts(spark, d):
    return tables.value_counts(readings(spark, d), "mask_hf").unionByName(tables.value_counts(readings(spark, d), "direction"))


COUNTS_SQL = f"WITH {READINGS} SELECT CAST(mask_hf AS VARCHAR) AS value, count(*) AS count FROM r GROUP BY 1 UNION ALL SELECT direction, count(*) FROM r GROUP BY 1"


def duplicate_report(spark, d):
    return tables.duplicate_report(readings(spark, d).withColumn("day", F.to_date("ts")), ["station_id", "day"])


DUP_SQL = f"WITH {READINGS} SELECT count(*) AS n_rows, count(DISTINCT (station_id, CAST(ts AS DATE))) AS n_distinct, count(*) - count(DISTINCT (station_id, CAST(ts AS DATE))) AS n_duplicates FROM r"


def group_rate(spark, d):
    return readings(spark, d).groupBy("station_id").agg(quantize(F.avg(F.col("mask_logic").cast("int")) * 100).alias("percent"))


RATE_SQL = f"WITH {READINGS} SELECT station_id, {q('avg(CAST(mask_logic AS INT)) * 100', 'percent')} FROM r GROUP BY station_id"


def non_finite(spark, d):
    rows = readings(spark, d).select((F.col("flow") * 1.0).alias("flow"), F.when(F.col("k") % 13 == 0, F.lit(float("nan"))).when(F.col("k") % 17 == 0, F.lit(float("inf"))).otherwise(F.col("speed")).alias("speed"))
    return tables.non_finite_report(rows, ["flow", "speed"])


FINITE_SQL = f"WITH {READINGS} SELECT 0::BIGINT AS nan_flow, 0::BIGINT AS inf_flow, count(*) FILTER (WHERE k % 13 = 0) AS nan_speed, count(*) FILTER (WHERE k % 13 <> 0 AND k % 17 = 0) AS inf_speed FROM r"


def station_outer_merge(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    s = table(spark, d, "supplier").groupBy((F.col("s_nationkey") + 5).alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    return tables.outer_merge(c, s, "nation", ("_d", "_topo"))


MERGE_SQL = """WITH c AS (SELECT c_nationkey AS nation, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS b FROM customer GROUP BY 1),
s AS (SELECT s_nationkey + 5 AS nation, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS b FROM supplier GROUP BY 1)
SELECT coalesce(c.nation, s.nation) AS nation, c.n AS n_d, c.b AS balance_d, s.n AS n_topo, s.b AS balance_topo FROM c FULL OUTER JOIN s ON c.nation = s.nation"""


def dedup_keep_first(spark, d):
    rows = readings(spark, d).select("event_id", "station_id", F.to_date("ts").alias("day"), "ts", "flow")
    return tables.keep_first(rows, ["station_id", "day"], ["ts", "event_id"])


FIRST_SQL = f"WITH {READINGS} SELECT event_id, station_id, CAST(ts AS DATE) AS day, ts, flow FROM r QUALIFY row_number() OVER (PARTITION BY station_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1"


def sets_union_except(spark, d):
    rows = readings(spark, d)
    return tables.set_report(rows.where("mask_md"), rows.where("mask_hf"), "station_id")


SETS_SQL = f"""WITH {READINGS}, a AS (SELECT DISTINCT station_id FROM r WHERE mask_md), b AS (SELECT DISTINCT station_id FROM r WHERE mask_hf)
SELECT coalesce(a.station_id, b.station_id) AS station_id, CASE WHEN b.station_id IS NULL THEN 'left' WHEN a.station_id IS NULL THEN 'right' ELSE 'both' END AS side
FROM a FULL OUTER JOIN b ON a.station_id = b.station_id"""


def top_readings(spark, d):
    return tables.top_k(readings(spark, d).where("flow IS NOT NULL").select("event_id", "station_id", "flow"), ["station_id"], [F.desc("flow"), "event_id"], 3).withColumn("rank", F.col("rank").cast("long"))


TOP_SQL = f"WITH {READINGS} SELECT event_id, station_id, flow, row_number() OVER (PARTITION BY station_id ORDER BY flow DESC, event_id) AS rank FROM r WHERE flow IS NOT NULL QUALIFY rank <= 3"


QUERIES = {
    "mask_union": (mask_union, UNION_SQL),
    "mask_overlap": (mask_overlap, OVERLAP_SQL),
    "health_decay": (health_decay, DECAY_SQL),
    "health_halflife_sweep": (health_halflife_sweep, SWEEP_SQL),
    "health_best_halflife": (health_best_halflife, BEST_SQL),
    "rule_scores": (rule_scores, RULE_SQL),
    "rule_mask": (rule_mask, f"WITH {_SCORED} SELECT event_id, coalesce(0.5e0 * s5 + 0.5e0 * s7 + 0.5e0 * s8 > 0.25e0, false) AS mask_logic FROM sc"),
    "f1_threshold_sweep": (f1_threshold_sweep, F1_SQL),
    "f1_pivot": (f1_pivot, PIVOT_SQL),
    "covariance_matrix": (covariance_matrix, COV_SQL),
    "mahalanobis_distance": (mahalanobis_distance, MD_SQL),
    "mahalanobis_mask": (mahalanobis_mask, MD_MASK_SQL),
    "knee_threshold": (knee_threshold, KNEE_SQL),
    "quantile_profile": (quantile_profile, PROFILE_SQL),
    "ecdf_values": (ecdf_values, ECDF_SQL),
    "histogram_buckets": (histogram_buckets, HIST_SQL),
    "missing_report": (missing_report, MISSING_SQL),
    "value_counts": (value_counts, COUNTS_SQL),
    "duplicate_report": (duplicate_report, DUP_SQL),
    "group_rate": (group_rate, RATE_SQL),
    "non_finite_report": (non_finite, FINITE_SQL),
    "station_outer_merge": (station_outer_merge, MERGE_SQL),
    "dedup_keep_first": (dedup_keep_first, FIRST_SQL),
    "sets_union_except": (sets_union_except, SETS_SQL),
    "top_readings": (top_readings, TOP_SQL),
}
