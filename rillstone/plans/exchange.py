"""Queries that write tables and read them back, and of single operators on panels and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.functions.numeric import quantize
from rillstone.operators import evaluate, features, graph, quality, tables
from rillstone.plans import forecasts, places
from rillstone.plans.views import HOURLY, READINGS, STATIONS, hourly, q, readings, stations, table
from rillstone.sources import readers, writers
from rillstone.storage import shared_dir


def _seconds(spark, d):
    """Readings at whole seconds, as the raw files have them."""
    return readings(spark, d).withColumn("timestamp", F.date_trunc("second", "ts").cast("timestamp_ntz"))


def raw_scan(spark, d):
    """Headerless positional CSV in two folders, read as one table."""
    rows = _seconds(spark, d).select(
        F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss").alias("t"), "station_id", F.lit("x").alias("skipped"), F.lit(7).alias("freeway"), "direction", F.lit("ML").alias("lane"),
        F.lit(0.5).alias("length"), "k", (F.col("k") % 101).alias("pct"), F.when(F.col("event_id") % 17 == 0, F.lit("NaN")).otherwise(F.col("flow").cast("string")).alias("flow"), "occupancy", F.col("speed").cast("string").alias("speed"), "event_id",
    )
    paths = [shared_dir(spark) for _ in range(2)]
    for n, path in enumerate(paths):
        rows.where(F.col("event_id") % 2 == n).drop("event_id").write.csv(path)
    back = readers.read_raw(spark, paths)
    return back.groupBy("station_id", "timestamp", "direction").agg(F.count(F.lit(1)).alias("n"), F.count("flow").alias("n_flow"), F.sum("samples").alias("samples"), quantize(F.sum("flow")).alias("flow"), quantize(F.sum("speed")).alias("speed"))


RAW_SQL = f"""WITH {READINGS} SELECT station_id, date_trunc('second', ts) AS "timestamp", direction, count(*) AS n, count(flow) AS n_flow, CAST(sum(k) AS BIGINT) AS samples, {q("sum(flow)", "flow")}, {q("sum(speed)", "speed")} FROM r GROUP BY ALL"""


def split_text_scan(spark, d):
    """Lines whose cells tabs or commas part."""
    path = shared_dir(spark)
    rows = readings(spark, d)
    rows.select(F.concat(F.col("event_id").cast("string"), F.lit("\t"), "direction", F.lit(","), F.coalesce(F.col("k").cast("string"), F.lit(""))).alias("value")).write.text(path)
    back = readers.read_split_text(spark, path, r"[\t,]", ["event_id", "direction", "k"])
    return back.select(F.col("event_id").cast("long").alias("event_id"), "direction", F.col("k").cast("int").alias("k"))


def delimited_scan(spark, d):
    """A tab-separated table with a header and a schema, of which three columns are read."""
    path = shared_dir(spark)
    rows = _seconds(spark, d).select("event_id", "timestamp", "direction", "k", "flow")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_delimited(spark, path, "event_id long, timestamp timestamp_ntz, direction string, k int, flow double", "\t", ["event_id", "timestamp", "flow"])


def parquet_by_day(spark, d):
    """Snappy Parquet with a folder a day, of which some columns are read back."""
    path = shared_dir(spark)
    writers.write_parquet(readings(spark, d).select("event_id", "ts", "station_id", "flow"), path, "ts")
    return readers.read_parquet(spark, path, ["event_id", "flow", "date"])


def any_scan(spark, d):
    """The same table as Parquet and as CSV, told apart by the path's extension."""
    rows = _seconds(spark, d).select("event_id", "timestamp")
    parquet, text = shared_dir(spark), shared_dir(spark) + ".csv"
    writers.write_parquet(rows, parquet)
    writers.write_csv(rows, text)
    return readers.read_any(spark, parquet).unionByName(readers.read_any(spark, text).withColumn("event_id", -F.col("event_id").cast("long")))


def file_dates(spark, d):
    """Days from the paths of files; the rows themselves lack them."""
    path = shared_dir(spark)
    readings(spark, d).select("event_id", F.date_format("ts", "MMddyyyy").alias("day")).write.partitionBy("day").csv(path)
    files = spark.read.schema("event_id long").option("recursiveFileLookup", True).csv(path)
    return readers.with_file_date(files, r"day=(\d{8})/[^/]*$")


def saved_pages(spark, d):
    """Saved pages of a JSON service, each with the features of a station."""
    path = shared_dir(spark)
    page = F.to_json(F.struct(F.collect_list(F.struct(F.struct("event_id", "k", "direction").alias("properties"))).alias("features")))
    # one page a file, as such services are saved
    pages = readings(spark, d).groupBy("station_id").agg(page.alias("value"))
    pages.repartition(64, "station_id").select("value").write.option("lineSep", "\n").text(path)
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "features array<struct<properties:struct<event_id:long,k:int,direction:string>>>")["features"]).alias("f"))
    whole = shared_dir(spark)
    one = readings(spark, d).agg(page.alias("value"))
    one.coalesce(1).write.text(whole)
    return readers.read_features(spark, whole, "event_id long, k int, direction string").intersect(rows.select("f.properties.*"))


def time_extent(spark, d):
    return readers.time_range(table(spark, d, "events"), "ts")


def metric_table(spark, d):
    """Metric rows written, appended and read back."""
    path = shared_dir(spark)
    metrics = evaluate.pooled_metrics(forecasts._last_value(spark, d))
    writers.write_metrics(evaluate.metric_rows(metrics, "r1", "test", "last_value"), path)
    writers.write_metrics(evaluate.metric_rows(metrics, "r2", "test", "last_value", notes="again"), path, append=True)
    back = readers_metrics(spark, path)
    return back.select("run_id", "model", "horizon_min", quantize(F.col("mae"), 5).alias("mae"), "n_samples", "notes")


def readers_metrics(spark, path):
    return writers.read_metrics(spark, path).withColumn("notes", F.coalesce("notes", F.lit("")))


METRIC_SQL = f"""WITH {forecasts._LV}, po AS ({forecasts._POOLED}), ru AS (SELECT unnest(['r1', 'r2']) AS run_id)
SELECT run_id, 'last_value' AS model, replace(horizon, 'min', '') AS horizon_min, mae, n AS n_samples, CASE run_id WHEN 'r2' THEN 'again' ELSE '' END AS notes FROM po, ru"""


def prediction_samples(spark, d):
    """One station's predictions in order of time, as a CSV table."""
    path = shared_dir(spark)
    rows = forecasts._last_value(spark, d).select(F.col("direction").alias("station_id"), F.col("hour").alias("timestamp"), "horizon", "prediction", "truth")
    first = rows.agg(F.min("station_id")).first()[0]
    writers.write_csv(evaluate.station_series(rows, first, "15min"), path)
    back = readers.read_delimited(spark, path, "station_id string, horizon string, timestamp timestamp_ntz, prediction double, truth double, abs_error double")
    return back.select("station_id", "timestamp", "prediction", "truth", quantize(F.col("abs_error"), 4).alias("abs_error"))


PREDICTION_SQL = f"""WITH {forecasts._LV} SELECT direction AS station_id, hour AS "timestamp", p AS prediction, t AS truth, {q("abs(p - t)", "abs_error").replace("1e6", "1e4")} FROM pr
WHERE horizon = '15min' AND direction = (SELECT min(direction) FROM pr)"""


def merge_unique(spark, d):
    """Each order with its customer, many to one."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    return tables.left_merge_unique(orders, customers, ["o_custkey"])


def _panel(spark, d):
    """The hourly panel of all directions, in reverse order of their names."""
    rows = hourly(spark, d).select(F.col("hour").alias("timestamp"), F.col("direction").alias("station_id"), F.col("y").alias("flow"), (F.col("y") * 0.5).alias("occupancy"), (F.col("y") + 1).alias("speed"))
    sky = rows.select("timestamp", "station_id", F.lit(1.5).alias("tavg"), F.lit(0.0).alias("pcpn"))
    names = sorted((r[0] for r in rows.select("station_id").distinct().collect()), reverse=True)  # a handful of directions
    return features.build_panel(rows, sky, names)


def dense_panel(spark, d):
    out = features.dense_rows(_panel(spark, d), ["flow", "occupancy", "is_weekend"])
    cents = F.transform(F.flatten("x"), lambda v: F.floor(v * 100 + 0.5).cast("string"))
    return out.select("time_idx", F.array_join(cents, ",").alias("x"))


DENSE_SQL = f"""WITH {HOURLY}, ix AS (SELECT *, dense_rank() OVER (ORDER BY hour) - 1 AS time_idx FROM g)
SELECT time_idx, string_agg(concat_ws(',', CAST(floor(y * 100 + 0.5e0) AS BIGINT), CAST(floor(y * 0.5e0 * 100 + 0.5e0) AS BIGINT), CASE WHEN isodow(hour) >= 6 THEN 100 ELSE 0 END), ',' ORDER BY direction DESC) AS x FROM ix GROUP BY time_idx"""


def strided_samples(spark, d):
    """Every third source time of the train part and of the val part."""
    train, val = features.strided_split(forecasts._total(spark, d), 6, 3)
    times = forecasts._indexed(spark, d).select("time_idx", "hour").distinct()
    part = F.when(F.col("time_idx").isin(train), "train").when(F.col("time_idx").isin(val), "val")
    return times.select("time_idx", "hour", part.alias("part")).where("part IS NOT NULL")


STRIDED_SQL = f"""WITH {HOURLY}, ti AS (SELECT DISTINCT hour, dense_rank() OVER (ORDER BY hour) - 1 AS time_idx FROM g), nt AS (SELECT count(*) - 6 AS n, least(greatest(CAST(floor((count(*) - 6) * 0.8e0) AS BIGINT), 1), count(*) - 7) AS a FROM ti)
SELECT time_idx, hour, CASE WHEN time_idx < a THEN 'train' ELSE 'val' END AS part FROM ti, nt WHERE (time_idx < a AND time_idx % 3 = 0) OR (time_idx >= a AND time_idx < n AND (time_idx - a) % 3 = 0)"""


def forest_features(spark, d):
    rows = forecasts._indexed(spark, d).withColumns({"slot": F.hour("hour") * 12, "weekday": F.weekday("hour")})
    nodes = rows.select("node_idx").distinct().count()
    out = rows.select("time_idx", "node_idx", features.forest_vector(rows, ["y"], 15, "slot", "weekday", "node_idx", nodes).alias("x"))
    return out.select("time_idx", "node_idx", *(quantize(F.col("x")[k]).alias(f"x{k}") for k in range(5)))


FOREST_SQL = f"""WITH {forecasts._INDEXED} SELECT time_idx, node_idx, {q("y", "x0")}, {q("15 / 30e0", "x1")}, {q("hour(hour) * 12 / 287e0", "x2")}, {q("(isodow(hour) - 1) / 6e0", "x3")}, {q("node_idx / CAST(greatest(1, (SELECT max(node_idx) FROM ix)) AS DOUBLE)", "x4")} FROM ix"""


def time_window(spark, d):
    return features.time_slice(hourly(spark, d), "2024-01-03", "2024-01-05", "hour").select("direction", "hour", "y")


def flat_cells(spark, d):
    return tables.flat_sample(spark, forecasts._total(spark, d), 5, 500, 3)


FLAT_SQL = f"""WITH {HOURLY}, t AS (SELECT count(DISTINCT hour) AS n FROM g), c AS (SELECT unnest(range(5 * (SELECT n FROM t))) AS id)
SELECT id // 5 AS time_idx, id % 5 AS node_idx FROM c ORDER BY ((3 * 48271 + id * 16807 + 12345) % 2147483647 * 48271 + 12345) % 2147483647, id LIMIT 500"""


def checked_split(spark, d):
    """Train and test times, once it is sure that they have none in common."""
    rows = forecasts.time_split(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    tables.assert_disjoint(train, test, ["time_idx"])
    return train.unionByName(test)


def masked_percent(spark, d):
    chosen = stations(spark, d).where("freeway < 3").select("station_id").unionByName(spark.createDataFrame([(-1,)], "station_id long"))
    out = quality.masked_percent(readings(spark, d), chosen, "mask_logic")
    return out.select("station_id", "rows", quantize(F.col("percent")).alias("percent"))


MASKED_SQL = f"""WITH {READINGS}, {STATIONS}, c AS (SELECT station_id FROM s WHERE freeway < 3 UNION ALL SELECT -1)
SELECT c.station_id, count(r.station_id) AS rows, {q("100 * avg(CAST(mask_logic AS INT))", "percent")} FROM c LEFT JOIN r USING (station_id) GROUP BY c.station_id"""


def normalization_report(spark, d):
    stats = features.station_stats(forecasts._split_samples(spark, d).where("split = 'train'"), "direction", "y", forecasts._TARGETS)
    out = features.normalization_report(stats, ["y", *forecasts._TARGETS])
    return out.select("column", "nodes", "constant", *(quantize(F.col(c)).alias(c) for c in ("mean_least", "mean_largest", "std_least", "std_largest")))


NORMALIZATION_SQL = f"""WITH {forecasts._SAMPLES}, st AS (SELECT direction, {forecasts._STATS_COLS} FROM sa WHERE split = 'train' GROUP BY 1) """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS nodes, count(*) FILTER (WHERE std_{c} <= 1e-6) AS constant, {q(f"min(mean_{c})", "mean_least")}, {q(f"max(mean_{c})", "mean_largest")}, {q(f"min(std_{c})", "std_least")}, {q(f"max(std_{c})", "std_largest")} FROM st"""
    for c in ["y", *forecasts._TARGETS]
)


def segments(spark, d):
    """Where each station's readings begin among all, sorted by station."""
    return tables.segment_offsets(readings(spark, d), "station_id")


SEGMENT_SQL = f"WITH {READINGS}, c AS (SELECT station_id, count(*) AS size FROM r GROUP BY 1) SELECT station_id, CAST(sum(size) OVER (ORDER BY station_id) - size AS BIGINT) AS start, size FROM c"


def repaired_distance(spark, d):
    """The loose stations of a topology that repair ties to their nearest others, with the length of that tie."""
    points = stations(spark, d)
    loose = points.where("freeway = 3").select("station_id")
    chain = graph.chain_edges(points.where("freeway <> 3"), ["freeway"], "abs_pm")
    fixed = graph.repair_components(chain, points, loose).exceptAll(chain)
    at = lambda p: points.select(F.col("station_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    dist = places.haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    tied = fixed.join(loose.withColumnRenamed("station_id", "src"), "src").join(at("src"), "src").join(at("dst"), "dst")
    return tied.groupBy(F.col("src").alias("station_id")).agg(quantize(F.min(dist), 5).alias("km"))


REPAIR_SQL = f"""WITH {STATIONS}, p AS (SELECT x.station_id, {places._KM.format(a="x", b="y")} AS km FROM s x JOIN s y ON x.station_id <> y.station_id WHERE x.freeway = 3)
SELECT station_id, {q("min(km)", "km").replace("1e6", "1e5")} FROM p GROUP BY station_id"""


def subgraph_by_day(spark, d):
    """The graph of the stations that report on a day, numbered from 0 each day."""
    members = readings(spark, d).select(F.to_date("ts").alias("day"), "station_id").distinct()
    return graph.induced_subgraph(places._edges(spark, d), members, "station_id", ["day"])


SUBGRAPH_SQL = f"""WITH {READINGS}, {places._EDGES}, m AS (SELECT day, station_id, row_number() OVER (PARTITION BY day ORDER BY station_id) - 1 AS i FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, station_id FROM r))
SELECT x.day, src, dst, x.i AS local_src, y.i AS local_dst FROM ed JOIN m x ON x.station_id = src JOIN m y ON y.station_id = dst AND y.day = x.day"""


def remapped_edges(spark, d):
    """Edges by position among all stations, as edges among those of three freeways."""
    points = stations(spark, d)
    old, new = graph.positions(points, "station_id"), graph.positions(points.where("freeway < 3"), "station_id")
    at = lambda p: old.select(F.col("station_id").alias(f"_{p}"), F.col("node_idx").alias(p))
    named = places._edges(spark, d).select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).join(at("src"), "_src").join(at("dst"), "_dst").select("src", "dst")
    return graph.remap(named, old, new).unionByName(graph.self_loops(new))


REMAP_SQL = f"""WITH {places._EDGES}, n AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS i FROM s WHERE freeway < 3)
SELECT x.i AS src, y.i AS dst FROM ed JOIN n x ON x.station_id = src JOIN n y ON y.station_id = dst UNION ALL SELECT i, i FROM n"""


def direct_neighbours(spark, d):
    """The first three direct neighbours of the node with the least position."""
    nodes = stations(spark, d)
    first = nodes.agg(F.min("station_id")).first()[0]
    return graph.first_neighbours(places._edges(spark, d), first, 3)


DIRECT_SQL = f"WITH {places._EDGES} SELECT row_number() OVER (ORDER BY dst) AS rank, dst AS neighbour FROM ed WHERE src = (SELECT min(station_id) FROM s) QUALIFY rank <= 3"


def capped_edges(spark, d):
    """As many edges as a plot shows."""
    return graph.first_edges(places._edges(spark, d), 300)


def neighbourhood_size(spark, d):
    nodes = places._nodes(spark, d)
    lengths = graph.edge_lengths(places._edges(spark, d), nodes)
    reach = graph.neighbourhoods(lengths, nodes, {"5min": 0.08333, "15min": 0.2501, "30min": places.LIMIT})
    return graph.average_size(reach, nodes.count()).select("horizon", quantize(F.col("average")).alias("average"))


SIZE_SQL = places.HORIZON_SQL.replace("SELECT horizon, count(*) AS pairs FROM", f"SELECT horizon, {q('count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE)', 'average')} FROM")


def plain_regression(spark, d):
    """The substitute of the model without a graph: own value and calendar only, by a linear model."""
    return forecasts._each_horizon(forecasts._forest(spark, d), lambda train, test, target: evaluate.graph_regression(train, test, ["y", "slot", "weekday"], target))


def saved_model(spark, d):
    """A model that is saved and loaded: its metrics on the test part, and how far its predictions are from the fitted one's."""
    rows = forecasts._forest(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    path = shared_dir(spark)
    fitted = evaluate.fit_regression(train, ["y", "slot", "weekday"], "y_15min")
    evaluate.save_model(fitted, path)
    loaded = evaluate.load_model(path)
    both = loaded.transform(test).withColumnRenamed("prediction", "again").drop("_x")
    both = fitted.transform(both)
    return both.agg(F.count(F.lit(1)).alias("n"), quantize(F.max(F.abs(F.col("prediction") - F.col("again")))).alias("largest_change"))


SAVED_SQL = f"WITH {forecasts._SAMPLES} SELECT count(*) AS n, 0e0 AS largest_change FROM sa WHERE split = 'test'"


def station_inference(spark, d):
    """A saved model's predictions at one time for a station and its nearest others."""
    rows = forecasts._forest(spark, d)
    path = shared_dir(spark)
    evaluate.save_model(evaluate.fit_regression(rows.where("split = 'train'"), ["y", "slot", "weekday"], "y_15min"), path)
    first = rows.agg(F.min("direction")).first()[0]
    near = rows.where(F.col("direction") > first).select("direction").distinct().orderBy("direction").limit(2).select(F.lit(first).alias("station"), F.col("direction").alias("neighbour"))
    return evaluate.predict_station(evaluate.load_model(path), rows.where("split = 'test'"), near, first, "direction", "hour").select("direction", "hour", quantize(F.col("prediction"), 3).alias("prediction"), "y_15min")


def json_documents(spark, d):
    """A small document of the run, written and read as JSON."""
    path = shared_dir(spark)
    row = hourly(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("direction").alias("nodes")).first().asDict()
    writers.write_json(spark, {"panel": row, "horizons": list(features.HORIZONS)}, path)
    parsed = F.from_json("value", "panel struct<rows:long,nodes:long>, horizons array<string>")
    return spark.read.text(path).select(parsed.alias("j")).select("j.panel.rows", "j.panel.nodes", F.array_join("j.horizons", ",").alias("horizons"))


QUERIES = {
    "raw_scan": (raw_scan, RAW_SQL),
    "split_text_scan": (split_text_scan, f"WITH {READINGS} SELECT event_id, direction, k FROM r"),
    "delimited_scan": (delimited_scan, f"""WITH {READINGS} SELECT event_id, date_trunc('second', ts) AS "timestamp", flow FROM r"""),
    "parquet_by_day": (parquet_by_day, f"WITH {READINGS} SELECT event_id, flow, CAST(ts AS DATE) AS date FROM r"),
    "any_scan": (any_scan, f"""WITH {READINGS} SELECT s * event_id AS event_id, date_trunc('second', ts) AS "timestamp" FROM r, (SELECT unnest([1, -1]) AS s)"""),
    "file_dates": (file_dates, f"WITH {READINGS} SELECT event_id, CAST(ts AS DATE) AS date FROM r"),
    "saved_pages": (saved_pages, f"WITH {READINGS} SELECT event_id, k, direction FROM r"),
    "time_extent": (time_extent, "SELECT min(ts) AS lo, max(ts) AS hi FROM events"),
    "metric_table": (metric_table, METRIC_SQL),
    "prediction_samples": (prediction_samples, PREDICTION_SQL),
    "merge_unique": (merge_unique, "SELECT o_orderkey, o_custkey, c_nationkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey"),
    "dense_panel": (dense_panel, DENSE_SQL),
    "strided_samples": (strided_samples, STRIDED_SQL),
    "forest_features": (forest_features, FOREST_SQL),
    "time_window": (time_window, f"WITH {HOURLY} SELECT direction, hour, y FROM g WHERE hour >= TIMESTAMP '2024-01-03' AND hour < TIMESTAMP '2024-01-05'"),
    "flat_cells": (flat_cells, FLAT_SQL),
    "checked_split": (checked_split, f"SELECT * FROM ({forecasts.SPLIT_SQL}) WHERE split IN ('train', 'test')"),
    "masked_percent": (masked_percent, MASKED_SQL),
    "normalization_report": (normalization_report, NORMALIZATION_SQL),
    "segments": (segments, SEGMENT_SQL),
    "repaired_distance": (repaired_distance, REPAIR_SQL),
    "subgraph_by_day": (subgraph_by_day, SUBGRAPH_SQL),
    "remapped_edges": (remapped_edges, REMAP_SQL),
    "direct_neighbours": (direct_neighbours, DIRECT_SQL),
    "capped_edges": (capped_edges, f"WITH {places._EDGES} SELECT DISTINCT src, dst FROM ed ORDER BY src, dst LIMIT 300"),
    "neighbourhood_size": (neighbourhood_size, SIZE_SQL),
    "plain_regression": (plain_regression, None),
    "saved_model": (saved_model, SAVED_SQL),
    "station_inference": (station_inference, None),
    "json_documents": (json_documents, f"WITH {HOURLY} SELECT count(*) AS rows, count(DISTINCT direction) AS nodes, '{','.join(features.HORIZONS)}' AS horizons FROM g"),
}
