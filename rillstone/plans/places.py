"""Queries of proximity joins and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.functions.geo import haversine
from rillstone.functions.numeric import quantize
from rillstone.operators import graph, proximity, tables
from rillstone.plans.views import READINGS, STATIONS, knn_sql, q, readings, stations, table

K = 5
LIMIT = 0.5001


def _knn(spark, d, k=K):
    return proximity.knn_join(stations(spark, d), k, x="gx", y="gy")


def _edges(spark, d):
    return _knn(spark, d).select(F.col("station_id").alias("src"), F.col("neighbour").alias("dst"))


def _nodes(spark, d):
    return stations(spark, d).withColumnRenamed("station_id", "node_idx")


_EDGES = f"{STATIONS}, {knn_sql(K)}, ed AS (SELECT a AS src, b AS dst FROM nn)"
_MILES = "2 * 3958.7613e0 * asin(least(1e0, sqrt(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2)))"
_KM = _MILES.replace("3958.7613e0", "6371e0")


def knn_euclid(spark, d):
    return _knn(spark, d).select("station_id", "neighbour", quantize(F.col("dist")).alias("dist"), F.col("rank").cast("long").alias("rank"))


def knn_haversine(spark, d):
    out = proximity.knn_join(stations(spark, d), 3, x="lon", y="lat", metric="haversine")
    return out.select("station_id", F.col("rank").cast("long").alias("rank"), quantize(F.col("dist"), 5).alias("dist"))


HAVERSINE_SQL = f"""WITH {STATIONS}, p AS (SELECT x.station_id, {_KM.format(a="x", b="y")} AS dist FROM s x JOIN s y ON x.station_id <> y.station_id),
k AS (SELECT station_id, dist, row_number() OVER (PARTITION BY station_id ORDER BY dist) AS rank FROM p)
SELECT station_id, rank, {q("dist", "dist").replace("1e6", "1e5")} FROM k WHERE rank <= 3"""


def embedding_knn(spark, d):
    rows = table(spark, d, "embeddings")
    out = proximity.vector_knn(rows, rows.where("vec_id % 100 = 0"), 10)
    return out.select("vec_id", "neighbour", F.col("rank").cast("long").alias("rank"), quantize(F.col("dist")).alias("dist"))


EMBEDDING_SQL = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT x.vec_id, y.vec_id AS neighbour, list_distance(x.v, y.v) AS dist FROM e x JOIN e y ON x.vec_id <> y.vec_id AND x.vec_id % 100 = 0)
SELECT vec_id, neighbour, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS rank, {q("dist", "dist")} FROM p QUALIFY rank <= 10"""


def weather_grid(spark, d):
    out = proximity.make_grid(stations(spark, d), 10.0)
    return out.select("grid_id", quantize(F.col("lat")).alias("lat"), quantize(F.col("lon")).alias("lon"))


_GRID = f"""{STATIONS}, bx AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM s),
sz AS (SELECT *, CAST(ceil((a1 - a0) / (10 / 111e0) + 1 - 1e-9) AS BIGINT) AS nr, CAST(ceil((o1 - o0) / (10 / 111e0) + 1 - 1e-9) AS BIGINT) AS nc FROM bx),
gd AS (SELECT 'grid_' || CAST(i * nc + j AS VARCHAR) AS grid_id, a0 + i * (10 / 111e0) + (10 / 111e0) / 2 AS lat, o0 + j * (10 / 111e0) + (10 / 111e0) / 2 AS lon
       FROM (SELECT *, unnest(range(nr)) AS i FROM sz), LATERAL (SELECT unnest(range(nc)) AS j))"""
GRID_SQL = f"WITH {_GRID} SELECT grid_id, {q('lat', 'lat')}, {q('lon', 'lon')} FROM gd"


def nearest_cell(spark, d):
    # a third of a cell off the stations' own lattice, so that no station is midway between cells
    grid = proximity.make_grid(stations(spark, d), 10.0).withColumns({"lat": F.col("lat") + 0.00123, "lon": F.col("lon") + 0.00217})
    return proximity.nearest_cell(stations(spark, d), grid)


CELL_SQL = f"""WITH {_GRID}, p AS (SELECT station_id, grid_id, sqrt((s.lat - gd.lat - 0.00123e0) ** 2 + (s.lon - gd.lon - 0.00217e0) ** 2) AS dist FROM s, gd)
SELECT station_id, grid_id FROM p QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY dist, grid_id) = 1"""


def event_radius_range_join(spark, d):
    """Each reading over the logical bound is the start of an incident of ten hours near its station."""
    at = readings(spark, d).where("mask_logic").join(stations(spark, d), "station_id")
    incidents = at.select(F.col("ts").alias("start_time"), F.timestamp_add("HOUR", F.lit(10), F.col("ts")).alias("end_time"), (F.col("lat") + 0.003).alias("lat"), "lon")
    return proximity.radius_range_join(readings(spark, d), stations(spark, d), incidents, 1.0, "ts").select("event_id", "in_event")


INCIDENT_SQL = f"""WITH {READINGS}, {STATIONS}, ev AS (SELECT station_id, lat + 0.003e0 AS lat, lon FROM s),
cl AS (SELECT s.station_id, ev.station_id AS other FROM s, ev WHERE {_KM.format(a="s", b="ev")} <= 1)
SELECT event_id, EXISTS (SELECT 1 FROM cl JOIN r x ON x.station_id = cl.other WHERE cl.station_id = r.station_id AND x.mask_logic AND r.ts BETWEEN x.ts AND x.ts + INTERVAL 10 HOUR) AS in_event FROM r"""


def topology(spark, d):
    rows = stations(spark, d)
    meta = rows.select("station_id", F.when(F.col("station_id") % 10 != 3, F.col("gy").cast("double")).alias("lat"), F.col("gx").cast("double").alias("lon")).where("station_id % 13 <> 5")
    edges, nodes, dropped, missing = graph.topology(rows, meta, K)
    name = lambda t, kind: t.select(F.lit(kind).alias("kind"), F.col("station_id").alias("a"), F.lit(None).cast("long").alias("b"))
    return edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(nodes.select(F.lit("node").alias("kind"), F.col("station_id").alias("a"), F.col("node_idx").alias("b"))).unionByName(name(dropped, "dropped")).unionByName(name(missing, "missing"))


TOPOLOGY_SQL = f"""WITH {STATIONS.replace("s AS (", "s0 AS (", 1)}, s AS (SELECT * FROM s0 WHERE station_id % 13 <> 5 AND station_id % 10 <> 3), {knn_sql(K)},
no AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS i FROM s)
SELECT 'edge' AS kind, x.i AS a, y.i AS b FROM nn JOIN no x ON x.station_id = nn.a JOIN no y ON y.station_id = nn.b
UNION ALL SELECT 'node', station_id, i FROM no
UNION ALL SELECT 'dropped', station_id, NULL FROM s0 WHERE station_id % 13 <> 5 AND station_id % 10 = 3
UNION ALL SELECT 'missing', station_id, NULL FROM s0 WHERE station_id % 13 = 5"""


def chain_edges_union(spark, d):
    return graph.chain_edges(stations(spark, d), ["freeway"], "abs_pm").union(_edges(spark, d)).distinct()


CHAIN_SQL = f"""WITH {_EDGES} SELECT src, dst FROM ed UNION
SELECT src, dst FROM (SELECT station_id AS src, lead(station_id) OVER (PARTITION BY freeway ORDER BY abs_pm, station_id) AS dst FROM s) WHERE dst IS NOT NULL"""


def edge_lengths(spark, d):
    out = graph.edge_lengths(_edges(spark, d), _nodes(spark, d))
    return out.select("src", "dst", quantize(F.col("length")).alias("length"))


_LENGTHS = f"""{_EDGES}, le AS (SELECT src, dst, coalesce(CASE WHEN x.length > 0 THEN x.length END, {_MILES.format(a="x", b="y")}, 1e0) AS length
  FROM ed JOIN s x ON x.station_id = src JOIN s y ON y.station_id = dst)"""


def reach_within(spark, d):
    lengths = graph.edge_lengths(_edges(spark, d), _nodes(spark, d))
    return graph.reach_within(lengths, _nodes(spark, d), LIMIT).select("src", "dst", quantize(F.col("dist")).alias("dist"))


REACH_SQL = f"""WITH RECURSIVE {_LENGTHS},
wk(src, dst, dist) AS (SELECT station_id, station_id, 0e0 FROM s UNION SELECT wk.src, le.src, wk.dist + le.length FROM wk JOIN le ON le.dst = wk.dst WHERE wk.dist + le.length <= {LIMIT}e0)
SELECT src, dst, {q("min(dist)", "dist")} FROM wk GROUP BY src, dst"""


def reach_horizons(spark, d):
    lengths = graph.edge_lengths(_edges(spark, d), _nodes(spark, d))
    out = graph.neighbourhoods(lengths, _nodes(spark, d), {"5min": 0.08333, "15min": 0.2501, "30min": LIMIT})
    return out.groupBy("horizon").agg(F.count(F.lit(1)).alias("pairs"))


HORIZON_SQL = REACH_SQL.rsplit("SELECT", 1)[0] + f"""SELECT horizon, count(*) AS pairs FROM (SELECT src, dst, min(dist) AS dist FROM wk GROUP BY src, dst)
JOIN (VALUES ('5min', 0.08333e0), ('15min', 0.2501e0), ('30min', {LIMIT}e0)) h(horizon, lim) ON dist <= lim GROUP BY horizon"""


def connected_components(spark, d):
    return graph.connected_components(_edges(spark, d), "src", "dst")


COMPONENT_SQL = f"""WITH RECURSIVE {_EDGES}, sp AS (SELECT * FROM ed), un AS (SELECT src AS a, dst AS b FROM sp UNION SELECT dst, src FROM sp),
cc(node, other) AS (SELECT a, a FROM un UNION SELECT cc.node, un.b FROM cc JOIN un ON un.a = cc.other) SELECT node, min(other) AS component FROM cc GROUP BY node"""


def component_sizes(spark, d):
    return graph.component_sizes(connected_components(spark, d))


def degree_stats(spark, d):
    out = graph.degrees(_edges(spark, d), _nodes(spark, d))
    return out.agg(quantize(F.avg("degree")).alias("mean"), F.max("degree").alias("largest"), F.count_if(F.col("degree") == 1).alias("ones"), F.count_if(F.col("degree") == 0).alias("isolated"))


DEGREE_SQL = f"""WITH {_EDGES}, sp AS (SELECT * FROM ed), en AS (SELECT src AS n FROM sp UNION ALL SELECT dst FROM sp),
dg AS (SELECT station_id, count(n) AS degree FROM s LEFT JOIN en ON n = station_id GROUP BY station_id)
SELECT {q("avg(degree)", "mean")}, max(degree) AS largest, count(*) FILTER (WHERE degree = 1) AS ones, count(*) FILTER (WHERE degree = 0) AS isolated FROM dg"""


def neighbor_mean(spark, d):
    values = readings(spark, d).groupBy("station_id").agg(F.avg("speed").alias("speed"), F.avg("occupancy").alias("occupancy"))
    out = graph.neighbour_aggregate(_edges(spark, d), values, ["speed", "occupancy"], key="station_id")
    return out.select("station_id", *(quantize(F.col(c)).alias(c) for c in ("speed", "occupancy")))


MEAN_SQL = f"""WITH {READINGS}, {_EDGES}, sp AS (SELECT * FROM ed), v AS (SELECT station_id, avg(speed) AS speed, avg(occupancy) AS occupancy FROM r GROUP BY 1)
SELECT s.station_id, {q("coalesce(avg(v.speed), 0)", "speed")}, {q("coalesce(avg(v.occupancy), 0)", "occupancy")} FROM s LEFT JOIN sp ON sp.src = s.station_id LEFT JOIN v ON v.station_id = sp.dst GROUP BY s.station_id"""


def scatter_add(spark, d):
    rows = readings(spark, d).select(F.col("station_id").alias("row"), F.col("k").cast("long").alias("k"))
    return graph.scatter_add(rows, stations(spark, d), ["k"], key="station_id")


SCATTER_SQL = f"WITH {READINGS} SELECT station_id, CAST(coalesce(sum(k), 0) AS BIGINT) AS k FROM r GROUP BY station_id"


def fanout_sample(spark, d):
    return graph.sample_neighbours(_edges(spark, d), 3, 7)


_HASH = "((((7 * 48271 + src * 16807 + 12345) % 2147483647) * 48271 + dst * 16807 + 12345) % 2147483647)"
FANOUT_SQL = f"WITH {_EDGES} SELECT src, dst FROM ed QUALIFY row_number() OVER (PARTITION BY src ORDER BY {_HASH}, dst) <= 3"


def fanout_hops(spark, d):
    return graph.sample_hops(_edges(spark, d), stations(spark, d).select("station_id").where("station_id % 10 = 0"), [3, 2], 6)


HOPS_SQL = f"""WITH {_EDGES}, a AS (SELECT src, dst FROM ed QUALIFY row_number() OVER (PARTITION BY src ORDER BY {_HASH}, dst) <= 3),
b AS (SELECT src, dst FROM ed QUALIFY row_number() OVER (PARTITION BY src ORDER BY {_HASH.replace("(7 *", "(8 *")}, dst) <= 2),
h1 AS (SELECT src AS root, src, dst FROM a WHERE src % 10 = 0)
SELECT root, 1 AS hop, src, dst FROM h1 UNION SELECT h1.root, 2, b.src, b.dst FROM h1 JOIN b ON b.src = h1.dst"""


def induced_subgraph(spark, d):
    return graph.induced_subgraph(_edges(spark, d), stations(spark, d).where("freeway < 3").select("station_id"), "station_id")


INDUCED_SQL = f"""WITH {_EDGES}, n AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS i FROM s WHERE freeway < 3)
SELECT src, dst, x.i AS local_src, y.i AS local_dst FROM ed JOIN n x ON x.station_id = src JOIN n y ON y.station_id = dst"""


def node_positions(spark, d):
    return graph.positions(stations(spark, d), "station_id")


def graph_gaps(spark, d):
    """Stations that no edge touches."""
    touched = _edges(spark, d).select(F.explode(F.array("src", "dst")).alias("station_id"))
    return tables.set_report(stations(spark, d).select("station_id"), touched, "station_id").where("side = 'left'").select("station_id")


GAPS_SQL = f"WITH {_EDGES}, sp AS (SELECT * FROM ed) SELECT station_id FROM s WHERE station_id NOT IN (SELECT src FROM sp UNION ALL SELECT dst FROM sp)"


def edge_distance(spark, d):
    """Great-circle kilometres of the first generation's chain edges."""
    chain = graph.chain_edges(stations(spark, d), ["freeway"], "abs_pm")
    at = lambda p: stations(spark, d).select(F.col("station_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    return chain.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", quantize(haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))).alias("km"))


DISTANCE_SQL = f"""WITH {STATIONS}, ch AS (SELECT src, dst FROM (SELECT station_id AS src, lead(station_id) OVER (PARTITION BY freeway ORDER BY abs_pm, station_id) AS dst FROM s) WHERE dst IS NOT NULL)
SELECT src, dst, {q(_KM.format(a="x", b="y"), "km")} FROM ch JOIN s x ON x.station_id = src JOIN s y ON y.station_id = dst"""


QUERIES = {
    "knn_euclid": (knn_euclid, f"WITH {STATIONS}, {knn_sql(K)} SELECT a AS station_id, b AS neighbour, {q('dist', 'dist')}, rank FROM nn"),
    "knn_haversine": (knn_haversine, HAVERSINE_SQL),
    "embedding_knn": (embedding_knn, EMBEDDING_SQL),
    "weather_grid": (weather_grid, GRID_SQL),
    "nearest_cell": (nearest_cell, CELL_SQL),
    "event_radius_range_join": (event_radius_range_join, INCIDENT_SQL),
    "topology": (topology, TOPOLOGY_SQL),
    "chain_edges_union": (chain_edges_union, CHAIN_SQL),
    "edge_lengths": (edge_lengths, f"WITH {_LENGTHS} SELECT src, dst, {q('length', 'length')} FROM le"),
    "reach_within": (reach_within, REACH_SQL),
    "reach_horizons": (reach_horizons, HORIZON_SQL),
    "connected_components": (connected_components, COMPONENT_SQL),
    "component_sizes": (component_sizes, f"SELECT component, count(*) AS size FROM ({COMPONENT_SQL}) GROUP BY component"),
    "degree_stats": (degree_stats, DEGREE_SQL),
    "neighbor_mean": (neighbor_mean, MEAN_SQL),
    "scatter_add": (scatter_add, SCATTER_SQL),
    "fanout_sample": (fanout_sample, FANOUT_SQL),
    "fanout_hops": (fanout_hops, HOPS_SQL),
    "induced_subgraph": (induced_subgraph, INDUCED_SQL),
    "node_positions": (node_positions, f"WITH {STATIONS} SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS node_idx FROM s"),
    "graph_gaps": (graph_gaps, GAPS_SQL),
    "edge_distance": (edge_distance, DISTANCE_SQL),
}
