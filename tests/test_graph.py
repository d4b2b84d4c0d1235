import math

import pytest

from rillstone.operators import graph
from rillstone.operators.proximity import knn_join, make_grid, nearest_cell, radius_range_join


def pairs(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_topology_drops_and_misses(spark):
    ids = spark.createDataFrame([(3,), (1,), (2,), (9,)], "station_id long")
    meta = spark.createDataFrame([(3, 37.2, -122.2), (1, 37.0, -122.0), (2, None, -122.1)], "station_id long, lat double, lon double")
    edges, nodes, dropped, missing = graph.topology(ids, meta, 1)
    assert pairs(nodes) == [(1, 0), (3, 1)] and pairs(edges) == [(0, 1), (1, 0)]
    assert [r[0] for r in dropped.collect()] == [2] and [r[0] for r in missing.collect()] == [9]
    with pytest.raises(ValueError, match="coordinates"):
        graph.topology(ids, meta.where("station_id = 2"), 1)
    assert graph.topology(ids, meta.where("station_id = 1"), 5)[0].collect() == []


@pytest.mark.parametrize("metric", ["euclid", "haversine"])
def test_knn_against_all_pairs(spark, metric):
    import random

    rng = random.Random(4)
    rows = [(i, round(rng.gauss(0, 1) * 10 ** rng.randint(-2, 1), 3), 30 + round(rng.gauss(0, 1), 3)) for i in range(120)] + [(200, 1.0, 30.0), (201, 1.0, 30.0), (202, None, 1.0)]
    got = {}
    for r in knn_join(spark.createDataFrame(rows, "station_id long, lon double, lat double"), 3, metric=metric).collect():
        got.setdefault(r.station_id, {})[r.rank] = r.dist

    def dist(a, b):
        if metric == "euclid":
            return math.dist(a[1:], b[1:])
        la, lb, dl, do = math.radians(a[2]), math.radians(b[2]), math.radians(b[2] - a[2]), math.radians(b[1] - a[1])
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin(dl / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(do / 2) ** 2))

    known = [r for r in rows if r[1] is not None]
    assert set(got) == {r[0] for r in known}
    for a in known:
        want = sorted(dist(a, b) for b in known if a[0] != b[0])[:3]
        assert [got[a[0]][k] for k in (1, 2, 3)] == pytest.approx(want, abs=1e-9)
    assert got[200][1] == got[201][1] == 0


def test_reach_relaxes_and_ends_on_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node_idx long")
    edges = spark.createDataFrame([(0, 1, 0.3), (1, 2, 0.1), (0, 2, 0.9), (2, 0, 0.1), (2, 3, 0.2), (3, 4, 5.0)], "src long, dst long, length double")
    got = {(r.src, r.dst): round(r.dist, 6) for r in graph.reach_within(edges, nodes, 0.61, reverse=False).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (4, 4): 0, (0, 1): 0.3, (0, 2): 0.4, (0, 3): 0.6, (1, 2): 0.1, (1, 0): 0.2, (1, 3): 0.3, (1, 1): 0, (2, 0): 0.1, (2, 1): 0.4, (2, 3): 0.2}
    back = {(r.src, r.dst) for r in graph.reach_within(edges, nodes, 0.61).collect()}
    assert back == {(b, a) for a, b in got}
    with pytest.raises(ValueError, match="leaves"):
        graph.reach_within(edges, nodes.where("node_idx < 3"), 0.6)


def test_reach_by_distance_where_lengths_are_null(spark):
    nodes = spark.createDataFrame([(0, 37.0, -122.0, None), (1, 37.0005, -122.0, None)], "node_idx long, lat double, lon double, length double")
    edges = graph.edge_lengths(spark.createDataFrame([(1, 0)], "src long, dst long"), nodes)
    reach = graph.neighbourhoods(edges, nodes)
    assert ("5min", 0, 1) in {tuple(r) for r in reach.collect()}
    sizes = {r.horizon: r.average for r in graph.average_size(reach, 2).collect()}
    assert sizes == {"5min": 1.5, "15min": 1.5, "30min": 1.5}


def test_components_and_degrees(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (12, 10), (20, 20), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(edges, "src", "dst").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10, 20: 20}
    assert graph.connected_components(edges.limit(0), "src", "dst").collect() == []
    nodes = spark.createDataFrame([(1,), (2,), (99,)], "node_idx long")
    assert pairs(graph.degrees(edges, nodes)) == [(1, 1), (2, 2), (99, 0)]


def test_scatter_and_neighbour_mean(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node_idx long")
    rows = spark.createDataFrame([(0, 1, 2), (0, 3, 4), (1, 5, 6)], "row long, a long, b long")
    assert sorted(tuple(r) for r in graph.scatter_add(rows, nodes, ["a", "b"]).collect()) == [(0, 4, 6), (1, 5, 6), (2, 0, 0)]
    x = spark.createDataFrame([(0, 10.0, 10.0), (1, 2.0, 4.0), (2, 6.0, 8.0)], "node_idx long, a double, b double")
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.neighbour_aggregate(edges, x, ["a", "b"]).collect()) == [(0, 2.0, 4.0), (1, 8.0, 9.0), (2, 0.0, 0.0)]
    assert pairs(graph.self_loops(nodes)) == [(0, 0), (1, 1), (2, 2)]


def test_remap_leaves_out_absent_nodes(spark):
    old = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "station_id long, node_idx long")
    new = spark.createDataFrame([(30, 0), (10, 1)], "station_id long, node_idx long")
    edges = spark.createDataFrame([("5min", 0, 2), ("5min", 1, 2)], "horizon string, src long, dst long")
    assert [tuple(r) for r in graph.remap(edges, old, new).collect()] == [("5min", 1, 0)]


def test_repair_adds_both_ways(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.1), (3, 0.0, 5.0)], "station_id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert pairs(graph.repair_components(edges, points, points.where("station_id = 3").select("station_id"))) == [(1, 2), (2, 3), (3, 2)]


def test_event_edges_are_closed(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1, 23, 55)
    stations = spark.createDataFrame([(1, 37.0, -122.0), (2, 37.0 + 0.99 / 111.2, -122.0), (3, 37.0 + 1.01 / 111.1, -122.0)], "station_id long, lat double, lon double")
    events = spark.createDataFrame([(t, t + dt.timedelta(minutes=10), 37.0, -122.0)], "start_time timestamp_ntz, end_time timestamp_ntz, lat double, lon double")
    readings = spark.createDataFrame([(s, t + dt.timedelta(minutes=m)) for s in (1, 2, 3) for m in (-1, 0, 10, 11)], "station_id long, timestamp timestamp_ntz")
    got = {(r.station_id, (r.timestamp - t).total_seconds() // 60): r.in_event for r in radius_range_join(readings, stations, events).collect()}
    assert {k for k, v in got.items() if v} == {(s, m) for s in (1, 2) for m in (0, 10)} and len(got) == 12


def test_grid_and_nearest_cell(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.2, 0.1)], "station_id long, lat double, lon double")
    grid = make_grid(points, 10.0)
    d = 10 / 111.0
    rows, cols = math.ceil((0.2 + d) / d - 1e-9), math.ceil((0.1 + d) / d - 1e-9)
    assert grid.count() == rows * cols
    assert pairs(nearest_cell(points, grid)) == [(1, "grid_0"), (2, f"grid_{2 * cols + 1}")]
