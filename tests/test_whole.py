"""Queries over whole tables against brute force."""

import math
import os
from collections import Counter, defaultdict
from datetime import timedelta

import pytest

from rillstone.plans import catalog
from rillstone.plans.views import hourly, readings, stations

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_resampling_takes_every_hour(spark):
    known = {(r.direction, r.hour): r.y for r in hourly(spark, SF).collect()}
    half = timedelta(minutes=30)
    inner = {(d, t + half) for d, t in known if (d, t + 2 * half) in known}
    linear = {(r.direction, r.hour): r.y for r in QUERIES["resample_linear"](spark, SF).collect()}
    filled = {(r.direction, r.hour): r.y for r in QUERIES["resample_ffill"](spark, SF).collect()}
    grid = {(r.direction, r.hour): r.y for r in QUERIES["asfreq_grid"](spark, SF).collect()}
    assert set(linear) == set(filled) == set(grid) == set(known) | inner
    for d, t in inner:
        a, b = known[d, t - half], known[d, t + half]
        assert linear[d, t] == pytest.approx((a + b) / 2, abs=1e-5) and filled[d, t] == a and grid[d, t] is None
    assert all(grid[k] == filled[k] == y and linear[k] == pytest.approx(y, abs=1e-5) for k, y in known.items())


@pytest.fixture(scope="module")
def nearest(spark):
    """Each station's five nearest, by brute force."""
    at = {r.station_id: (r.gx, r.gy) for r in stations(spark, SF).collect()}
    return {a: sorted((b for b in at if b != a), key=lambda b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2, b))[:5] for a in at}


def test_graph_queries_take_every_edge(spark, nearest):
    both = defaultdict(set)
    for a, near in nearest.items():
        for b in near:
            both[a].add(b)
            both[b].add(a)
    want = {}
    for a in sorted(both):
        front = [a] if a not in want else []
        while front:
            x = front.pop()
            if x not in want:
                want[x] = a
                front += both[x]
    assert {r.node: r.component for r in QUERIES["connected_components"](spark, SF).collect()} == want
    assert {r.component: r["size"] for r in QUERIES["component_sizes"](spark, SF).collect()} == Counter(want.values())
    degree = Counter(x for a, near in nearest.items() for b in near for x in (a, b))
    row = QUERIES["degree_stats"](spark, SF).first()
    assert (row["mean"], row["largest"], row["ones"], row["isolated"]) == (10, max(degree.values()), 0, 0)
    assert QUERIES["graph_gaps"](spark, SF).collect() == []
    sums = defaultdict(list)
    for r in readings(spark, SF).select("station_id", "occupancy").collect():
        sums[r.station_id].append(r.occupancy)
    mean = {k: sum(v) / len(v) for k, v in sums.items()}
    got = {r.station_id: r.occupancy for r in QUERIES["neighbor_mean"](spark, SF).collect()}
    assert got == {a: pytest.approx(sum(mean[b] for b in near) / 5, abs=1e-5) for a, near in nearest.items()}


def test_incidents_are_all_readings_over_the_bound(spark):
    at = {r.station_id: (math.radians(r.lat), math.radians(r.lon)) for r in stations(spark, SF).collect()}
    rows = readings(spark, SF).select("event_id", "ts", "station_id", "mask_logic").collect()
    starts = [(r.ts, at[r.station_id][0] + math.radians(0.003), at[r.station_id][1]) for r in rows if r.mask_logic]

    def close(a, b, lat, lon):
        return 2 * 6371 * math.asin(math.sqrt(math.sin((lat - a) / 2) ** 2 + math.cos(a) * math.cos(lat) * math.sin((lon - b) / 2) ** 2)) <= 1

    want = {r.event_id: any(t <= r.ts <= t + timedelta(hours=10) and close(*at[r.station_id], lat, lon) for t, lat, lon in starts) for r in rows}
    got = {r.event_id: r.in_event for r in QUERIES["event_radius_range_join"](spark, SF).collect()}
    assert got == want and all(got[r.event_id] for r in rows if r.mask_logic)


def test_scatter_sums_every_reading(spark):
    want = Counter()
    for r in readings(spark, SF).select("station_id", "k").collect():
        want[r.station_id] += r.k
    assert {r.station_id: r.k for r in QUERIES["scatter_add"](spark, SF).collect()} == dict(want)


@pytest.mark.parametrize("name", ["rf_baseline", "neighbor_regression"])
def test_models_report_every_horizon(spark, name):
    assert {"5min", "15min", "30min"} <= {r.horizon for r in QUERIES[name](spark, SF).collect()}
