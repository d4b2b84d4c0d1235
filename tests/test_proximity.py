import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from rillstone.operators.proximity import knn_join, radius_range_join, vector_knn


def km(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def nearest(rows, k, dist):
    return {a[0]: sorted((dist(a[1:], b[1:]), b[0]) for b in rows if b[0] != a[0])[:k] for a in rows}


def search(spark, rows, k, **options):
    got = {}
    for r in knn_join(spark.createDataFrame(rows, "station_id long, lon double, lat double").repartition(3), k, **options).collect():
        got.setdefault(r.station_id, {})[r.rank] = (r.dist, r.neighbour)
    return {i: [ranks[n] for n in sorted(ranks)] for i, ranks in got.items()}


def test_across_180_degrees_and_the_poles(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-180, 180), rng.gauss(0, 2)) for i in range(150)] + [(1000, 179.99, 0.0), (1001, -179.99, 0.01), (1002, 180.0, 0.02)]
    rows += [(2000 + i, rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(88, 90)) for i in range(40)]
    got, want = search(spark, rows, 3, metric="haversine"), nearest(rows, 3, km)
    assert got[1000][0][1] == 1002 and got.keys() == want.keys()
    for i in want:
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in want[i]], abs=1e-6)


@pytest.mark.parametrize("dense", [1, 64])
def test_dense_places(spark, dense):
    """Most points in a tiny place, many at the very same one, and few far away."""
    rng = random.Random(2)
    rows = [(i, 10 + rng.randint(0, 40) * 1e-6, 50 + rng.randint(0, 40) * 1e-6) for i in range(150)] + [(500 + i, 10.5, 50.5) for i in range(60)] + [(900 + i, rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(20)]
    got, want = search(spark, rows, 4, dense=dense), nearest(rows, 4, math.dist)
    assert got.keys() == want.keys()
    for i in want:
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in want[i]], abs=1e-12)
        exact = [n for d, n in want[i] if d == 0]
        assert [n for d, n in got[i] if d == 0] == exact


def test_radius_join_across_180_degrees(spark):
    t = datetime(2024, 1, 1)
    stations = spark.createDataFrame([(1, 0.0, 179.999), (2, 0.0, 179.9), (3, 89.9999, 10.0), (4, -0.001, -179.999)], "station_id long, lat double, lon double")
    events = spark.createDataFrame([(t, t + timedelta(hours=1), 0.0, -179.999), (t, t + timedelta(hours=1), 89.9999, -170.0)], "start_time timestamp_ntz, end_time timestamp_ntz, lat double, lon double")
    readings = spark.createDataFrame([(i, t) for i in (1, 2, 3, 4)], "station_id long, timestamp timestamp_ntz")
    assert {r.station_id: r.in_event for r in radius_range_join(readings, stations, events).collect()} == {1: True, 2: False, 3: True, 4: True}


def brute(vectors, queries, k):
    out = {}
    for i, q in queries:
        best = {}
        for j, v in vectors:
            if j != i and i is not None and j is not None and q is not None and v is not None and len(q) == len(v) and not any(x is None or math.isnan(x) for x in [*q, *v]):
                best[j] = min(best.get(j, math.inf), math.dist(q, v))
        for j, d in best.items():
            out.setdefault(i, {})[j] = min(out.get(i, {}).get(j, math.inf), d)
    return {i: [(j, d) for d, j in sorted((d, j) for j, d in near.items())[:k]] for i, near in out.items()}


def test_vectors_of_several_lengths_and_repeated_keys(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5 if i % 7 else 3).tolist()) for i in range(120)] + [(500, [0.0] * 5), (501, [0.0] * 5)]
    rows += [(3, rows[3][1]), (4, rng.normal(size=5).tolist()), (None, [1.0] * 5), (600, None), (601, [1.0, None, 2.0, 3.0, 4.0]), (602, [float("nan")] * 5), (603, [])]
    asked = [*rows[:40], *rows[120:], (700, [1.0] * 4), (3, rows[3][1])]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(3)
    for block, chunk in ((1024, 4096), (3, 7)):
        got = {}
        for r in vector_knn(frame(rows), frame(asked), 4, block=block, chunk=chunk).collect():
            got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour, r.dist)
        got = {i: [ranks[n] for n in sorted(ranks)] for i, ranks in got.items()}
        want = brute(rows, asked, 4)
        assert got.keys() == want.keys()
        for i in want:
            assert [n for n, _ in got[i]] == [n for n, _ in want[i]] and [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]], abs=1e-12)
    assert vector_knn(frame(rows).limit(0), frame(asked), 4).collect() == [] and vector_knn(frame(rows), frame(asked).limit(0), 4).collect() == []
