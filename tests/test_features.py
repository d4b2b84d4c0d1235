import datetime as dt
import random

import pytest

from rillstone.functions.numeric import ordered_mean
from rillstone.functions.timeslots import federal_holidays, with_calendar
from rillstone.operators import evaluate, features, quality, tables
from rillstone.streaming import windows

T0 = dt.datetime(2024, 1, 1)


def at(k):
    return T0 + dt.timedelta(minutes=5 * k)


def panel_tables(spark):
    flow = {1: 10.0, 2: 20.0, 3: 30.0}
    interp = [(at(k), s, v + k, 0.1, 50.0) for k in range(2) for s, v in flow.items()]
    sky = [(at(0), 1, 101.0, 1.1), (at(0), 2, 202.0, 2.2), (at(1), 1, 111.0, 1.3), (at(1), 2, 212.0, 2.4)]
    return spark.createDataFrame(interp, "timestamp timestamp_ntz, station_id long, flow double, occupancy double, speed double"), spark.createDataFrame(sky, "timestamp timestamp_ntz, station_id long, tavg double, pcpn double")


def test_panel(spark):
    interp, sky = panel_tables(spark)
    panel = features.build_panel(interp, sky, [2, 1])
    x = {r.time_idx: r.x for r in features.dense_rows(panel).collect()}
    assert [c[3] for c in x[0]] == [202.0, 101.0] and [c[4] for c in x[1]] == [2.4, 1.3] and len(x) == 2
    assert sorted((r.time_idx, r.y) for r in panel.where("node_idx = 0").collect()) == [(0, 20.0), (1, 21.0)]
    with pytest.raises(ValueError, match="grid_id.*station_id.*mapping"):
        features.build_panel(interp, sky.withColumnRenamed("station_id", "grid_id"), [2, 1])
    with pytest.raises(ValueError, match="missing"):
        features.build_panel(interp, sky, [2, 7])


def test_splits():
    assert features.split_bounds(8064) == (8058, 5640, 6849)
    assert features.split_bounds(20) == (14, 9, 11)
    assert features.strided_split(21, 6, 2, 3, 2) == ([0, 2, 4], [12, 14])
    parts = [features.flat_batches([10, 20, 30], 3, r, 2) for r in (0, 1)]
    assert sorted(parts[0] + parts[1]) == [(t, b) for t in (10, 20, 30) for b in range(3)] and not set(parts[0]) & set(parts[1])


def test_stats_and_inverse(spark):
    rows = [(n, k, v, y) for n, vs, ys in ((0, [1.0, 3.0, 5.0], [1.0, 2.0, 3.0]), (1, [10.0, 14.0, 18.0], [10.0, 12.0, 14.0])) for k, (v, y) in enumerate(zip(vs, ys, strict=True))]
    df = spark.createDataFrame(rows, "node long, time_idx long, x double, y double")
    sup = features.supervised(df, "node", "time_idx", "y", {"h": 1})
    stats = features.station_stats(sup.where("time_idx < 2"), "node", "x", ["y_h"])
    got = {r.node: r for r in stats.collect()}
    assert [got[n].mean_x for n in (0, 1)] == [2.0, 12.0] and [got[n].mean_y_h for n in (0, 1)] == [2.5, 13.0]
    norm = {(r.node, r.time_idx): r.x for r in features.normalize(sup, stats, "node", ["x"]).collect()}
    assert norm[0, 0] == norm[1, 0] == -1.0
    back = features.denormalize(spark.createDataFrame([(0, 0.0), (1, 1.0)], "node long, p double"), stats, "node", "p", "y_h")
    assert sorted(r.p for r in back.collect()) == [2.5, 14.0]


def test_leakage_raises(spark):
    df = spark.createDataFrame([(0, k, float(k + 1), float(k)) for k in range(30)], "node long, t long, x double, y double")
    with pytest.raises(ValueError, match="target"):
        features.leakage_audit(df, "node", ["t"], "x", "y")
    assert features.leakage_audit(df, "node", ["t"], "y", "y").first().same_rate == 1.0


def test_ablation_and_override(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 5.0, 6.0), (2, 100.0, 100.0)], "t long, tavg double, pcpn double")
    out = features.ablate(df, df.where("t < 2"), ["tavg", "pcpn"]).collect()
    assert {(r.tavg, r.pcpn) for r in out} == {(3.0, 4.0)}
    assert [r.tavg for r in features.override(df, "t", 1, {"tavg": 12.5}).orderBy("t").collect()] == [1.0, 12.5, 100.0]


def test_lookup_errors(spark):
    nodes = spark.createDataFrame([(10, 0), (30, 1)], "station_id long, node_idx long")
    assert features.resolve_node(nodes, station=30) == (30, 1) and features.resolve_node(nodes, node_idx=0) == (10, 0)
    for kw in ({}, {"station": 10, "node_idx": 0}):
        with pytest.raises(ValueError):
            features.resolve_node(nodes, **kw)
    with pytest.raises(KeyError):
        features.resolve_node(nodes, station=11)
    with pytest.raises(ValueError, match="empty"):
        features.time_slice(spark.createDataFrame([(at(0),)], "timestamp timestamp_ntz"), at(5))


def test_rolling_zscore_warms_up(spark):
    df = spark.createDataFrame([(0, k, float(k % 7)) for k in range(20)], "node long, t long, v double")
    got = [r.z_v for r in features.rolling_zscore(df, ["v"], "node", ["t"], 10, 5).orderBy("t").collect()]
    assert got[:4] == [None] * 4 and got[4] == pytest.approx((4 - 2) / 1.5811388300841898)


def test_history_keeps_nulls(spark):
    df = spark.createDataFrame([(0, k, None if k == 1 else float(k)) for k in range(4)], "node long, t long, v double")
    assert [r.history for r in features.history(df, "v", "node", ["t"], 3).orderBy("t").collect()] == [[0.0, None, 2.0], [None, 2.0, 3.0]]


def test_metrics(spark):
    df = spark.createDataFrame([("5min", 2.0, 1.0), ("5min", 4.0, 2.0), ("15min", 0.5, 0.0), ("15min", None, 1.0)], "horizon string, prediction double, truth double")
    got = {r.horizon: r for r in evaluate.pooled_metrics(df).collect()}
    assert (got["5min"].mae, got["5min"].rmse, got["5min"].mape, got["5min"].n) == (1.5, pytest.approx(2.5**0.5), 100.0, 2)
    assert got["15min"].mape == 50.0 and got["all"].n == 3 and got["all"].mae == pytest.approx(3.5 / 3)


def test_scaling_and_ablation_reports(spark):
    epochs = spark.createDataFrame([(1, "train", 10.0, None), (2, "train", 6.0, None)], "world_size int, phase string, phase_time_sec double, notes string")
    assert {r.world_size: r.speedup for r in evaluate.scaling_report(epochs).collect()} == {1: 1.0, 2: pytest.approx(10 / 6)}
    skipped = evaluate.scaling_report(epochs.where("world_size = 2").selectExpr("world_size", "phase", "phase_time_sec", "'skipped_by_config' AS notes")).first()
    assert skipped.speedup is None and skipped.notes == "skipped_by_config"
    none = spark.createDataFrame([], evaluate.METRIC_SCHEMA)
    rows = evaluate.ablation_report(none, ["without_graph_neighbors"]).collect()
    assert [r.notes for r in rows] == ["not_available"] * 4 and {r.horizon_min for r in rows} == {"5", "15", "30", "all"}


def test_holidays():
    days = federal_holidays(2022)
    assert dt.date(2022, 1, 17) in days and dt.date(2022, 11, 24) in days and dt.date(2022, 12, 26) in days and dt.date(2022, 5, 30) in days
    assert dt.date(2021, 12, 31) in days and dt.date(2021, 12, 31) not in federal_holidays(2021)


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 7, 4, 12, 7),), (dt.datetime(2024, 7, 6),)], "timestamp timestamp_ntz")
    got = with_calendar(df).orderBy("timestamp").collect()
    assert [(r.slot, r.weekday, r.is_weekend, r.is_holiday) for r in got] == [(145, 3, False, True), (0, 5, True, False)]


def test_decay_and_knee(spark):
    labels = quality.snapshot_labels(*(spark.createDataFrame(r, s) for r, s in (([(1,), (2,)], "station_id int"), ([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 3),)], "slice_date date"), ([(1, dt.date(2024, 1, 1))], "station_id int, slice_date date"))))
    got = {(r.station_id, r.date.day): r.score for r in quality.health_decay(labels, spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 1, 3),)], "date date"), 1.0).collect()}
    assert got[1, 2] == pytest.approx(-0.05) and got[1, 3] == pytest.approx((0.9 * 0.25 - 1) / 1.25) and got[2, 2] == -1.0
    far = quality.health_decay(labels, spark.createDataFrame([(dt.date(2044, 1, 2),)], "date date"), 0.5)
    assert {r.score for r in far.collect()} == {None}
    values = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 2.0, 10.0)] + [("b", 3.0), ("b", 3.0), ("c", None)], "g string, v double")
    assert {r.g: r.threshold for r in quality.knee_threshold(values, "v", ["g"]).collect()} == {"a": 2.0, "b": 3.0}


def test_small_groups_have_no_distance(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 1.0), (1, 1.0, 1.0), (1, 3.0, 2.0), (1, 2.0, 5.0), (1, None, 1.0)], "g int, a double, b double")
    got = quality.mahalanobis(df, ["a", "b"], "g").collect()
    assert all(r.md_squared == 0 for r in got if r.g == 0) and sum(r.md_squared for r in got if r.g == 1) == pytest.approx(6.0, rel=1e-3)


def test_isolated_zero_needs_both_sides(spark):
    df = spark.createDataFrame([(1, at(k), f, 0.0 if f == 0 else 1.0, 1.0, 5) for k, f in enumerate([1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0])], "station_id int, timestamp timestamp_ntz, flow double, occupancy double, speed double, samples long")
    assert [r.s8 for r in quality.rule_scores(df).orderBy("timestamp").collect()] == [0, 0, 1, 0, 0, 0, 0]


def test_unique_merge_and_samples(spark):
    left, right = spark.createDataFrame([(1, None), (2, "a")], "k int, d string"), spark.createDataFrame([(1, None, 5), (2, "b", 6)], "k int, d string, v int")
    assert sorted((r.k, r.v) for r in tables.left_merge_unique(left, right, ["k", "d"]).collect()) == [(1, 5), (2, None)]
    with pytest.raises(ValueError, match="unique"):
        tables.left_merge_unique(left, right.union(right), ["k", "d"])
    ids = spark.range(10_000)
    assert 800 < tables.hash_sample(ids, ["id"], 0.1).count() < 1200


def test_streaming_windows_and_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, at(0), 1.0), (1, at(1), None), (2, at(1), 4.0), (1, at(30), 2.0)], "station_id long, timestamp timestamp_ntz, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windows.tumbling(stream, "timestamp", "5 minutes", ["station_id"], "value", "10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = windows.tumbling(rows, "timestamp", "5 minutes", ["station_id"], "value")
    assert sorted((r.station_id, r.n, r.total or 0) for r in spark.table("tumbled").collect()) == sorted((r.station_id, r.n, r.total or 0) for r in batch.collect())
    pytest.importorskip("pandas")
    query = windows.running_fill(stream, "station_id", "timestamp", "value").writeStream.format("memory").queryName("carried").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.station_id, r.filled) for r in spark.table("carried").collect()) == [(1, 1.0), (1, 1.0), (1, 2.0), (2, 4.0)]


def test_late_rows_under_a_watermark(spark, tmp_path):
    """A row older than the watermark of an earlier batch is left out, one within it counts."""
    schema = "station_id long, timestamp timestamp_ntz, value double"
    path = str(tmp_path / "late")
    batch = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    batch([(1, at(0), 1.0), (1, at(12), 2.0)])  # 0:00 and 1:00
    stream = spark.readStream.schema(schema).parquet(path)
    query = windows.tumbling(stream, "timestamp", "10 minutes", ["station_id"], "value", "10 minutes").writeStream.format("memory").queryName("late_rows").outputMode("append").start()
    try:
        query.processAllAvailable()
        batch([(1, at(1), 100.0), (1, at(11), 4.0)])  # 0:05 is before 1:00 less ten minutes, 0:55 isn't
        query.processAllAvailable()
        batch([(1, at(60), 0.0)])
        query.processAllAvailable()
        got = {r.window_start.replace(tzinfo=None): (r.n, r.total) for r in spark.sql("SELECT * FROM late_rows").collect()}
    finally:
        query.stop()
    assert got == {at(0): (1, 1.0), at(10): (1, 4.0), at(12): (1, 2.0)}


def test_first_neighbours_flat_cells_and_assertions(spark):
    from rillstone.operators import graph

    edges = spark.createDataFrame([(1, 5), (1, 3), (1, 3), (1, 9), (2, 1)], "src long, dst long")
    assert [tuple(r) for r in graph.first_neighbours(edges, 1, 2).collect()] == [(1, 3), (2, 5)] and graph.first_neighbours(edges, 7, 2).collect() == []
    assert [tuple(r) for r in graph.first_edges(edges, 2).collect()] == [(1, 3), (1, 5)]
    cells = [tuple(r) for r in tables.flat_sample(spark, 6, 4, 10, 1).collect()]
    assert len(set(cells)) == 10 and all(0 <= t < 6 and 0 <= n < 4 for t, n in cells) and len(tables.flat_sample(spark, 2, 2, 10).collect()) == 4
    tables.assert_disjoint(edges.where("src = 1"), edges.where("src = 2"), ["src"])
    with pytest.raises(ValueError, match="disjoint"):
        tables.assert_disjoint(edges, edges.where("src = 2"), ["src", "dst"])


def test_running_counts_and_quantiles(spark):
    import random

    import numpy as np

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[round(rng.gauss(0, 3), 1) for _ in range(9)]])) for _ in range(400)] + [("only", None), ("one", 2.5)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"a": 0.01, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0}
    groups = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows}}
    got = {r.g: [r[n] for n in shares] for r in tables.quantiles(frame, "v", shares, ["g"]).collect()}
    assert got.keys() == {g for g, vs in groups.items() if vs}
    for g, values in got.items():
        assert values == pytest.approx([float(np.quantile(groups[g], q)) for q in shares.values()])
    every = sorted(v for _, v in rows if v is not None)
    assert list(tables.quantiles(frame, "v", shares).first()) == pytest.approx([float(np.quantile(every, q)) for q in shares.values()])
    counts = {(r.g, r.value): (r.c, r.upto, r.n) for r in tables.running_counts(frame, "v", ["g"]).collect()}
    assert counts == {(g, v): (vs.count(v), sum(x <= v for x in vs), len(vs)) for g, vs in groups.items() for v in set(vs)}
    empty = frame.limit(0)
    assert tables.running_counts(empty, "v", ["g"]).collect() == [] and tables.quantiles(empty, "v", shares).first()["b"] is None
    described = {r.g: r.asDict() for r in tables.describe(frame, "v", ["g"]).collect()}
    assert described["only"]["count"] == 0 and described["only"]["q50"] is None and described[None]["q50"] == pytest.approx(float(np.median(groups[None])))


def test_no_window_without_partitions_over_values(spark):
    """Quantiles, CDFs and knees have no window over a whole group's values in their plans."""
    frame = spark.createDataFrame([("a", float(k)) for k in range(50)], "g string, v double")
    for out in (tables.ecdf(frame, "v", ["g"]), tables.quantiles(frame, "v", {"m": 0.5}), quality.knee_threshold(frame, "v", ["g"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "SinglePartition, ENSURE_REQUIREMENTS" not in "".join(line for line in plan.splitlines() if "value" in line)


def test_sweep_rejects_large_grids_and_counts_like_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    rows = [(k % 7, k % 3, rng.choice([None, 0.0, 0.2, 0.9]), rng.random(), rng.randint(0, 1), rng.choice([True, False, None])) for k in range(300)]
    frame = spark.createDataFrame(rows, "station_id long, date long, s5 double, s7 double, s8 int, true_bad boolean")
    grid = [(a, b, c, t) for a, b, c in itertools.product((0.0, 0.5, 1.0), repeat=3) for t in (0.1, 0.4, 0.7)]
    got = {(r.a5, r.a7, r.a8, r.threshold): (r.f1_time, r.f1_day) for r in quality.f1_sweep(frame, spark.createDataFrame(grid * 2, "a5 double, a7 double, a8 double, threshold double")).collect()}

    def f1(pairs):
        tp, fp, fn = (sum(t == x and p == y for t, p in pairs) for x, y in ((True, True), (False, True), (True, False)))
        return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0

    assert got.keys() == set(grid)
    for a, b, c, t in grid:
        flags = [((s, d), bool(y), s5 is not None and a * s5 + b * s7 + c * s8 > t) for s, d, s5, s7, s8, y in rows]
        days = {k: (any(y for j, y, _ in flags if j == k), any(p for j, _, p in flags if j == k)) for k in {k for k, _, _ in flags}}
        assert got[a, b, c, t] == pytest.approx((f1([f[1:] for f in flags]), f1(list(days.values()))))
    with pytest.raises(ValueError, match="grid"):
        quality.f1_sweep(frame, spark.range(5000).selectExpr("double(id) a5", "0d a7", "0d a8", "0d threshold"))


def test_distances_of_too_many_groups(spark):
    frame = spark.range(100).selectExpr("id g", "double(id) a", "double(id * id) b")
    with pytest.raises(ValueError, match="groups"):
        quality.mahalanobis(frame, ["a", "b"], "g")


def test_saved_models_and_station_inference(spark, tmp_path):
    rows = spark.createDataFrame([(s, at(k), float(k), 2.0 * k + 1) for s in (1, 2, 3) for k in range(20)], "station_id long, timestamp timestamp_ntz, x double, y double")
    evaluate.save_model(evaluate.fit_regression(rows, ["x"], "y", 0.0), str(tmp_path / "m"))
    model = evaluate.load_model(str(tmp_path / "m"))
    near = spark.createDataFrame([(1, 3), (2, 1)], "station long, neighbour long")
    got = sorted((r.station_id, r.timestamp, round(r.prediction, 6)) for r in evaluate.predict_station(model, rows, near, 1).collect())
    assert got == [(1, at(19), 39.0), (3, at(19), 39.0)]
    with pytest.raises(KeyError):
        evaluate.predict_station(model, rows, near, 9)


def test_decay_against_all_pairs(spark):
    """Far labels whose weights only count against one another, several labels a day, and days before and after all of them."""
    import math
    import random

    rng = random.Random(6)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    rows = [(s, rng.choice([0, 3, 9, 200, 201, 900]), rng.choice([0.9, -1.0])) for s in range(6) for _ in range(7)] + [(50, 400, 0.9)]
    labels = spark.createDataFrame([(s, day(k), v) for s, k, v in rows], "station_id long, slice_date date, li double")
    calendar = [-400, 0, 1, 5, 150, 200, 500, 901]
    for h in (0.5, 14.0):
        weight = lambda a, b, h=h: math.exp(-math.log(2) / h * abs(a - b))
        got = {(r.station_id, r.date): r.score for r in quality.health_decay(labels, spark.createDataFrame([(day(k),) for k in calendar], "date date"), h).collect()}
        assert len(got) == 7 * len(calendar)
        for s in {r[0] for r in rows}:
            for k in calendar:
                den = sum(weight(k, j) for t, j, _ in rows if t == s)
                want = sum(weight(k, j) * v for t, j, v in rows if t == s) / den if den else None
                assert (got[s, day(k)] is None) == (want is None) and (want is None or got[s, day(k)] == pytest.approx(want, abs=1e-9))
    for exclude in (False, True):
        got = {r.half_life: (r.mid, r.ext) for r in quality.half_life_sweep(labels, [0.5, 7.0], exclude_snapshots=exclude).collect()}
        for h in (0.5, 7.0):
            errors = {"mid": [], "ext": []}
            for s, k, v in set(rows):
                pairs = [(j, u) for t, j, u in rows if t == s and not (exclude and j == k)]
                den = sum(math.exp(-math.log(2) / h * abs(j - k)) for j, _ in pairs)
                if den:
                    errors["ext" if k in (0, 900) else "mid"].append((sum(math.exp(-math.log(2) / h * abs(j - k)) * u for j, u in pairs) / den - v) ** 2)
            assert got[h] == pytest.approx(tuple(sum(e) / len(e) for e in errors.values()))


def test_carrying_by_a_stateful_processor(spark, tmp_path):
    schema, path = "station_id long, timestamp timestamp_ntz, value double", str(tmp_path / "carried")
    batch = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    batch([(1, at(1), None), (1, at(0), 2.0), (2, at(0), None)])
    stream = spark.readStream.schema(schema).parquet(path)
    name = "spark.sql.streaming.stateStore.providerClass"
    with pytest.raises(ValueError, match="providerClass"):
        windows.running_fill_with_state(stream, "station_id", "timestamp", "value")
    before = spark.conf.get(name)
    spark.conf.set(name, windows.STATE_STORE)
    try:
        query = windows.running_fill_with_state(stream, "station_id", "timestamp", "value").writeStream.format("memory").queryName("kept_state").outputMode("append").start()
        try:
            query.processAllAvailable()
            batch([(1, at(2), None), (2, at(1), 5.0), (2, at(2), None), (3, at(2), None)])
            query.processAllAvailable()
            got = {(r.station_id, r.timestamp): r.filled for r in spark.sql("SELECT * FROM kept_state").collect()}
        finally:
            query.stop()
    finally:
        spark.conf.set(name, before)
    assert got == {(1, at(0)): 2.0, (1, at(1)): 2.0, (1, at(2)): 2.0, (2, at(0)): None, (2, at(1)): 5.0, (2, at(2)): 5.0, (3, at(2)): None}


def test_ordered_mean_does_not_depend_on_partitions(spark):
    """Means that are exactly 0.3: their last bit is that of the sum by id."""
    rng = random.Random(7)
    rows, want = [], {}
    for g in range(300):
        ks = [rng.randint(0, 60) for _ in range(12)]
        ks += [60 - k for k in ks]
        rng.shuffle(ks)
        rows += [(g, i, k / 100.0) for i, k in enumerate(ks)]
        total = 0.0
        for k in ks:
            total += k / 100.0
        want[g] = total / len(ks)
    rows += [(300, 0, None), (301, 0, None), (301, 1, 0.25)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, x double")
    for parts in (1, 7):
        got = {r.g: r.m for r in df.repartition(parts).groupBy("g").agg(ordered_mean("x", "i").alias("m")).collect()}
        assert got == want | {300: None, 301: 0.25}
