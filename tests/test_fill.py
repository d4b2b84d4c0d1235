import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillstone.operators import fill

T0 = dt.datetime(2024, 1, 1)
FEATURES = ["flow", "occupancy", "speed"]


def at(k, minutes=5):
    return T0 + dt.timedelta(minutes=minutes * k)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize(
    ("flow", "mask", "want"),
    [([1.0, None, 3.0, None], [0, 1, 0, 1], [1.0, 2.0, 3.0, 2.0]), ([None, None], [1, 1], [None, None]), ([5.0, 10.0], [0, 0], [5.0, 10.0])],
)
def test_group_mean(spark, flow, mask, want):
    df = frame(spark, [(i, "N", f, bool(m)) for i, (f, m) in enumerate(zip(flow, mask, strict=True))], "id int, g string, flow double, mask_flag boolean")
    assert column(fill.group_mean_fill(df, ["flow"], ["g"]), "flow") == want


SERIES = "id int, station_id int, direction string, timestamp timestamp_ntz, flow double, mask_flag boolean"


@pytest.mark.parametrize(
    ("flow", "mask", "want"),
    [([10.0, None, None, 40.0], [0, 1, 1, 0], [10.0, 20.0, 30.0, 40.0]), ([10.0, None, None, None], [0, 1, 1, 1], [10.0, None, None, None]), ([10.0, 20.0, 30.0, 40.0], [0, 0, 0, 0], [10.0, 20.0, 30.0, 40.0]), ([None, 20.0, 30.0, None], [1, 0, 0, 1], [20.0, 20.0, 30.0, 30.0])],
)
def test_interpolation_needs_two_points(spark, flow, mask, want):
    df = frame(spark, [(i, 1, "N", at(i), f, bool(m)) for i, (f, m) in enumerate(zip(flow, mask, strict=True))], SERIES)
    assert column(fill.interp_fill(df, ["flow"], ["station_id", "direction"], "timestamp"), "flow") == want


def test_bracket_holds_one_side_and_ties(spark):
    df = frame(spark, [(0, 1, None, at(0), None, True), (1, 1, None, at(1), 4.0, False), (2, 1, None, at(1), None, True), (3, 1, None, at(1), 8.0, False), (4, 1, None, at(3), None, True)], SERIES)
    out = fill.bracket_interpolate(df, ["flow"], ["station_id", "direction"], "timestamp", tie=["id"])
    assert column(out, "flow") == [4.0, 4.0, 4.0, 8.0, 8.0]


RAW = "timestamp timestamp_ntz, station_id int, direction string, flow double, occupancy double, speed double, mask_logic boolean"


def local(spark, rows):
    masked = fill.null_out(frame(spark, rows, RAW), FEATURES, ["mask_logic"])
    pairs = frame(spark, [(100, 200), (100, 300)], "station_id int, neighbour int")
    out = fill.local_fill(masked, pairs)
    return {(r.station_id, r.timestamp): (r.flow_local, r.occupancy_local, r.speed_local) for r in out.collect()}


def test_local_uses_the_same_time_only(spark):
    rows = [(at(0), 100, "N", 999.0, 9.99, 999.0, True), (at(0), 200, "N", 20.0, 0.2, 55.0, False), (at(1), 300, "N", 300.0, 3.0, 300.0, False)]
    assert local(spark, rows)[100, at(0)] == (20.0, 0.2, 55.0)
    rows[1] = (at(1), 200, "N", 20.0, 0.2, 55.0, False)
    assert local(spark, rows)[100, at(0)] == (None, None, None)


def test_a_null_feature_masks_the_row(spark):
    out = fill.null_out(frame(spark, [(at(0), 1, "N", 1.0, None, 3.0, None)], RAW), FEATURES, ["mask_logic"]).first()
    assert out.mask_flag and (out.flow, out.occupancy, out.speed) == (None, None, None)


def refill_tables(spark, raw, mask, interp, schema="timestamp timestamp_ntz, station_id int, flow double, occupancy double, speed double"):
    return frame(spark, raw, schema), frame(spark, mask, "timestamp timestamp_ntz, station_id int, mask_logic boolean"), frame(spark, interp, schema)


def test_refill_takes_the_mean_of_the_time(spark):
    raw, mask, interp = refill_tables(spark, [(at(0), 100, 999.0, 9.9, 999.0), (at(0), 200, 20.0, 0.2, 55.0)], [(at(0), 100, True)], [(at(0), 100, None, None, None), (at(0), 200, 20.0, 0.2, 55.0)])
    got = {r.station_id: (r.flow_interp, r.occupancy_interp, r.speed_interp) for r in fill.refill(raw, mask, interp).collect()}
    assert got == {100: (20.0, 0.2, 55.0), 200: (20.0, 0.2, 55.0)}


def test_refill_of_repeated_keys(spark):
    raw, mask, interp = refill_tables(
        spark,
        [(at(0), 100, 1.0, 0.1, 50.0), (at(0), 100, 1.0, 0.1, 50.0), (at(0), 200, 20.0, 0.2, 50.0)],
        [(at(0), 100, True), (at(0), 100, True)],
        [(at(0), 100, None, None, None), (at(0), 200, 20.0, 0.2, 50.0), (at(0), 200, 24.0, 0.24, 54.0)],
    )
    rows = fill.refill(raw, mask, interp).collect()
    got = next(r for r in rows if r.station_id == 100)
    assert len(rows) == 2 and got.flow_interp == 22.0 and got.occupancy_interp == pytest.approx(0.22) and got.speed_interp == 52.0


def test_refill_matches_null_directions(spark):
    schema = "timestamp timestamp_ntz, station_id int, direction string, flow double, occupancy double, speed double"
    raw = frame(spark, [(at(0), 1, None, 9.0, 9.0, 9.0), (at(1), 1, None, 9.0, 9.0, 9.0)], schema)
    mask = frame(spark, [(at(0), 1, None, True)], "timestamp timestamp_ntz, station_id int, direction string, mask_logic boolean")
    interp = frame(spark, [(at(0), 1, None, None, None, None), (at(1), 1, None, 4.0, 5.0, 6.0)], schema)
    assert column(fill.refill(raw, mask, interp), "flow_interp", "timestamp") == [4.0, 4.0]


@pytest.mark.parametrize("suffix", ["", "_interp"])
def test_check_report(spark, suffix):
    raw, mask, interp = refill_tables(spark, [(at(0), 100, 10.0, 0.1, 50.0), (at(0), 200, 20.0, 0.2, 55.0)], [(at(0), 100, True)], [(at(0), 100, 11.0, 0.11, 51.0), (at(0), 200, 20.0, 0.2, 55.0)])
    for f in FEATURES:
        interp = interp.withColumnRenamed(f, f + suffix)
    got = fill.fill_check(raw, mask, interp).first()
    assert (got.masked, got.unmasked, got.missing_masked, got.max_diff_flow, got.raw_duplicates) == (1, 1, 0, 0.0, 0)


def test_missing_columns_are_named(spark):
    raw, mask, interp = refill_tables(spark, [], [], [])
    with pytest.raises(ValueError, match="speed"):
        fill.refill(raw, mask, interp.drop("speed"))


def chain(spark, rows, parts=1, **kw):
    pairs = frame(spark, [(1, 2), (2, 1), (3, 1)], "station_id int, neighbour int")
    out = fill.fill_chain(frame(spark, rows, RAW).repartition(parts), pairs, masks=["mask_logic"], **kw)
    return sorted((r.station_id, r.timestamp, r.flow) for r in out.collect())


CHAIN = [
    *((at(k), 1, "N", [10.0, 999.0, 30.0][k], 0.1, 50.0, k == 1) for k in range(3)),
    *((at(k), 2, "N", 999.0, 9.9, 999.0, True) for k in range(4)),
    *((at(k + 10), 3, "N", 999.0, 9.9, 999.0, True) for k in range(2)),
]


def test_chain_order(spark):
    got = chain(spark, CHAIN)
    # station 1 by its bracket; station 2 by its neighbour, then carried; station 3 by the overall mean
    assert [v for s, _, v in got if s == 1] == [10.0, 20.0, 30.0]
    assert [v for s, _, v in got if s == 2] == [10.0, 10.0, 30.0, 30.0]
    mean = (10 + 20 + 30 + 10 + 10 + 30 + 30) / 7
    assert [v for s, _, v in got if s == 3] == pytest.approx([mean, mean])
    assert chain(spark, CHAIN, parts=5) == got


def test_chain_keeps_unmasked_values(spark):
    rows = [(*r[:6], False) for r in CHAIN]
    assert chain(spark, rows) == sorted((r[1], r[0], r[3]) for r in rows)
    with pytest.raises(ValueError, match="precedence"):
        chain(spark, rows, precedence="none")


def test_carry(spark):
    df = frame(spark, [(0, "a", None), (1, "a", 2.0), (2, "a", None), (3, "b", None)], "id int, g string, v double")
    assert column(fill.carry_fill(df, ["v"], ["g"], ["id"]), "v") == [2.0, 2.0, 2.0, None]
    assert column(fill.carry_fill(df, ["v"], ["g"], ["id"], backward=False), "v") == [None, 2.0, 2.0, None]
    assert fill.carry_fill(df.limit(0), ["v"], ["g"], ["id"]).where(F.col("v").isNotNull()).collect() == []
