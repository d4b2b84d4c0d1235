"""Joins by place: nearest neighbours, nearest cells, and time ranges within a radius."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.geo import RADIUS_KM, haversine
from rillstone.operators.tables import top_k
from rillstone.storage import durable, shared_dir


#: Cells of nearest-neighbour searches start so small that none holds more than this many times k + 1 points.
DENSE = 64


def _place(x: str, y: str, metric: str) -> list[Column]:
    """Coordinates in which cells are cut: the plane's, or those of the unit sphere, which has no edge at 180 degrees and no poles."""
    if metric == "euclid":
        return [F.col(x).cast("double"), F.col(y).cast("double")]
    lon, lat = F.radians(F.col(x).cast("double")), F.radians(F.col(y).cast("double"))
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _around(cells: list[str]) -> Column:
    """The cell and all that touch it, as an array of structs."""
    steps = itertools.product((-1, 0, 1), repeat=len(cells))
    return F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(cells, step, strict=True))) for step in steps))


def knn_join(points: DataFrame, k: int, key: str = "station_id", x: str = "lon", y: str = "lat", metric: str = "euclid", others: DataFrame | None = None, exclude_self: bool = True, dense: int = DENSE) -> DataFrame:
    """(key, neighbour, dist, rank): the k nearest others of every point; ties go to the smaller key.

    ``metric`` is "euclid" (the coordinates' own unit) or "haversine" (degrees in, km out). A point
    excludes itself by key, so points at the same place are neighbours. Points without
    coordinates take no part; neither do null keys. Repeated keys are points of their own.

    Blocking: points meet those of the cells around theirs, in the plane or on the unit sphere. A
    point is done when its k-th distance is no more than a cell; the rest go on with cells twice
    as wide, until one block covers all. The first cells are so small that the densest holds a
    bounded number of points, and of points at one place only the k + 1 with the least keys are
    looked at, as no other can be among the k nearest. Each round's result is durable.
    """
    nothing = points.select(F.col(key), F.col(key).alias("neighbour"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    if k <= 0:
        return nothing
    axes = [f"p{i}" for i in range(2 if metric == "euclid" else 3)]
    columns = [c.alias(a) for c, a in zip(_place(x, y, metric), axes, strict=True)]
    clean = lambda t: t.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *columns).where("x IS NOT NULL AND y IS NOT NULL AND id IS NOT NULL")
    asked, pool = durable(clean(points)), clean(others if others is not None else points)
    same_place = Window.partitionBy("x", "y").orderBy("id")
    pool = durable(pool.withColumn("_r", F.row_number().over(same_place)).where(F.col("_r") <= k + 1).drop("_r"))
    bounds = pool.unionByName(asked).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max))).first()
    if not bounds["n"]:
        return nothing
    low = {a: bounds[f"min_{a}"] for a in axes}
    extent = max(*(bounds[f"max_{a}"] - low[a] for a in axes), 1e-9)
    cell = extent / max(1.0, math.sqrt(bounds["n"] / (2.0 * (k + 1))))
    at = lambda size: [F.floor((F.col(a) - low[a]) / size).cast("long").alias(f"c{a}") for a in axes]
    cells = [f"c{a}" for a in axes]
    for _ in range(20):
        if pool.groupBy(*at(cell)).count().agg(F.max("count")).first()[0] <= dense * (k + 1):
            break
        cell /= 2
    order = Window.partitionBy("id").orderBy("dist", "neighbour")
    found = None
    while True:
        final = cell >= extent
        left = asked.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), *at(cell)).withColumn("c", F.explode(_around(cells))).select("id", "ax", "ay", "c.*")
        right = pool.select(F.col("id").alias("neighbour"), "x", "y", *at(cell))
        pairs = left.join(right, cells)
        if exclude_self:
            pairs = pairs.where(F.col("id") != F.col("neighbour"))
        if metric == "euclid":
            dist, reach = F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2)), cell
        else:  # a chord as long as a cell, as an arc
            dist, reach = haversine(F.col("ay"), F.col("ax"), F.col("y"), F.col("x")), 2 * math.asin(min(1.0, cell / 2)) * RADIUS_KM * (1 - 1e-9)
        near = durable(pairs.select("id", "neighbour", dist.alias("dist")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if final:
            return (near if found is None else found.unionByName(near)).select(F.col("id").alias(key), "neighbour", "dist", "rank")
        done = near.where((F.col("rank") == k) & (F.col("dist") <= reach)).select("id")
        new = near.join(done, "id", "left_semi")
        found = new if found is None else found.unionByName(new)
        asked = durable(asked.join(done, "id", "left_anti"))
        if asked.isEmpty():
            return found.select(F.col("id").alias(key), "neighbour", "dist", "rank")
        cell *= 2


def make_grid(points: DataFrame, km: float = 10.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(grid_id, lat, lon) centres of the cells of ``km`` (at 111 km a degree) that cover the points' extent, south to north, then west to east."""
    d = km / 111.0
    box = points.agg(F.min(lat).alias("a0"), F.max(lat).alias("a1"), F.min(lon).alias("o0"), F.max(lon).alias("o1")).where("a0 IS NOT NULL AND o0 IS NOT NULL")
    count = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / d + 1 - 1e-9).cast("int")
    sized = box.select("a0", "o0", count("a0", "a1").alias("rows"), count("o0", "o1").alias("cols"))
    cells = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    return cells.select(F.concat(F.lit("grid_"), (F.col("i") * F.col("cols") + F.col("j")).cast("string")).alias("grid_id"), (F.col("a0") + F.col("i") * d + d / 2).alias("lat"), (F.col("o0") + F.col("j") * d + d / 2).alias("lon"))


def nearest_cell(points: DataFrame, grid: DataFrame, key: str = "station_id") -> DataFrame:
    """(key, grid_id): the cell whose centre is nearest in degrees; ties go to the smaller cell name."""
    cells = grid.select(F.col("grid_id").alias(key), "lat", "lon")
    asked = points.select(F.col(key).cast("string").alias(key), F.col(key).alias("_key"), "lat", "lon")
    near = knn_join(asked.select(key, "lat", "lon"), 1, key, "lon", "lat", others=cells, exclude_self=False)
    return asked.select(key, "_key").distinct().join(near, key).select(F.col("_key").alias(key), F.col("neighbour").alias("grid_id"))


def radius_range_join(readings: DataFrame, stations: DataFrame, events: DataFrame, radius_km: float = 1.0, time: str = "timestamp", key: str = "station_id") -> DataFrame:
    """Adds in_event: whether the reading's time is in the closed interval of an event within the radius of its station.

    Stations and events meet first, in cells of the unit sphere a radius wide, so that only
    matching stations' readings are compared with times; readings are split by day to keep the
    range join an equi-join.
    """
    edge = 2 * math.sin(min(math.pi, radius_km / RADIUS_KM) / 2) * 1.01
    cells = ["_c0", "_c1", "_c2"]
    at = [F.floor(c / edge).cast("long").alias(n) for c, n in zip(_place("lon", "lat", "haversine"), cells, strict=True)]
    ours = stations.select(F.col(key).alias("_k"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *at)
    theirs = events.select("start_time", "end_time", F.col("lat").alias("_elat"), F.col("lon").alias("_elon"), *at).withColumn("_c", F.explode(_around(cells))).drop(*cells).select("*", "_c.*").drop("_c")
    close = ours.join(theirs, cells).where(haversine(F.col("_lat"), F.col("_lon"), F.col("_elat"), F.col("_elon")) <= radius_km)
    days = close.select("_k", "start_time", "end_time", F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time"))).alias("_day")).distinct()
    asked = readings.select(F.col(key).alias("_k"), F.col(time).alias("_t")).distinct()
    hit = asked.join(days, (asked["_k"] == days["_k"]) & (F.to_date(asked["_t"]) == days["_day"])).where((F.col("_t") >= F.col("start_time")) & (F.col("_t") <= F.col("end_time"))).select(asked["_k"], "_t").distinct().withColumn("_in", F.lit(True))
    return readings.join(hit, (F.col(key) == F.col("_k")) & (F.col(time) == F.col("_t")), "left").withColumn("in_event", F.coalesce("_in", F.lit(False))).drop("_k", "_t", "_in")


def _best(ids, other, dist, k: int):
    """Of each query (row) its k least distances, each neighbour once: query, neighbour and distance."""
    import numpy as np

    if len(np.unique(other)) < len(other):
        order = np.argsort(other, kind="stable")
        other, starts = np.unique(other[order], return_index=True)
        dist = np.minimum.reduceat(dist[:, order], starts, axis=1)
    out = []
    for i, d in enumerate(dist):
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if k < len(d) else np.arange(len(d))
        near = near[np.lexsort((other[near], d[near]))][:k]
        near = near[np.isfinite(d[near])]
        out.append((np.full(len(near), ids[i]), other[near], d[near]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def vector_knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 1024, chunk: int = 4096) -> DataFrame:
    """(key, neighbour, dist, rank) of each query against all rows by Euclidean distance, itself excluded; exact.

    The stated query set is written to the shared folder; each task reads it block by block,
    multiplies a block with a chunk of its own rows and keeps the best k, and the best k of those
    stay. So neither the driver nor the plan holds any query, and no pair that isn't among a
    chunk's best leaves a task. Only vectors of the same length are compared; rows with a null
    key or vector, or with a null or NaN in it, take no part. Repeated keys count as one point whose
    distance is the least of its rows'; ties go to the smaller key.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.dataset as pads
    import pyarrow.fs as pafs

    whole = lambda t: t.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    folder = shared_dir(vectors.sparkSession)
    whole(queries).withColumn("n", F.size("v")).sortWithinPartitions("n").write.parquet(folder)

    def by_length(batch):
        sizes = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes):
            part = batch.filter(pa.array(sizes == n))
            yield int(n), part.column("id").to_numpy(zero_copy_only=False), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, int(n))

    def compare(n, other, v):
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in pads.dataset(root, filesystem=files, format="parquet", exclude_invalid_files=False, ignore_prefixes=["_", "."]).to_batches(filter=pads.field("n") == n, batch_size=block):
            for size, ids, q in by_length(batch) if batch.num_rows else ():
                # products tell which are near; the distances of those are taken from the differences
                rough = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)
                rough[ids[:, None] == other[None, :]] = np.inf
                slack = 1e-9 * ((q * q).sum(1).max() + (v * v).sum(1).max() + 1)
                bound = np.partition(rough, min(k, len(other)) - 1, 1)[:, min(k, len(other)) - 1] if len(np.unique(other)) == len(other) else np.full(len(q), np.inf)
                near = (rough <= (bound + slack)[:, None]) & np.isfinite(rough)
                dist = np.full(rough.shape, np.inf)
                a, b = np.nonzero(near)
                for at in range(0, len(a), 1 << 16):
                    i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                    dist[i, j] = np.sqrt(((q[i] - v[j]) ** 2).sum(1))
                found = _best(ids, other, dist, k)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["id", "neighbour", "dist"])

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                for n, other, v in by_length(batch.slice(at, chunk)):
                    yield from compare(n, other, v)

    near = whole(vectors).mapInArrow(run, "id long, neighbour long, dist double").groupBy("id", "neighbour").agg(F.min("dist").alias("dist"))
    return top_k(near, ["id"], ["dist", "neighbour"], k).select(F.col("id").alias(key), "neighbour", "dist", "rank")
