"""Graphs of stations: topology, lengths, reachability, neighbourhoods. Edges are (src, dst) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.geo import RADIUS_MILES, haversine
from rillstone.functions.numeric import positive_finite
from rillstone.functions.timeslots import SLOT_MINUTES
from rillstone.operators.components import connected_components
from rillstone.operators.proximity import knn_join
from rillstone.storage import durable

__all__ = ["connected_components"]


def positions(df: DataFrame, key: str, name: str = "node_idx") -> DataFrame:
    """(key, position from 0 in sorted order) of the distinct keys.

    Counts by range partition are offset by a running sum over the partitions, so the numbering
    isn't made in one task.
    """
    tagged = durable(df.select(key).where(F.col(key).isNotNull()).distinct().sort(key).withColumn("_part", F.spark_partition_id()))
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return tagged.join(F.broadcast(starts), "_part").select(key, (F.col("_start") + rank).cast("long").alias(name))


def topology(station_ids: DataFrame, meta: DataFrame, k: int = 5, key: str = "station_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """edges (src, dst by position), nodes, ids dropped for lack of coordinates, ids missing from the metadata.

    ValueError if no station has coordinates. Of repeated metadata rows the first by latitude
    and longitude counts.
    """
    wanted = station_ids.select(key).where(F.col(key).isNotNull()).distinct()
    first = meta.join(wanted, key, "left_semi").groupBy(key).agg(F.min(F.struct(F.col("lat").isNull().alias("n"), "lat", "lon")).alias("m")).select(key, "m.lat", "m.lon")
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan(F.col("lat").cast("double")) & ~F.isnan(F.col("lon").cast("double"))
    valid, dropped = durable(first.where(has)), first.where(~F.coalesce(has, F.lit(False))).select(key)
    missing = wanted.join(meta, key, "left_anti")
    if valid.isEmpty():
        raise ValueError("no station has coordinates")
    nodes = positions(valid, key)
    near = knn_join(valid, k, key, "lon", "lat")
    at = lambda name: nodes.select(F.col(key).alias(f"_{name}"), F.col("node_idx").alias(name))
    edges = near.join(at("src"), F.col(key) == F.col("_src")).join(at("dst"), F.col("neighbour") == F.col("_dst")).select("src", "dst")
    return edges, nodes, dropped, missing


def chain_edges(stations: DataFrame, line: list[str], order: str, key: str = "station_id") -> DataFrame:
    """(src, dst): each station and the next one on its line; rows with a null line key or place are left out."""
    known = stations
    for c in [*line, order]:
        known = known.where(F.col(c).isNotNull())
    w = Window.partitionBy(*line).orderBy(order, key)
    return known.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).where("dst IS NOT NULL")


def repair_components(edges: DataFrame, points: DataFrame, loose: DataFrame, k: int = 1, key: str = "station_id") -> DataFrame:
    """The edges and, both ways, those between the loose stations and their k nearest others by great circle."""
    near = knn_join(points.join(loose, key, "left_semi"), k, key, "lon", "lat", "haversine", others=points).select(F.col(key).alias("src"), F.col("neighbour").alias("dst"))
    return edges.select("src", "dst").unionByName(near).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def edge_lengths(edges: DataFrame, nodes: DataFrame, default: float = 1.0, key: str = "node_idx") -> DataFrame:
    """(src, dst, length): the source's own length if positive and finite, else the distance in miles if positive, else the default."""
    ends = lambda p: nodes.select(F.col(key).alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"), *([F.col("length").alias("_own")] if p == "src" else []))
    joined = edges.select("src", "dst").distinct().join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    miles = haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"), RADIUS_MILES)
    length = F.coalesce(positive_finite(F.col("_own").cast("double")), positive_finite(miles), F.lit(default))
    return joined.select("src", "dst", length.alias("length"))


def horizon_limits(deltas: dict[str, int] | None = None, mph: float = 1.0) -> dict[str, float]:
    """Miles that are reached in each horizon's number of slots."""
    deltas = deltas or {"5min": 1, "15min": 3, "30min": 6}
    return {h: n * SLOT_MINUTES / 60 * mph for h, n in deltas.items()}


def reach_within(edges: DataFrame, nodes: DataFrame, limit: float, reverse: bool = True, key: str = "node_idx") -> DataFrame:
    """(src, dst, dist): all nodes within the limit by shortest path, each node with itself at 0.

    Edges are walked from dst to src unless ``reverse`` is false. Each round walks one edge from
    the pairs that got shorter in the last and keeps the least distance by pair, in one
    aggregation that is written to the shared folder; lengths are positive, so it ends.
    ValueError if an edge leaves the nodes.
    """
    edges = durable(edges.select("src", "dst", "length"))
    step = edges.select((F.col("dst") if reverse else F.col("src")).alias("x"), (F.col("src") if reverse else F.col("dst")).alias("y"), "length").groupBy("x", "y").agg(F.min("length").alias("length"))
    ids = nodes.select(F.col(key).alias("n"))
    outside = edges.select(F.explode(F.array("src", "dst")).alias("n")).join(ids, "n", "left_anti")
    if not outside.isEmpty():
        raise ValueError("an edge leaves the nodes")
    step = durable(step.where(F.col("length") <= limit))
    best = durable(ids.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(0.0).alias("dist"), F.lit(True).alias("new")))
    while True:
        front = best.where("new")
        if front.isEmpty():
            return best.select("src", "dst", "dist")
        walked = front.join(step, front["dst"] == step["x"]).select("src", F.col("y").alias("dst"), (F.col("dist") + F.col("length")).alias("dist"), F.lit(None).cast("double").alias("old")).where(F.col("dist") <= limit)
        both = walked.unionByName(best.select("src", "dst", "dist", F.col("dist").alias("old"))).groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("old").alias("old"))
        best = durable(both.select("src", "dst", "dist", (F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("new")))


def neighbourhoods(edges: DataFrame, nodes: DataFrame, limits: dict[str, float] | None = None, reverse: bool = True, key: str = "node_idx") -> DataFrame:
    """(horizon, src, dst) for each horizon's limit, from one search to the widest."""
    limits = limits or horizon_limits()
    reach = durable(reach_within(edges, nodes, max(limits.values()), reverse, key))
    table = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(float(v)).alias("limit")) for h, v in limits.items())))
    return reach.select("*", table.alias("h")).where("dist <= h.limit").select("h.horizon", "src", "dst")


def average_size(reach: DataFrame, n_nodes: int) -> DataFrame:
    return reach.groupBy("horizon").agg((F.count(F.lit(1)) / F.lit(n_nodes)).alias("average"))


def degrees(edges: DataFrame, nodes: DataFrame, key: str = "node_idx") -> DataFrame:
    """(node, degree): edges at either end; isolated nodes have 0."""
    counts = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(F.col(key).alias("node")).join(counts, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def neighbour_aggregate(edges: DataFrame, values: DataFrame, features: list[str], how: str = "mean", key: str = "node_idx", extra: list[str] = ()) -> DataFrame:
    """For each node (and each value of the extra keys) the mean or sum of its out-neighbours' features; 0 without any."""
    joined = edges.select("src", "dst").join(values.select(F.col(key).alias("dst"), *extra, *features), "dst")
    agg = {"mean": F.avg, "sum": F.sum}[how]
    means = joined.groupBy("src", *extra).agg(*(agg(f).alias(f) for f in features)).withColumnRenamed("src", key)
    base = values.select(key, *extra).distinct()
    return base.join(means, [key, *extra], "left").select(key, *extra, *(F.coalesce(f, F.lit(0.0)).alias(f) for f in features))


def scatter_add(rows: DataFrame, nodes: DataFrame, features: list[str], index: str = "row", key: str = "node_idx") -> DataFrame:
    """Sums of the features by index, for every node; 0 where there are none."""
    sums = rows.groupBy(F.col(index).alias(key)).agg(*(F.sum(f).alias(f) for f in features))
    return nodes.select(key).join(sums, key, "left").select(key, *(F.coalesce(f, F.lit(0)).alias(f) for f in features))


def hash_order(*columns: Column | str, seed: int = 0) -> Column:
    """A fixed pseudo-random order that any engine can repeat: products and sums modulo a prime."""
    value = F.lit(seed)
    for c in columns:
        value = F.pmod(value * 48271 + (F.col(c) if isinstance(c, str) else c) * 16807 + 12345, F.lit(2147483647))
    return value


def sample_neighbours(edges: DataFrame, fanout: int, seed: int = 0) -> DataFrame:
    """At most ``fanout`` edges of each source, the same at every run."""
    w = Window.partitionBy("src").orderBy(hash_order("src", "dst", seed=seed), "dst")
    return edges.select("src", "dst").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= fanout).drop("_r")


def sample_hops(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """(root, hop, src, dst): neighbours sampled hop by hop from the seeds' nodes."""
    out, front = None, seeds.select(F.col(seeds.columns[0]).alias("root"), F.col(seeds.columns[0]).alias("node")).distinct()
    for hop, fanout in enumerate(fanouts, 1):
        kept = sample_neighbours(edges, fanout, seed + hop)
        step = front.join(kept, front["node"] == kept["src"]).select("root", F.lit(hop).alias("hop"), "src", "dst").distinct()
        out = step if out is None else out.unionByName(step)
        front = step.select("root", F.col("dst").alias("node")).distinct()
    return out


def induced_subgraph(edges: DataFrame, members: DataFrame, key: str = "node_idx", by: list[str] = ()) -> DataFrame:
    """The edges whose ends are both members (of the same ``by`` group), with local numbers from 0 in order of the key."""
    if by:
        w = Window.partitionBy(*by).orderBy(key)
        local = members.select(*by, key).distinct().withColumn("_l", (F.row_number().over(w) - 1).cast("long"))
    else:
        local = positions(members, key, "_l")
    a = local.select(*by, F.col(key).alias("src"), F.col("_l").alias("local_src"))
    b = local.select(*by, F.col(key).alias("dst"), F.col("_l").alias("local_dst"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, [*by, "dst"]).select(*by, "src", "dst", "local_src", "local_dst")


def self_loops(nodes: DataFrame, key: str = "node_idx") -> DataFrame:
    return nodes.select(F.col(key).alias("src"), F.col(key).alias("dst"))


def remap(lists: DataFrame, old: DataFrame, new: DataFrame, key: str = "station_id") -> DataFrame:
    """Edges by old positions as edges by new ones; nodes that the new numbering lacks are left out."""
    both = old.select(key, F.col("node_idx").alias("_o")).join(new.select(key, F.col("node_idx").alias("_n")), key).select("_o", "_n")
    a, b = both.select(F.col("_o").alias("src"), F.col("_n").alias("_a")), both.select(F.col("_o").alias("dst"), F.col("_n").alias("_b"))
    rest = [c for c in lists.columns if c not in ("src", "dst")]
    return lists.join(a, "src").join(b, "dst").select(*rest, F.col("_a").alias("src"), F.col("_b").alias("dst"))


def first_neighbours(edges: DataFrame, node, k: int) -> DataFrame:
    """(rank, neighbour): the k direct neighbours of one node with the least positions; ranks from 1."""
    near = edges.where(F.col("src") == F.lit(node)).select(F.col("dst").alias("neighbour")).distinct().orderBy("neighbour").limit(k)
    w = Window.partitionBy(F.lit(0)).orderBy("neighbour")  # at most k rows
    return near.select(F.row_number().over(w).cast("long").alias("rank"), "neighbour")


def first_edges(edges: DataFrame, n: int) -> DataFrame:
    """The first n edges by source and target, as many as a plot can show."""
    return edges.select("src", "dst").distinct().orderBy("src", "dst").limit(n)
