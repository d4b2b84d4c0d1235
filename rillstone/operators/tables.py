"""General table operators: duplicates, sets, profiles, samples, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.storage import durable


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order, by an aggregate that combines before the shuffle."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_distinct, n_duplicates."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_distinct"))
    return out.withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, percent) by one aggregation."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"c{k}") for k, c in enumerate(columns)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("missing")) for k, c in enumerate(columns))))
    return counts.select("n", each.alias("e")).select("e.column", "e.missing", F.try_divide(100.0 * F.col("e.missing"), F.col("n").cast("double")).alias("percent"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), null a value too."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def running_counts(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """(by, value, c, upto, n): each distinct value's rows, the rows up to and with it in its group, and the group's; nulls don't count.

    Values are counted before the shuffle and sorted over range partitions; each partition's
    sums are offset by those of the partitions before it, so no task holds a whole group.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    tagged = durable(counts.sort(*by, "value").withColumn("_part", F.spark_partition_id()))
    sizes = tagged.groupBy(*by, "_part").agg(F.sum("c").alias("_s"))
    group = Window.partitionBy(*by, *([] if by else [F.lit(0)]))  # a group has no more rows here than there are partitions
    starts = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col("_part").alias("_p"), (F.sum("_s").over(group.orderBy("_part")) - F.col("_s")).alias("_start"), F.sum("_s").over(group).alias("n"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = Window.partitionBy(*by, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("_up", F.sum("c").over(here)).join(starts, on).select(*by, "value", "c", (F.col("_start") + F.col("_up")).alias("upto"), "n")


def quantiles(df: DataFrame, column: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(by, one column for each named share): exact quantiles by linear interpolation, from running counts."""
    counts = running_counts(df, column, by)
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in shares.items()}
    has = lambda rank: F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("value").cast("double")))
    picked = [f for name, h in at.items() for f in (has(F.floor(h)).alias(f"_lo_{name}"), has(F.ceil(h)).alias(f"_hi_{name}"))]
    rows = (counts.groupBy(*by) if by else counts.groupBy()).agg(F.max("n").alias("n"), *picked)

    def value(name, h):
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when((F.floor(h) == F.ceil(h)) | (low == high), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return rows.select(*by, *(value(name, h).alias(name) for name, h in at.items()))


def segment_offsets(df: DataFrame, key: str) -> DataFrame:
    """(key, start, size): where each key's rows begin among all rows sorted by the key, and how many there are."""
    return running_counts(df, key).select(F.col("value").alias(key), (F.col("upto") - F.col("c")).alias("start"), F.col("c").alias("size"))


def describe(df: DataFrame, column: str, by: list[str] = (), shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std (sample), min, exact quantiles by linear interpolation, max."""
    names = {f"q{round(q * 100)}": q for q in shares}
    aggs = [F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")]
    ranked = quantiles(df, column, names, by).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), *names)
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = (df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)).join(ranked, on, "left")
    return joined.select(*by, "count", "mean", "std", "min", *names, "max")


def ecdf(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, value, cdf) for each distinct value: rows before its last copy, as a share of all but one."""
    counts = running_counts(df, column, by)
    return counts.select(*by, "value", F.coalesce(F.try_divide((F.col("upto") - 1).cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0)).alias("cdf"))


def histogram(df: DataFrame, column: str, bins: int, by: list[str] = ()) -> DataFrame:
    """(by, bin, count) over equal bins from the least to the largest value, which is in the last bin; only bins with rows."""
    edges = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")) if by else df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = df.where(F.col(column).isNotNull()).join(edges, list(by)) if by else df.where(F.col(column).isNotNull()).join(F.broadcast(edges))
    place = F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    return joined.groupBy(*by, F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def outer_merge(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """A full outer join on a key; other columns that both have get suffixes."""
    both = {c for c in left.columns if c in right.columns and c != key}
    name = lambda t, s: t.select(key, *(F.col(c).alias(c + s if c in both else c) for c in t.columns if c != key))
    return name(left, suffixes[0]).join(name(right, suffixes[1]), key, "full_outer")


def left_merge_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join to a table that has each key once; ValueError if it doesn't. Null keys match null keys."""
    if not right.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {keys} aren't unique on the right")
    named = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(named, condition, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def hash_sample(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows whose key hash is in the first ``share`` of its range: the same rows at every run."""
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(share * 1_000_000))


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, and that both have."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    parts = [left.join(right, key, "left_anti").withColumn("side", F.lit("left")), right.join(left, key, "left_anti").withColumn("side", F.lit("right")), left.join(right, key, "left_semi").withColumn("side", F.lit("both"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def non_finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """nan_<c> and inf_<c> counts."""
    return df.agg(*(f for c in columns for f in (F.count_if(F.isnan(c)).alias(f"nan_{c}"), F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"inf_{c}"))))


def top_k(df: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assert_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """ValueError names some keys if both tables have any in common."""
    common = a.select(*keys).intersect(b.select(*keys)).limit(5).collect()
    if common:
        raise ValueError(f"not disjoint: {[tuple(r) for r in common]}")


def flat_sample(spark: SparkSession, times: int, nodes: int, n: int, seed: int = 0) -> DataFrame:
    """(time_idx, node_idx) of n different cells of a times x nodes table, the least by a fixed pseudo-random order."""
    value = F.pmod(F.pmod(F.lit(seed) * 48271 + F.col("id") * 16807 + 12345, F.lit(2147483647)) * 48271 + 12345, F.lit(2147483647))
    return spark.range(times * nodes).orderBy(value, "id").limit(n).select(F.floor(F.col("id") / nodes).cast("long").alias("time_idx"), (F.col("id") % nodes).alias("node_idx"))
