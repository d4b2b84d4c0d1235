"""Detector health, rule scores, outlier distances, thresholds and mask reports."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions.numeric import truth
from rillstone.operators.tables import quantiles, running_counts
from rillstone.storage import durable

GOOD, BAD = 0.9, -1.0
#: The reference point of the health column where a station has no health.
MISSING_HEALTH = 0.0039
#: Most rows of a sweep's grid, and most groups of a distance whose matrices the driver inverts.
MOST_PARAMETERS = 4096
MOST_GROUPS = 64


def snapshot_labels(stations: DataFrame, snapshots: DataFrame, good: DataFrame, key: str = "station_id", date: str = "slice_date") -> DataFrame:
    """(key, date, li): each station on each snapshot's date, good if listed there, else bad. Dates are few and broadcast."""
    listed = good.select(key, date).distinct().withColumn("_good", F.lit(True))
    every = stations.select(key).distinct().join(F.broadcast(snapshots.select(date).distinct()))
    return every.join(listed, [key, date], "left").select(key, date, F.when(F.col("_good"), F.lit(GOOD)).otherwise(F.lit(BAD)).alias("li"))


def _decayed(labels: DataFrame, half_life: Column, keys: list[str], date: str) -> DataFrame:
    """(keys, date, the sums of labels and of their weights as struct columns of num and den): ``own`` at
    the date, ``before`` and ``after`` it strictly, ``upto`` and ``from`` it.

    One fold over the sorted dates of a key in each direction carries the sums, which fade by the
    days between, so a key costs its dates and not their square.
    """
    fade = lambda days: F.exp(-F.lit(float(np.log(2))) / half_life * days.cast("double"))
    sums = labels.where(F.col(date).isNotNull()).groupBy(*keys, date).agg(F.struct(F.coalesce(F.sum("li"), F.lit(0.0)).alias("num"), F.count(F.lit(1)).cast("double").alias("den")).alias("own"))
    lists = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), "own"))).alias("s"))
    pair = lambda num, den: F.struct(num.alias("num"), den.alias("den"))
    none = "array<struct<past:struct<num:double,den:double>,all:struct<num:double,den:double>>>"

    def step(acc, x):
        w = F.when(acc["d"].isNull(), F.lit(0.0)).otherwise(fade(F.abs(F.datediff(x["d"], acc["d"]))))
        past = pair(acc["num"] * w, acc["den"] * w)
        both = pair(past["num"] + x["own"]["num"], past["den"] + x["own"]["den"])
        return F.struct(x["d"].alias("d"), both["num"].alias("num"), both["den"].alias("den"), F.concat(acc["out"], F.array(F.struct(past.alias("past"), both.alias("all")))).alias("out"))

    start = F.struct(F.lit(None).cast("date").alias("d"), F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.array().cast(none).alias("out"))
    fold = lambda c: F.aggregate(c, start, step, lambda acc: acc["out"])
    each = lists.select(*keys, F.explode(F.arrays_zip("s", fold(F.col("s")).alias("f"), F.reverse(fold(F.reverse("s"))).alias("b"))).alias("e"))
    return each.select(*keys, F.col("e.s.d").alias(date), F.col("e.s.own").alias("own"), F.col("e.f.past").alias("before"), F.col("e.f.all").alias("upto"), F.col("e.b.past").alias("after"), F.col("e.b.all").alias("from"))


def health_decay(labels: DataFrame, calendar: DataFrame, half_life: float, key: str = "station_id", date: str = "slice_date") -> DataFrame:
    """(key, date, score, health_conf): labels averaged with weights that halve every ``half_life`` days, before and after.

    Sums run forward and back over a key's labels; a day takes those of the nearest label on each
    side. Weights too small for a double sum to 0; the score is then null. Labels without a key
    or date take no part.
    """
    labels = labels.where(F.col(key).isNotNull() & F.col(date).isNotNull()).withColumn(date, F.col(date).cast("date"))
    days = F.broadcast(calendar.select(F.col(calendar.columns[0]).cast("date").alias("date")).distinct())  # one row a day
    sums = _decayed(labels, F.lit(float(half_life)), [key], date).select(key, F.col(date).alias("date"), F.struct(F.col(date).alias("d"), "upto", "from").alias("at"))
    asked = labels.select(key).distinct().join(days).withColumn("_asked", F.lit(True))
    rows = asked.join(sums, [key, "date"], "full_outer")
    back = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumns({"_b": F.last("at", True).over(back), "_a": F.last("at", True).over(ahead)}).where("_asked")
    weight = lambda side: F.coalesce(F.exp(-F.lit(float(np.log(2))) / half_life * F.abs(F.datediff("date", F.col(f"{side}.d"))).cast("double")), F.lit(0.0))
    total = lambda part: weight("_b") * F.coalesce(F.col(f"_b.upto.{part}"), F.lit(0.0)) + weight("_a") * F.coalesce(F.col(f"_a.from.{part}"), F.lit(0.0))
    scored = near.select(key, "date", F.try_divide(total("num"), total("den")).alias("score"))
    return scored.withColumn("health_conf", (F.col("score") - BAD) / (GOOD - BAD))


def half_life_sweep(labels: DataFrame, half_lives: list[float], key: str = "station_id", date: str = "slice_date", exclude_snapshots: bool = False) -> DataFrame:
    """(half_life, mid, ext, loss): how well the score at each date between a station's first and last snapshots tells the label there.

    mid is the mean squared error at the inner snapshot dates, ext at the outer two; the loss is
    0.8 mid + 0.2 ext. With ``exclude_snapshots`` a date's own labels have no part in its score.
    The half-lives are a small table; labels are never paired with one another. Labels without a
    key or date take no part.
    """
    labels = labels.where(F.col(key).isNotNull() & F.col(date).isNotNull()).withColumn(date, F.col(date).cast("date"))
    each = labels.select(key, date, "li", F.explode(F.array(*map(F.lit, map(float, half_lives)))).alias("half_life"))
    sums = _decayed(each, F.col("half_life"), [key, "half_life"], date)
    total = lambda part: F.col(f"before.{part}") + F.col(f"after.{part}") + (F.lit(0.0) if exclude_snapshots else F.col(f"own.{part}"))
    scores = sums.select(key, "half_life", date, F.try_divide(total("num"), total("den")).alias("score"))
    truths = labels.select(key, date, F.col("li").alias("truth")).distinct()
    ends = labels.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    error = F.pow(F.col("score") - F.col("truth"), 2)
    outer = (F.col(date) == F.col("lo")) | (F.col(date) == F.col("hi"))
    out = scores.join(truths, [key, date]).join(F.broadcast(ends)).groupBy("half_life").agg(F.avg(F.when(~outer, error)).alias("mid"), F.avg(F.when(outer, error)).alias("ext"))
    return out.withColumn("loss", 0.8 * F.coalesce("mid", F.lit(0.0)) + 0.2 * F.coalesce("ext", F.lit(0.0)))


def best_row(df: DataFrame, metric: str, tie: str, lowest: bool = True) -> DataFrame:
    """The row with the least (or largest) metric, then the least tie column."""
    order = F.struct(F.col(metric) if lowest else -F.col(metric), F.col(tie))
    return df.where(F.col(metric).isNotNull()).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*").where(F.col(metric).isNotNull())


def rule_scores(df: DataFrame, station: str = "station_id", time: str = "timestamp", flow: str = "flow", occupancy: str = "occupancy", speed: str = "speed", samples: str = "samples", tie: list[str] = ()) -> DataFrame:
    """Adds s5, s7 and s8.

    s5: speed over half its station's 99 % quantile plus half the overall one. s7: how far the
    samples are under their 10 % quantile, as a share of it, at least 0. s8: 1 where flow and
    occupancy are 0 but flow is positive one and two rows before and after. Quantiles are over
    all rows, by linear interpolation.
    """
    own = df.groupBy(station).agg(F.percentile(speed, F.lit(0.99)).alias("_q99")).withColumnRenamed(station, "_s")
    # a station's quantile is over one series; those of all rows come from range partitions
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in (speed, samples)))).alias("e")).select("e.*")
    both = quantiles(each, "_v", {"_hi": 0.99, "_lo": 0.1}, ["_c"])
    whole = both.agg(F.max(F.when(F.col("_c") == speed, F.col("_hi"))).alias("_q99_all"), F.max(F.when(F.col("_c") == samples, F.col("_lo"))).alias("_q10"))
    w = Window.partitionBy(station).orderBy(time, *tie)
    around = reduce(lambda a, b: a & b, (f(flow, k).over(w) > 0 for f in (F.lag, F.lead) for k in (1, 2)))
    s8 = truth((F.col(flow) == 0) & (F.col(occupancy) == 0) & around).cast("int")
    joined = df.withColumn("s8", s8).join(own, F.col(station).eqNullSafe(F.col("_s")), "left").join(F.broadcast(whole))
    s5 = F.try_divide(F.col(speed), 0.5 * F.col("_q99") + 0.5 * F.col("_q99_all"))
    s7 = F.greatest(F.lit(0.0), F.try_divide(F.col("_q10") - F.col(samples), F.col("_q10")))
    return joined.withColumns({"s5": s5, "s7": s7}).drop("_s", "_q99", "_q99_all", "_q10")


def score_mask(alphas: tuple[float, float, float], threshold: float) -> Column:
    """True where the weighted score is above the threshold; a null score isn't."""
    score = sum((a * F.col(c) for a, c in zip(alphas, ("s5", "s7", "s8"), strict=True)), F.lit(0.0))
    return truth(score > threshold)


def f1(true: Column, predicted: Column) -> Column:
    tp, fp, fn = F.count_if(true & predicted), F.count_if(~true & predicted), F.count_if(true & ~predicted)
    return F.try_divide(2.0 * tp, (2.0 * tp + fp + fn).cast("double"))


def f1_sweep(df: DataFrame, grid: DataFrame, truth_col: str = "true_bad", day_keys: list[str] = ("station_id", "date")) -> DataFrame:
    """(the grid's columns a5, a7, a8, threshold, with f1_time, f1_day, f1_sum) for each row of the grid.

    f1_time is over rows, f1_day over day keys, with a day positive if any of its rows is. Each
    row's predictions for all rows of the grid are the bits of a few numbers. Rows, and days
    after or-ing theirs, are counted by those bits, whose different patterns the grid bounds (as
    regions between its planes) and the rows don't; only the patterns meet the grid. The grid is
    a parameter of 1 to ``MOST_PARAMETERS`` rows, else ValueError; repeated ones count once.
    """
    params = ["a5", "a7", "a8", "threshold"]
    found = grid.select(*params).limit(MOST_PARAMETERS + 1).collect()
    if not found or len(found) > MOST_PARAMETERS:
        raise ValueError(f"the grid has no rows or over {MOST_PARAMETERS}")
    sets = sorted({tuple(map(float, r)) for r in found})
    words = [sets[at : at + 62] for at in range(0, len(sets), 62)]
    # as SQL text, since building thousands of column objects takes longer than the query
    hit = lambda p: f"coalesce({p[0]!r}D * s5 + {p[1]!r}D * s7 + {p[2]!r}D * s8 > {p[3]!r}D, false)"
    bits = [F.expr(" + ".join(f"IF({hit(p)}, {1 << k}L, 0L)" for k, p in enumerate(part))).alias(f"b{w}") for w, part in enumerate(words)]
    names = [f"b{w}" for w in range(len(words))]
    rows = df.select(*day_keys, truth(F.col(truth_col)).alias("t"), *bits)
    slim = durable(rows.groupBy(*day_keys, "t", *names).agg(F.count(F.lit(1)).alias("c")))
    by_row = slim.groupBy("t", *names).agg(F.sum("c").alias("c")).withColumn("level", F.lit("time"))
    days = slim.groupBy(*day_keys).agg(F.bool_or("t").alias("t"), *(F.bit_or(b).alias(b) for b in names))
    by_day = days.groupBy("t", *names).agg(F.count(F.lit(1)).alias("c")).withColumn("level", F.lit("day"))
    told = (f"named_struct({', '.join(f'{n!r}, {v!r}D' for n, v in zip(params, p, strict=True))}, 'p', (shiftright(b{w}, {k}) & 1L) = 1L)" for w, part in enumerate(words) for k, p in enumerate(part))
    each = F.explode(F.expr(f"array({', '.join(told)})"))
    flat = by_row.unionByName(by_day).select("level", "t", "c", each.alias("e")).select("level", "t", "c", "e.*")
    of = lambda level, t, p: F.sum(F.when((F.col("level") == level) & (F.col("t") == t) & (F.col("p") == p), F.col("c")).otherwise(0))
    score = lambda level: F.coalesce(F.try_divide(2.0 * of(level, True, True), (2.0 * of(level, True, True) + of(level, False, True) + of(level, True, False)).cast("double")), F.lit(0.0))
    out = flat.groupBy(*params).agg(score("time").alias("f1_time"), score("day").alias("f1_day"))
    return out.withColumn("f1_sum", F.col("f1_time") + F.col("f1_day"))


def parameter_grid(spark: SparkSession, alphas: list[float], thresholds: list[float]) -> DataFrame:
    rows = [tuple(map(float, (*a, t))) for a in itertools.product(alphas, repeat=3) for t in thresholds]
    return spark.createDataFrame(rows, "a5 double, a7 double, a8 double, threshold double")


def fine_grid(spark: SparkSession, a5: float, threshold: float, da: float = 0.5, dt: float = 0.3) -> DataFrame:
    """The neighbourhood of a coarse optimum, clamped to [0, 1]; a5's neighbours serve all three weights."""
    alphas = sorted({max(0.0, a5 - da), a5, min(1.0, a5 + da)})
    return parameter_grid(spark, alphas, sorted({max(0.0, threshold - dt), threshold, min(1.0, threshold + dt)}))


def covariance(df: DataFrame, features: list[str], group: list[str] = ()) -> DataFrame:
    """One row per group: n, mean_<f> and the sample covariances cov_<f>_<g> for f before or at g; rows with a null feature are left out by pair."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f"mean_{f}") for f in features), *(F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs)]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def group_code(holiday: Column, event: Column, weekend: Column) -> Column:
    return holiday.cast("int") * 4 + event.cast("int") * 2 + weekend.cast("int")


def mean_impute(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls become their column's overall mean."""
    means = df.agg(*(F.avg(f).alias(f"_{f}") for f in features))
    return df.join(F.broadcast(means)).withColumns({f: F.coalesce(f, f"_{f}") for f in features}).drop(*(f"_{f}" for f in features))


def mahalanobis(df: DataFrame, features: list[str], group: str, ridge: float = 1e-6, most_groups: int = MOST_GROUPS) -> DataFrame:
    """Adds md_squared, the squared distance from the group's mean under its covariance (plus a ridge); nulls count as the overall means.

    Groups are few calendar codes (eight); only their moments go to the driver, where the
    matrices are inverted, and the quadratic form is a column expression. ValueError for over
    ``most_groups``. A group with no more rows than features plus one has distance 0.
    """
    filled = mean_impute(df, features)
    out = F.lit(0.0)
    moments = covariance(filled, features, [group]).limit(most_groups + 1).collect()
    if len(moments) > most_groups:
        raise ValueError(f"{group} has more than {most_groups} groups")
    for row in moments:
        if row["n"] < len(features) + 1:
            continue
        sigma = np.array([[row[f"cov_{a}_{b}"] if f"cov_{a}_{b}" in row.asDict() else row[f"cov_{b}_{a}"] for b in features] for a in features]) + ridge * np.eye(len(features))
        inverse = np.linalg.inv(sigma)
        centred = [F.col(f) - F.lit(row[f"mean_{f}"]) for f in features]
        form = sum((centred[i] * centred[j] * F.lit(float(inverse[i, j])) for i in range(len(features)) for j in range(len(features))), F.lit(0.0))
        out = F.when(F.col(group).eqNullSafe(F.lit(row[group])), form).otherwise(out)
    return filled.withColumn("md_squared", out)


def knee_threshold(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, threshold): the value where the share of rows up to it exceeds the min-max scaled value most; the least on ties.

    Works on distinct values with counts, whose running sums are made over range partitions.
    """
    ranked = durable(running_counts(df, value, group))
    ends = ranked.groupBy(*group).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "lo", "hi")
    on = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)), F.lit(True))
    gap = F.try_divide((F.col("upto") - 1).cast("double"), (F.col("n") - 1).cast("double")) - F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    scored = ranked.join(ends, on).withColumn("gap", F.coalesce(gap, F.lit(0.0)))
    return scored.groupBy(*group).agg(F.min_by("value", F.struct(-F.col("gap"), F.col("value"))).alias("threshold"))


def masked_percent(df: DataFrame, stations: DataFrame, mask: str, station: str = "station_id") -> DataFrame:
    """(station, rows, percent): how many of a selected station's rows are masked; null for stations without rows."""
    rates = df.groupBy(station).agg(F.count(F.lit(1)).alias("rows"), (100.0 * F.avg(truth(F.col(mask)).cast("int"))).alias("percent"))
    return stations.select(station).distinct().join(rates, station, "left").select(station, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "percent")


def knee_mask(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Adds mask_md: strictly above the group's knee threshold."""
    threshold = durable(knee_threshold(df, value, group))
    return df.join(F.broadcast(threshold), group, "left").withColumn("mask_md", truth(F.col(value) > F.col("threshold"))).drop("threshold")


def union_masks(raw: DataFrame, logic: DataFrame, md: DataFrame, health: DataFrame, threshold: float = 0.3, station: str = "station_id", time: str = "timestamp") -> DataFrame:
    """(time, station, mask_logic, mask_md, mask_hf): flags by key, false where unknown; mask_hf where the day's health is under the threshold."""
    keys = [time, station]
    flags = lambda t, c: t.groupBy(*keys).agg(F.bool_or(truth(F.col(c))).alias(c))
    low = health.groupBy(station, "date").agg((F.min(health.columns[-1]) < threshold).alias("mask_hf"))
    base = raw.select(*keys).distinct().withColumn("date", F.to_date(time))
    joined = base.join(flags(logic, "mask_logic"), keys, "left").join(flags(md, "mask_md"), keys, "left").join(low, [station, "date"], "left")
    return joined.select(*keys, *(truth(F.col(m)).alias(m) for m in ("mask_logic", "mask_md", "mask_hf")))


def mask_overlap(df: DataFrame, masks: list[str]) -> DataFrame:
    """(masks, rows, percent) for every non-empty subset of the masks: rows where all of it hold; one aggregation."""
    subsets = [s for n in range(1, len(masks) + 1) for s in itertools.combinations(masks, n)]
    every = lambda s: reduce(lambda a, b: a & b, (truth(F.col(m)) for m in s))
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(every(s)).alias(f"c{k}") for k, s in enumerate(subsets)))
    each = F.explode(F.array(*(F.struct(F.lit("&".join(s)).alias("masks"), F.col(f"c{k}").alias("rows")) for k, s in enumerate(subsets))))
    return row.select("n", each.alias("e")).select("e.masks", "e.rows", F.try_divide(100.0 * F.col("e.rows"), F.col("n").cast("double")).alias("percent"))
