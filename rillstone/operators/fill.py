"""Filling of masked or missing readings: neighbours, group means, time brackets, carrying, and their chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.numeric import truth
from rillstone.functions.timeslots import micros
from rillstone.storage import durable

FEATURES = ["flow", "occupancy", "speed"]
MASKS = ["mask_logic", "mask_md", "mask_hf"]
GROUP = ["station_id", "direction"]


def mask_flag(df: DataFrame, features: list[str] | None = None, masks: list[str] = MASKS) -> Column:
    """True where any mask that the table has is true, or any of the features is null."""
    terms = [truth(F.col(m)) for m in masks if m in df.columns] + [F.col(f).isNull() for f in features or ()]
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def null_out(df: DataFrame, features: list[str] = FEATURES, masks: list[str] = MASKS, flag: str = "mask_flag") -> DataFrame:
    """Adds the flag and makes all features null where it is true, so that masked values can't leak."""
    flagged = df.withColumn(flag, mask_flag(df, features, masks))
    return flagged.withColumns({f: F.when(~F.col(flag), F.col(f)) for f in features})


def local_fill(df: DataFrame, neighbours: DataFrame, features: list[str] = FEATURES, station: str = "station_id", time: str = "timestamp", flag: str = "mask_flag", suffix: str = "_local") -> DataFrame:
    """Adds the mean of the neighbours' unmasked values at the same time to masked rows, feature by feature.

    ``neighbours`` is (station, neighbour); it has k rows a station and is joined by its station,
    the readings by (neighbour, time). Values at the same place and time are averaged first, so
    each neighbour counts once per reading of its own.
    """
    known = df.where(~F.col(flag)).select(F.col(station).alias("_n"), F.col(time).alias("_t"), *(F.col(f).alias(f"_{f}") for f in features))
    asked = df.where(F.col(flag)).select(F.col(station).alias("_s"), F.col(time).alias("_t")).distinct()
    pairs = neighbours.select(F.col(neighbours.columns[0]).alias("_s"), F.col(neighbours.columns[1]).alias("_n"))
    means = asked.join(pairs, "_s").join(known, ["_n", "_t"]).groupBy("_s", "_t").agg(*(F.avg(f"_{f}").alias(f"{f}{suffix}") for f in features))
    joined = df.join(means, (F.col(station) == F.col("_s")) & (F.col(time) == F.col("_t")), "left").drop("_s", "_t")
    return joined.withColumns({f"{f}{suffix}": F.when(F.col(flag), F.col(f"{f}{suffix}")) for f in features})


def group_mean_fill(df: DataFrame, features: list[str], group: list[str], flag: str = "mask_flag") -> DataFrame:
    """Masked values become the mean of their group's unmasked ones, if it has any.

    The means are aggregated with partial sums and joined back, so a large group is never held
    in one place.
    """
    means = df.groupBy(*group).agg(*(F.avg(F.when(~F.col(flag), F.col(f))).alias(f"_{f}") for f in features))
    named = means.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), *(f"_{f}" for f in features))
    on = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)))
    joined = df.join(named, on, "left")
    return joined.withColumns({f: F.when(F.col(flag), F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in features}).select(*df.columns)


def _sides(condition: Column, values: list[Column], group: list[str], order: list[str]) -> tuple[Column, Column]:
    """The nearest rows up to and from here where the condition holds, as structs.

    Looking ahead is a running last in reverse order: linear, where a frame to the end of the
    partition would be computed anew for each row.
    """
    kept = F.when(condition, F.struct(*values))
    back = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*group).orderBy(*(F.col(o).desc() for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(kept, True).over(back), F.last(kept, True).over(ahead)


def bracket_interpolate(df: DataFrame, features: list[str], group: list[str], time: str, flag: str = "mask_flag", tie: list[str] = (), least_known: int = 1) -> DataFrame:
    """Masked values lie on the line between the nearest unmasked rows before and after in their group.

    With only one side its value is held; with fewer than ``least_known`` unmasked rows the
    values stay. Rows at the same time are ordered by ``tie``; where both sides have the same
    time, the earlier row's value is taken.
    """
    known = ~F.col(flag)
    values = [micros(time).alias("t"), *(F.col(f).alias(f) for f in features)]
    before, after = _sides(known, values, group, [time, *tie])
    out = df.withColumns({"_b": before, "_a": after})
    if least_known > 1:
        out = out.withColumn("_n", F.count_if(known).over(Window.partitionBy(*group)))
    enough = F.col("_n") >= least_known if least_known > 1 else F.lit(True)
    share = F.try_divide((micros(time) - F.col("_b.t")).cast("double"), (F.col("_a.t") - F.col("_b.t")).cast("double"))

    def filled(f):
        b, a = F.col(f"_b.{f}"), F.col(f"_a.{f}")
        line = F.coalesce(b + (a - b) * share, b)
        return F.when(known | ~enough, F.col(f)).when(F.col("_b").isNull() & F.col("_a").isNull(), F.col(f)).when(F.col("_b").isNull(), a).when(F.col("_a").isNull(), b).otherwise(line)

    return out.withColumns({f: filled(f) for f in features}).select(*df.columns)


def interp_fill(df: DataFrame, features: list[str], group: list[str], time: str, flag: str = "mask_flag", tie: list[str] = ()) -> DataFrame:
    """Each feature on its own: masked values interpolated between unmasked, non-null ones, ends clamped, if there are two at least."""
    out = df
    for f in features:
        one = out.withColumn("_unknown", F.col(flag) | F.col(f).isNull())
        filled = bracket_interpolate(one.withColumn("_raw", F.col(f)), [f], group, time, "_unknown", tie, least_known=2)
        out = filled.withColumn(f, F.when(F.col(flag), F.col(f)).otherwise(F.col("_raw"))).select(*df.columns)
    return out


def carry_fill(df: DataFrame, features: list[str], group: list[str], order: list[str], backward: bool = True) -> DataFrame:
    """Nulls take the last value before them in their group, then, if asked, the next after them."""
    out = {}
    for f in features:
        before, after = _sides(F.col(f).isNotNull(), [F.col(f).alias("v")], group, order)
        out[f] = F.coalesce(F.col(f), before["v"], after["v"] if backward else F.lit(None))
    return df.withColumns(out)


def fill_chain(df: DataFrame, neighbours: DataFrame, features: list[str] = FEATURES, group: list[str] = GROUP, station: str = "station_id", time: str = "timestamp", masks: list[str] = MASKS, tie: list[str] = (), precedence: str = "bracket") -> DataFrame:
    """Masked interpolation: what is unmasked stays; a masked value is, in this order, its bracket's
    (if its group has any unmasked row), its neighbours' mean at its time, the value carried
    forward or else backward in its group, the mean of its group's values, the overall mean.

    ``precedence="local"`` puts the neighbours before the bracket. Whole groups count, whatever
    the partitions.
    """
    if precedence not in ("bracket", "local"):
        raise ValueError("precedence is 'bracket' or 'local'")
    masked = null_out(df, features, masks)
    local = local_fill(masked, neighbours, features, station, time)
    bracket = bracket_interpolate(local, features, group, time, "mask_flag", tie)
    picks = {}
    for f in features:
        near = F.col(f"{f}_local")
        picks[f] = F.coalesce(near, f) if precedence == "local" else F.coalesce(f, near)
    stage = bracket.withColumns({f: F.when(F.col("mask_flag"), picks[f]).otherwise(F.col(f)) for f in features}).drop(*(f"{f}_local" for f in features))
    # written once: both the overall means and the result read it
    stage = durable(carry_fill(stage, features, group, [time, *tie]))
    w = Window.partitionBy(*group)
    whole = stage.agg(*(F.avg(f).alias(f"_{f}") for f in features))
    stage = stage.withColumns({f: F.coalesce(F.col(f), F.avg(f).over(w)) for f in features})
    return stage.join(F.broadcast(whole)).withColumns({f: F.coalesce(f, f"_{f}") for f in features}).drop(*(f"_{f}" for f in features))


def aggregate_mask(mask: DataFrame, keys: list[str], masks: list[str] = MASKS) -> DataFrame:
    """One row per key; masked if any of its rows is, by any mask."""
    return mask.groupBy(*keys).agg(F.bool_or(mask_flag(mask, None, masks)).alias("mask_flag"))


def refill(raw: DataFrame, mask: DataFrame, interp: DataFrame, features: list[str] = FEATURES, station: str = "station_id", time: str = "timestamp", direction: str = "direction") -> DataFrame:
    """Fills what the interpolated table still misses on masked rows; one row per (time, station).

    Masks are or-ed and interpolated values averaged by key first, so both joins are many to one
    (a null direction matches a null one). A masked null takes the mean of all rows of its time,
    then its group's values carried forward and back. Unmasked nulls stay. Directions are averaged
    at the end; the result has ``*_interp`` columns.
    """
    names = [f if f in interp.columns else f"{f}_interp" for f in features]
    missing = [n for n in names if n not in interp.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    keys = [time, station, *([direction] if all(direction in t.columns for t in (raw, mask, interp)) else [])]
    base = raw.select(*keys).distinct()
    flags = aggregate_mask(mask, keys)
    values = interp.groupBy(*keys).agg(*(F.avg(n).alias(f"{f}_interp") for f, n in zip(features, names, strict=True)))
    named = lambda t, p: t.select(*(F.col(k).alias(p + k) for k in keys), *(c for c in t.columns if c not in keys))
    on = lambda p: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(p + k)) for k in keys))
    joined = base.join(named(flags, "_m_"), on("_m_"), "left").join(named(values, "_v_"), on("_v_"), "left")
    merged = joined.select(*keys, truth(F.col("mask_flag")).alias("mask_flag"), *(f"{f}_interp" for f in features))
    at_time = Window.partitionBy(time)
    out = [f"{f}_interp" for f in features]
    first = merged.withColumns({f: F.when(F.col("mask_flag") & F.col(f).isNull(), F.avg(f).over(at_time)).otherwise(F.col(f)) for f in out})
    carried = carry_fill(first.withColumns({f"_{f}": F.col(f) for f in out}), out, keys[1:], [time])
    kept = carried.withColumns({f: F.when(F.col("mask_flag"), F.col(f)).otherwise(F.col(f"_{f}")) for f in out})
    return kept.groupBy(time, station).agg(*(F.avg(f).alias(f) for f in out))


def fill_check(raw: DataFrame, mask: DataFrame, interp: DataFrame, features: list[str] = FEATURES, station: str = "station_id", time: str = "timestamp") -> DataFrame:
    """One row: row and duplicate counts, masked rows, masked values still missing, largest change of an unmasked value by feature."""
    names = [f if f in interp.columns else f"{f}_interp" for f in features]
    keys = [time, station]
    count = lambda t, p: t.agg(F.count(F.lit(1)).alias(f"{p}_rows"), (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias(f"{p}_duplicates"))
    flags = aggregate_mask(mask, keys)
    ours = raw.groupBy(*keys).agg(*(F.avg(f).alias(f"_raw_{f}") for f in features))
    theirs = interp.groupBy(*keys).agg(*(F.avg(n).alias(f) for f, n in zip(features, names, strict=True)))
    joined = theirs.join(flags, keys, "left").join(ours, keys, "left").withColumn("mask_flag", truth(F.col("mask_flag")))
    some = reduce(lambda a, b: a | b, (F.col(f).isNull() for f in features))
    stats = joined.agg(
        F.count_if("mask_flag").alias("masked"),
        F.count_if(~F.col("mask_flag")).alias("unmasked"),
        F.count_if(F.col("mask_flag") & some).alias("missing_masked"),
        *(F.coalesce(F.max(F.when(~F.col("mask_flag"), F.abs(F.col(f) - F.col(f"_raw_{f}")))), F.lit(0.0)).alias(f"max_diff_{f}") for f in features),
    )
    return stats.join(count(raw, "raw")).join(count(mask, "mask")).join(count(interp, "interp"))
