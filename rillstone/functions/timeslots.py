"""Time slots, calendars and regular grids. Weekdays count from Monday = 0."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT_MINUTES = 5


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def floor_time(ts: Column, minutes: int) -> Column:
    """The start of the time slot of so many minutes, counted from midnight."""
    day = F.to_date(ts).cast("timestamp_ntz")
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")
    return F.timestamp_add("MINUTE", slot * minutes, day)


def slot_of_day(ts: Column, minutes: int = SLOT_MINUTES) -> Column:
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("long")


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month; the last for n = -1."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def federal_holidays(year: int) -> set[dt.date]:
    """The eleven US federal holidays of a year, and the weekdays on which those of fixed date are observed."""
    fixed = [dt.date(year, m, d) for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))]
    moving = [nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), nth_weekday(year, 5, 0, -1), nth_weekday(year, 9, 0, 1), nth_weekday(year, 10, 0, 2), nth_weekday(year, 11, 3, 4)]
    observed = [d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0)) for d in fixed]
    return {*fixed, *moving, *observed}


def holiday_table(spark: SparkSession, years: range) -> DataFrame:
    """(date) of the holidays of a range of years; at most some sixteen rows a year."""
    days = sorted({d for y in years for d in federal_holidays(y)})
    return spark.createDataFrame([(d,) for d in days], "date date")


def with_calendar(df: DataFrame, time: str = "timestamp", slots_per_day: int = 288, years: range | None = None) -> DataFrame:
    """Adds slot, weekday, is_weekend, is_holiday and the sine and cosine of time of day and of week."""
    ts = F.col(time)
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) * slots_per_day / 1440).cast("long")
    weekday = F.weekday(ts).cast("long")
    day, week = slot * (2 * math.pi / slots_per_day), weekday * (2 * math.pi / 7)
    out = df.select("*", slot.alias("slot"), weekday.alias("weekday"), (weekday >= 5).alias("is_weekend"), F.sin(day).alias("sin_day"), F.cos(day).alias("cos_day"), F.sin(week).alias("sin_week"), F.cos(week).alias("cos_week"))
    if years is None:
        low, high = df.agg(F.min(F.year(ts)), F.max(F.year(ts))).first()
        years = range(low or 1970, (high or 1969) + 1)
    days = holiday_table(df.sparkSession, years).select(F.col("date").alias("_holiday"))
    joined = out.join(F.broadcast(days), F.to_date(ts) == F.col("_holiday"), "left")
    return joined.withColumn("is_holiday", F.col("_holiday").isNotNull()).drop("_holiday")


def regular_grid(df: DataFrame, keys: list[str], time: str, minutes: int) -> DataFrame:
    """Every slot between a key's first and last time, with the row that is there (other columns null if none)."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    spans = df.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    grid = spans.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias(time))
    return grid.join(df, [*keys, time], "left")


def resample_linear(df: DataFrame, keys: list[str], time: str, values: list[str], minutes: int) -> DataFrame:
    """Rows every so many minutes between neighbouring rows of a key, on the line between their values.

    A null end leaves the inner points null; the last row of a key stays as it is.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(time)
    ends = df.select(*keys, time, *values, F.lead(time).over(w).alias("_t1"), *(F.lead(v).over(w).alias(f"_{v}") for v in values))
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    points = F.filter(F.sequence(F.col(time), F.coalesce("_t1", time), step), lambda t: t.eqNullSafe(F.col(time)) | (t < F.col("_t1")))
    each = ends.select(*keys, F.col(time).alias("_t0"), "_t1", F.explode(points).alias(time), *values, *(f"_{v}" for v in values))
    share = F.try_divide(F.timestamp_diff("SECOND", F.col("_t0"), F.col(time)).cast("double"), F.timestamp_diff("SECOND", F.col("_t0"), F.col("_t1")).cast("double"))
    line = [F.when(F.col(time) == F.col("_t0"), F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}") - F.col(v)) * share).alias(v) for v in values]
    return each.select(*keys, time, *line)
