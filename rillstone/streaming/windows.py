"""Windowed aggregates over batch or streaming readings, and online state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zoned(df: DataFrame, time: str) -> DataFrame:
    """The time column as a zoned timestamp (the session's zone), which watermarks ask for."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], value: str, watermark: str | None = None) -> DataFrame:
    """(window_start, keys, n, total, average) by fixed windows."""
    source = zoned(df, time).withWatermark(time, watermark) if watermark else df
    out = source.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total", "average")


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], value: str, watermark: str | None = None) -> DataFrame:
    source = zoned(df, time).withWatermark(time, watermark) if watermark else df
    out = source.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    """(keys, session_start, session_end, n): runs of rows less than a gap apart; the end is the last row's time."""
    source = zoned(df, time).withWatermark(time, watermark) if watermark else df
    out = source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("session_end"))
    return out.select(*keys, F.col("w.start").alias("session_start"), "session_end", "n")


def running_fill(df: DataFrame, key: str, time: str, value: str):
    """A stream of (key, time, value, filled): missing values carry the key's last known one.

    Rows of a micro-batch are taken in order of time; the state of a key is one number.
    """
    import pandas as pd

    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        filled = []
        for v in rows[value]:
            last = last if pd.isna(v) else float(v)
            filled.append(last)
        if last is not None:
            state.update((last,))
        yield rows.assign(filled=pd.array(filled, dtype="Float64"))[[key, time, value, "filled"]]

    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {time} {types[time]}, {value} double, filled double"
    from pyspark.sql.streaming.state import GroupStateTimeout

    return df.select(key, time, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_fill_with_state(df: DataFrame, key: str, time: str, value: str):
    """``running_fill`` by a stateful processor, whose state Spark keeps on disk, in RocksDB.

    ValueError unless the session's ``spark.sql.streaming.stateStore.providerClass`` is ``STATE_STORE``.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")

    class Carry(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("last", "v double")

        def handleInputRows(self, key_row, frames, timer_values):
            last = self.state.get()[0] if self.state.exists() else None
            rows = pd.concat(list(frames)).sort_values(time, kind="stable")
            filled = []
            for v in rows[value]:
                last = last if pd.isna(v) else float(v)
                filled.append(last)
            if last is not None:
                self.state.update((last,))
            yield rows.assign(filled=pd.array(filled, dtype="Float64"))[[key, time, value, "filled"]]

        def close(self) -> None:
            pass

    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {time} {types[time]}, {value} double, filled double"
    rows = df.select(key, time, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).transformWithStateInPandas(Carry(), schema, "append", "none")
