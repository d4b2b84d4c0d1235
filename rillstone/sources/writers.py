"""Sinks: CSV, Parquet, metric tables, small JSON documents and dense exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.evaluate import METRIC_COLUMNS, METRIC_SCHEMA


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by_date: str | None = None, mode: str = "overwrite") -> None:
    """Snappy Parquet; with a time column, one folder a day, rows dealt by day and a hash so that no day is one task's."""
    if by_date is None:
        df.write.mode(mode).option("compression", "snappy").parquet(path)
        return
    dated = df.withColumn("date", F.to_date(by_date))
    dated.repartition("date", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode(mode).option("compression", "snappy").partitionBy("date").parquet(path)


def write_metrics(df: DataFrame, path: str, append: bool = False) -> None:
    """The fixed metric columns; missing ones are empty."""
    types = dict(x.split() for x in METRIC_SCHEMA.split(", "))
    cells = [F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in METRIC_COLUMNS]
    df.select(*cells).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).option("header", True).csv(path)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One small document as one text file, by Spark's own file system."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_dense(panel: DataFrame, features: list[str], most_cells: int = 50_000_000):
    """The panel as a numpy array (times, nodes, features), for panels of at most so many cells; ValueError above."""
    import numpy as np

    size = panel.agg(F.max("time_idx"), F.max("node_idx")).first()
    shape = ((size[0] if size[0] is not None else -1) + 1, (size[1] if size[1] is not None else -1) + 1, len(features))
    if shape[0] * shape[1] * shape[2] > most_cells:
        raise ValueError(f"a panel of {shape} cells is too large for one machine")
    out = np.full(shape, np.nan, np.float32)
    for row in panel.select("time_idx", "node_idx", *features).toLocalIterator():
        out[row[0], row[1]] = [np.nan if v is None else v for v in row[2:]]
    return out
