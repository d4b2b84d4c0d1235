"""Sources: raw text, delimited, Parquet and JSON tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names by position of the raw sensor files; the column without a name isn't kept.
RAW_COLUMNS = ["timestamp", "station_id", None, "freeway_id", "direction", "lane_type", "station_length", "samples", "pct_observed", "flow", "occupancy", "speed"]
RAW_TYPES = {"station_id": "long", "freeway_id": "long", "station_length": "double", "samples": "long", "pct_observed": "long", "flow": "double", "occupancy": "double", "speed": "double"}
#: Other names of a column, in lower case.
ALIASES = {"station_id": ("id", "station", "station_id"), "lat": ("lat", "latitude"), "lon": ("lon", "longitude", "lng")}


def read_raw(spark: SparkSession, path: str | list[str], columns: list[str | None] = RAW_COLUMNS, types: dict[str, str] = RAW_TYPES, time: str = "timestamp", time_format: str = "MM/dd/yyyy HH:mm:ss") -> DataFrame:
    """Headerless positional CSV files; cells that don't parse, and NaN, are null."""
    names = [c or f"_skip{k}" for k, c in enumerate(columns)]
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    cast = lambda c: F.expr(f"try_cast(trim(`{c}`) AS {types[c]})") if c in types else F.col(c)
    no_nan = lambda c: F.when(~F.isnan(cast(c)), cast(c)) if types.get(c) == "double" else cast(c)
    stamp = F.try_to_timestamp(F.trim(time), F.lit(time_format)).cast("timestamp_ntz")
    return rows.select(*((stamp if c == time else no_nan(c)).alias(c) for c in columns if c))


def read_split_text(spark: SparkSession, path: str, delimiter: str = r"[\t,]", header: list[str] | None = None) -> DataFrame:
    """Text lines split by a regular expression, all strings; without a header the first line of each file names the columns."""
    lines = spark.read.text(path)
    if header is None:
        import re

        header = [h.strip() for h in re.split(delimiter, lines.first()["value"])]
        lines = lines.where(F.col("value") != lines.first()["value"])
    parts = F.split("value", delimiter)
    return lines.select(*(F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("")).alias(h) for k, h in enumerate(header)))


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """CSV or TSV with a header; without a schema all columns are strings; header names are trimmed."""
    reader = spark.read.option("header", True).option("sep", sep).option("nanValue", "NaN")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str, time: str | None = "timestamp") -> DataFrame:
    """Parquet by its extension (parquet, pq, or a folder without one), else CSV; the time column as a timestamp without zone."""
    ext = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)
    df = read_delimited(spark, path) if len(ext) == 2 and ext[1].lower() in ("csv", "txt", "gz") else spark.read.parquet(path)
    if time in df.columns and dict(df.dtypes)[time] != "timestamp_ntz":
        df = df.withColumn(time, F.expr(f"try_cast(`{time}` AS timestamp_ntz)"))
    return df


def read_parquet(spark: SparkSession, path: str, columns: list[str], required: list[str] | None = None) -> DataFrame:
    """A pruned Parquet scan; ValueError names required columns that are missing."""
    df = spark.read.parquet(path)
    missing = [c for c in required or columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*(c for c in columns if c in df.columns))


def with_file_date(df: DataFrame, pattern: str = r"(\d{8})\.[^.]*$", date_format: str = "MMddyyyy", name: str = "date") -> DataFrame:
    """Adds the date that the file's name ends with."""
    return df.withColumn(name, F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(F.input_file_name(), pattern, 1), F.lit("")), F.lit(date_format))))


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the ``features`` arrays of saved JSON pages, their ``properties`` parsed by a schema."""
    pages = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"features array<struct<properties:struct<{schema}>>>")
    return pages.select(F.explode(parsed["features"]).alias("f")).select("f.properties.*")


def time_range(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """lo, hi: read from file statistics where Spark pushes aggregates down."""
    return df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))


def parse_time(column: str, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss")):
    """The first of the formats that parses."""
    return F.coalesce(*(F.try_to_timestamp(F.col(column), F.lit(f)) for f in formats)).cast("timestamp_ntz")


def normalize_columns(df: DataFrame, required: list[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Renames columns to their standard names, whatever their case; ValueError names required ones that are missing."""
    found = {}
    for c in df.columns:
        low = c.strip().lower()
        name = next((k for k, v in aliases.items() if low in v), low)
        if name not in found or c == name:
            found[name] = c
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in found.items()))


def rename_kept(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that the map knows, under their new names."""
    return df.select(*(F.col(f"`{c}`").alias(names[c]) for c in df.columns if c in names))


def rename_last(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed(df.columns[-1], name)


def either_schema(df: DataFrame, features: list[str], suffix: str = "_interp") -> DataFrame:
    """The features under their base names, from base or suffixed columns; ValueError names those that neither has."""
    missing = [f for f in features if f not in df.columns and f + suffix not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    taken = {f if f in df.columns else f + suffix: f for f in features}
    return df.select(*(F.col(c).alias(taken.get(c, c)) for c in df.columns if c in taken or c not in {f + suffix for f in features}))
