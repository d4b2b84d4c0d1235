"""Forecast baselines, error metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.operators.features import HORIZONS

METRIC_COLUMNS = ["run_id", "split", "model", "ablation", "horizon_min", "mae", "rmse", "mape", "n_samples", "train_time_sec", "peak_gpu_mem_mb", "notes"]
METRIC_SCHEMA = "run_id string, split string, model string, ablation string, horizon_min string, mae double, rmse double, mape double, n_samples long, train_time_sec double, peak_gpu_mem_mb double, notes string"


def error_columns(prediction: Column, true: Column, floor: float = 1.0) -> list[Column]:
    """The sums that all metrics follow from; rows with a null on either side don't count."""
    e = F.abs(prediction - true)
    return [F.sum(e).alias("abs_sum"), F.sum(e * e).alias("sq_sum"), F.sum(e / F.greatest(F.abs(true), F.lit(floor)) * 100).alias("pct_sum"), F.count(e).alias("n")]


def pooled_metrics(predictions: DataFrame, prediction: str = "prediction", true: str = "truth", horizon: str = "horizon", by: list[str] = ()) -> DataFrame:
    """(by, horizon, mae, rmse, mape, n) for each horizon and, as ``all``, over their pooled sums; nulls where n is 0."""
    sums = predictions.groupBy(*by, horizon).agg(*error_columns(F.col(prediction), F.col(true)))
    parts = ["abs_sum", "sq_sum", "pct_sum", "n"]
    total = sums.groupBy(*by).agg(*(F.sum(p).alias(p) for p in parts)).withColumn(horizon, F.lit("all"))
    both = sums.select(*by, F.col(horizon).cast("string").alias(horizon), *parts).unionByName(total)
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    return both.select(*by, horizon, (F.col("abs_sum") / n).alias("mae"), F.sqrt(F.col("sq_sum") / n).alias("rmse"), (F.col("pct_sum") / n).alias("mape"), F.col("n").cast("long").alias("n"))


def metric_rows(metrics: DataFrame, run_id: str, split: str, model: str, ablation: str = "none", notes: str = "", horizon: str = "horizon") -> DataFrame:
    """The fixed metric table."""
    return metrics.select(F.lit(run_id).alias("run_id"), F.lit(split).alias("split"), F.lit(model).alias("model"), F.lit(ablation).alias("ablation"), F.regexp_replace(horizon, "min$", "").alias("horizon_min"), "mae", "rmse", "mape", F.col("n").alias("n_samples"), F.lit(None).cast("double").alias("train_time_sec"), F.lit(None).cast("double").alias("peak_gpu_mem_mb"), F.lit(notes).alias("notes"))


def unpivot_horizons(df: DataFrame, keep: list[str], prediction: dict[str, Column], deltas: dict[str, int] = HORIZONS) -> DataFrame:
    """(keep, horizon, prediction, truth) from columns y_<horizon>."""
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), prediction[h].cast("double").alias("prediction"), F.col(f"y_{h}").cast("double").alias("truth")) for h in deltas)))
    return df.select(*keep, each.alias("e")).select(*keep, "e.*")


def last_value(samples: DataFrame, value: str, keep: list[str], deltas: dict[str, int] = HORIZONS) -> DataFrame:
    """Predicts every horizon by the present value."""
    return unpivot_horizons(samples, keep, {h: F.col(value) for h in deltas}, deltas)


def historical_average(train_targets: DataFrame, asked: DataFrame, node: str, slot: str, target: str) -> DataFrame:
    """Adds prediction: the mean of the train targets at the asked row's node and slot of day, else at its node."""
    fine = train_targets.groupBy(node, slot).agg(F.avg(target).alias("_fine"))
    coarse = train_targets.groupBy(node).agg(F.avg(target).alias("_coarse"))
    return asked.join(fine, [node, slot], "left").join(coarse, node, "left").withColumn("prediction", F.coalesce("_fine", "_coarse")).drop("_fine", "_coarse")


def hour_matrix(errors: DataFrame, deltas: dict[str, int] = HORIZONS, horizon: str = "horizon", hour: str = "hour", error: str = "abs_error") -> DataFrame:
    """(horizon, hour, mean_error) for all 24 hours; 0 where there is nothing."""
    spark = errors.sparkSession
    grid = spark.createDataFrame([(h, k) for h in deltas for k in range(24)], f"{horizon} string, {hour} long")
    means = errors.groupBy(horizon, F.col(hour).cast("long").alias(hour)).agg(F.avg(error).alias("mean_error"))
    return grid.join(means, [horizon, hour], "left").withColumn("mean_error", F.coalesce("mean_error", F.lit(0.0)))


def scaling_report(epochs: DataFrame, base_world: int = 1) -> DataFrame:
    """(world_size, epoch_time, speedup, notes) from (world_size, phase, phase_time_sec, notes): mean train epoch, and the base's time over it (null without a base)."""
    means = epochs.groupBy("world_size").agg(F.avg(F.when(F.col("phase") == "train", F.col("phase_time_sec"))).alias("epoch_time"), F.concat_ws(";", F.array_sort(F.collect_set("notes"))).alias("notes"))
    base = means.where(F.col("world_size") == base_world).select(F.col("epoch_time").alias("_base"))
    joined = means.join(F.broadcast(base), F.lit(True), "left")
    return joined.select("world_size", "epoch_time", F.try_divide("_base", "epoch_time").alias("speedup"), "notes")


def ablation_report(metrics: DataFrame, wanted: list[str], proxies: dict[str, str] | None = None, horizons: tuple[str, ...] = ("5", "15", "30", "all")) -> DataFrame:
    """The metric rows of the wanted ablations; a proxy model's rows under its ablation; and ``not_available`` rows for the rest."""
    spark = metrics.sparkSession
    out = metrics.where(F.col("ablation").isin(*wanted))
    for ablation, model in (proxies or {}).items():
        proxy = metrics.where(F.col("model") == model).withColumns({"ablation": F.lit(ablation), "notes": F.concat_ws(";", F.nullif("notes", F.lit("")), F.lit(f"proxy:{model}"))})
        out = out.unionByName(proxy)
    grid = spark.createDataFrame([(a, h) for a in wanted for h in horizons], "ablation string, horizon_min string")
    missing = grid.join(out.select("ablation", "horizon_min").distinct(), ["ablation", "horizon_min"], "left_anti")
    rest = {c: F.lit(None) for c in METRIC_COLUMNS if c not in ("ablation", "horizon_min")}
    filled = missing.withColumns(rest | {"notes": F.lit("not_available"), "model": F.lit("not_available")})
    types = dict(metrics.dtypes)
    return out.unionByName(filled.select(*(F.col(c).cast(types[c]).alias(c) for c in metrics.columns)))


def station_series(predictions: DataFrame, station, horizon: str) -> DataFrame:
    """(station_id, horizon, timestamp, prediction, truth, abs_error) of one station in order of time."""
    one = predictions.where((F.col("station_id") == F.lit(station)) & (F.col("horizon") == horizon))
    return one.select("station_id", "horizon", "timestamp", "prediction", "truth", F.abs(F.col("prediction") - F.col("truth")).alias("abs_error")).orderBy("timestamp")


def forest_baseline(train: DataFrame, test: DataFrame, features: list[str], target: str, trees: int = 50, depth: int = 16, leaf: int = 2, most_rows: int = 100_000, seed: int = 42) -> DataFrame:
    """Adds prediction by a random forest from a bounded hash-ordered sample of the train rows; rows with nulls are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    pack = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    rows = train.where(F.col(target).isNotNull()).orderBy(F.xxhash64(*features, target)).limit(most_rows)
    model = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="prediction", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(pack.transform(rows))
    return model.transform(pack.transform(test)).drop("_x")


def fit_regression(train: DataFrame, features: list[str], target: str, regularization: float = 1e-3):
    """A pipeline of the features' vector and a linear model, fitted on the rows with a target."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    pack = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    return Pipeline(stages=[pack, LinearRegression(featuresCol="_x", labelCol=target, predictionCol="prediction", regParam=regularization)]).fit(train.where(F.col(target).isNotNull()))


def save_model(model, path: str) -> None:
    """A fitted pipeline as a folder that every machine can load from."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def predict_station(model, rows: DataFrame, near: DataFrame, station, key: str = "station_id", time: str = "timestamp") -> DataFrame:
    """Adds prediction to the rows of a station and its neighbours at the last time that the station has.

    ``near`` is (station, neighbour). KeyError if the station has no rows.
    """
    last = rows.where(F.col(key) == F.lit(station)).agg(F.max(time)).first()[0]
    if last is None:
        raise KeyError(station)
    asked = near.where(F.col(near.columns[0]) == F.lit(station)).select(F.col(near.columns[1]).alias(key))
    asked = asked.unionByName(asked.sparkSession.range(1).select(F.lit(station).alias(key))).distinct()
    here = rows.where(F.col(time) == F.lit(last).cast(dict(rows.dtypes)[time])).join(asked, key, "left_semi")
    return model.transform(here).drop("_x")


def graph_regression(train: DataFrame, test: DataFrame, features: list[str], target: str, regularization: float = 1e-3) -> DataFrame:
    """Adds prediction by a linear model over the given features, such as a node's own and its neighbourhood means."""
    return fit_regression(train, features, target, regularization).transform(test).drop("_x")


def rank_by(df: DataFrame, by: list[str], order: list[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
