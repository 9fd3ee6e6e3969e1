"""MASE by channel, geometric means by configuration, and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import DENOM_FLOOR, gmean, skill

from .forecast import KEYS


def mase(forecast: DataFrame, labels: DataFrame, denom: DataFrame) -> DataFrame:
    """(series, channel, mase): mean absolute error over observed labels by the denominator.

    Missing labels leave out their step; a channel without labels has no row; a forecast
    is never left out, so NaN and infinity in it poison the score.
    """
    rows = labels.where("y is not null").select(*KEYS, "h", "y").join(forecast, [*KEYS, "h"], "left")
    error = rows.groupBy(*KEYS).agg(F.avg(F.abs(F.coalesce("yhat", F.lit(float("nan"))) - F.col("y"))).alias("mae"))
    return error.join(denom, KEYS).select(*KEYS, (F.col("mae") / F.greatest("denom", F.lit(DENOM_FLOOR))).alias("mase"))


def first_items(items: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` items of each configuration by item_seq; below 0: all."""
    if cap < 0:
        return items
    return items.withColumn("rn", F.row_number().over(Window.partitionBy("config_id").orderBy("item_seq"))).where(F.col("rn") <= cap).drop("rn")


def per_config(scores: DataFrame) -> DataFrame:
    """scores: config_id, series_id, model, naive by channel (null: not scorable)."""
    return scores.groupBy("config_id").agg(
        gmean("model").alias("model_mase"),
        gmean("naive").alias("naive_mase"),
        F.countDistinct("series_id").alias("n_items"),
        F.count("model").alias("n_channels"),
    ).withColumn("skill", skill("model_mase", "naive_mase"))


def board(configs: DataFrame) -> DataFrame:
    """One row: geometric means over configurations that have a scored channel."""
    full = F.col("n_channels") > 0
    return configs.agg(
        gmean(F.when(full, F.col("model_mase"))).alias("model_mase"),
        gmean(F.when(full, F.col("naive_mase"))).alias("naive_mase"),
        F.count("*").alias("n_configs"),
        F.count_if(full).alias("n_scored"),
        F.count_if(full & ~F.isnan("model_mase") & (F.abs("model_mase") != float("inf"))).alias("n_finite"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"),
    ).withColumn("skill", skill("model_mase", "naive_mase"))


def ranking(configs: DataFrame, top: int | None = None) -> DataFrame:
    """Configurations by skill, NaN last."""
    out = configs.orderBy(F.isnan("skill"), "skill", "config_id")
    return out if top is None else out.limit(top)


def scalars(report: DataFrame, prefix: str) -> DataFrame:
    """A one-row report as (key, value); NaN and non-numbers go, infinity stays."""
    numbers = [c for c, t in report.dtypes if t in ("double", "float", "int", "bigint")]
    rows = report.select([F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "key", "value")
    return rows.where("value is not null and not isnan(value)").select(F.concat(F.lit(prefix + "/"), "key").alias("key"), "value")


def keyed_sample(items: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` items without replacement, by the md5 of seed and key: the same whatever the layout."""
    return items.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def item_counts(points: DataFrame) -> DataFrame:
    """config_id, n_items, n_channels, n_values."""
    return points.groupBy("config_id").agg(F.countDistinct("series_id").alias("n_items"), F.countDistinct("series_id", "channel_idx").alias("n_channels"), F.count("y").alias("n_values"))
