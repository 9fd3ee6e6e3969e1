"""Baseline forecasts: imputation by the last value, and seasonal naive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import DENOM_FLOOR, steps

KEYS = ["series_id", "channel_idx"]


def impute_last(points: DataFrame) -> DataFrame:
    """Adds filled: the last observed value, before the first one that one, 0 where nothing is observed."""
    back = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return points.withColumn("filled", F.coalesce(F.last("y", ignorenulls=True).over(back), F.first("y", ignorenulls=True).over(ahead), F.lit(0.0)))


def seasonal_naive(context: DataFrame, p: int, season: int) -> DataFrame:
    """(series, channel, h, yhat) for h = 0..p-1: step n - m + h mod m of the imputed context.

    A context shorter than the season repeats the mean of what it has, or 0.
    """
    filled = impute_last(context)
    size = filled.groupBy(*KEYS).agg(F.max("t").alias("last"), F.count("*").alias("n"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("mean"))
    rows = size.select("*", steps(p).alias("h"))
    rows = rows.withColumn("t", F.when(F.col("n") >= season, F.col("last") + 1 - season + F.pmod("h", F.lit(season))))
    joined = rows.join(filled.select(*KEYS, "t", "filled"), [*KEYS, "t"], "left")
    return joined.select(*KEYS, "h", F.when(F.col("n") >= season, F.coalesce("filled", F.lit(0.0))).otherwise(F.col("mean")).alias("yhat"))


def last_value(context: DataFrame, p: int) -> DataFrame:
    return seasonal_naive(context, p, 1)


def drift(context: DataFrame, p: int) -> DataFrame:
    """The imputed last value and the mean step of the imputed context."""
    filled = impute_last(context)
    ends = filled.groupBy(*KEYS).agg(F.min_by("filled", "t").alias("a"), F.max_by("filled", "t").alias("b"), F.count("*").alias("n"))
    rows = ends.select("*", steps(p).alias("h"))
    return rows.select(*KEYS, "h", (F.col("b") + (F.col("h") + 1) * (F.col("b") - F.col("a")) / F.greatest(F.col("n") - 1, F.lit(1))).alias("yhat"))


def seasonal_difference(context: DataFrame, season: int) -> DataFrame:
    """Adds lagged and diff: y minus y a season ago, null where either is missing."""
    lagged = F.lag("y", season).over(Window.partitionBy(*KEYS).orderBy("t"))
    return context.withColumn("lagged", lagged).withColumn("diff", F.col("y") - F.col("lagged"))


def seasonal_denominator(context: DataFrame, season: int) -> DataFrame:
    """(series, channel, denom): mean absolute seasonal difference, with a floor."""
    diffs = seasonal_difference(context, season)
    return diffs.groupBy(*KEYS).agg(F.greatest(F.coalesce(F.avg(F.abs("diff")), F.lit(DENOM_FLOOR)), F.lit(DENOM_FLOOR)).alias("denom"))
