"""Forecasters with a common shape, and scores of any of them.

A forecaster is a function (context, p) -> rows of series_id, channel_idx, h, yhat. Those here are
built in; one that needs code goes through ``model.rollout``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import DENOM_FLOOR, gmean, skill, steps

from .forecast import KEYS, impute_last
from .scoring import mase

Forecaster = Callable[[DataFrame, int], DataFrame]


def naive_by_season(context: DataFrame, p: int, seasons: DataFrame) -> DataFrame:
    """Seasonal naive where each channel has a season of its own (seasons: KEYS, season)."""
    filled = impute_last(context)
    ends = filled.groupBy(*KEYS).agg(F.max("t").alias("last"), F.count("*").alias("n"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("mean")).join(seasons, KEYS)
    rows = ends.select("*", steps(p).alias("h"))
    rows = rows.withColumn("t", F.when(F.col("n") >= F.col("season"), F.col("last") + 1 - F.col("season") + F.pmod("h", "season")))
    joined = rows.join(filled.select(*KEYS, "t", "filled"), [*KEYS, "t"], "left")
    return joined.select(*KEYS, "h", F.when(F.col("n") >= F.col("season"), F.coalesce("filled", F.lit(0.0))).otherwise(F.col("mean")).alias("yhat"))


def denominator_by_season(context: DataFrame, seasons: DataFrame) -> DataFrame:
    """(KEYS, denom): mean absolute difference over a channel's own season, with a floor."""
    rows = context.join(seasons, KEYS).select(*KEYS, "t", "y", (F.col("t") - F.col("season")).alias("__t"))
    before = context.select(*KEYS, F.col("t").alias("__t"), F.col("y").alias("before"))
    joined = rows.join(before, [*KEYS, "__t"], "left")
    return joined.groupBy(*KEYS).agg(F.greatest(F.coalesce(F.avg(F.abs(F.col("y") - F.col("before"))), F.lit(DENOM_FLOOR)), F.lit(DENOM_FLOOR)).alias("denom"))


def channel_seasons(points: DataFrame, of_series: DataFrame, of_channel: DataFrame) -> DataFrame:
    """(KEYS, season): a channel's own season, else its series'; channels with neither have no row."""
    keys = points.select(*KEYS).distinct().join(of_series.withColumnRenamed("season", "__series"), "series_id", "left").join(of_channel.withColumnRenamed("season", "__channel"), KEYS, "left")
    return keys.select(*KEYS, F.coalesce("__channel", "__series").alias("season")).where("season is not null")


def score(context: DataFrame, labels: DataFrame, seasons: DataFrame, p: int, forecaster: Forecaster) -> DataFrame:
    """KEYS, model, naive: scores of a forecaster beside the seasonal naive; channels without a season or labels have no row."""
    denom = denominator_by_season(context, seasons)
    model = mase(forecaster(context, p), labels, denom).withColumnRenamed("mase", "model")
    naive = mase(naive_by_season(context, p, seasons), labels, denom).withColumnRenamed("mase", "naive")
    return model.join(naive, KEYS)


def report(scores: DataFrame, channels: DataFrame) -> DataFrame:
    """One row: geometric means of model and naive, skill, channels scored, and channels (of ``channels``) skipped."""
    every = channels.select(*KEYS).distinct().join(scores, KEYS, "left")
    row = every.agg(gmean("model").alias("model_mase"), gmean("naive").alias("naive_mase"), F.count("model").alias("n"), F.count_if(F.col("model").isNull()).alias("skipped"))
    return row.withColumn("skill", skill("model_mase", "naive_mase"))


def mean_loss(forecast: DataFrame, labels: DataFrame, items: int | None = None) -> DataFrame:
    """One row: the mean over series (the first ``items`` of them by id) of each one's mean absolute error; NaN if there is none."""
    rows = labels.where("y is not null").join(forecast, [*KEYS, "h"])
    each = rows.groupBy("series_id").agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("loss"))
    if items is not None:
        each = each.orderBy("series_id").limit(items)
    return each.agg(F.coalesce(F.avg("loss"), F.lit(float("nan"))).alias("loss"), F.count("*").alias("n"))


# --- a linear read-out of a driver ---------------------------------------------------------


def visible(features: DataFrame, origin: int, p: int, revealed: bool) -> DataFrame:
    """series_id, t, x over the context and the horizon: the feature as known ahead, or its last value in the context."""
    rows = features.where((F.col("t") >= 0) & (F.col("t") < origin + p))
    if revealed:
        return rows.select("series_id", "t", "x")
    last = rows.where(F.col("t") < origin).groupBy("series_id").agg(F.max_by("x", F.when(F.col("x").isNotNull(), F.col("t"))).alias("last"))
    return rows.join(last, "series_id").select("series_id", "t", F.when(F.col("t") < origin, F.col("x")).otherwise(F.col("last")).alias("x"))


def driver_forecaster(features: DataFrame, origin: int, season: int) -> Forecaster:
    """Least squares of a target on the feature, and the mean residual of each phase of the season, from the context."""

    def run(context: DataFrame, p: int) -> DataFrame:
        rows = context.join(features, ["series_id", "t"]).withColumn("phase", F.pmod("t", F.lit(season)))
        fit = rows.groupBy(*KEYS).agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("b"), F.coalesce(F.regr_intercept("y", "x"), F.avg("y"), F.lit(0.0)).alias("a"))
        rest = rows.join(fit, KEYS).groupBy(*KEYS, "phase").agg(F.avg(F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("r"))
        ahead = features.where((F.col("t") >= origin) & (F.col("t") < origin + p)).withColumn("phase", F.pmod("t", F.lit(season)))
        rows = ahead.join(fit, "series_id").join(rest, [*KEYS, "phase"], "left")
        return rows.select(*KEYS, (F.col("t") - origin).alias("h"), (F.col("a") + F.col("b") * F.col("x") + F.coalesce("r", F.lit(0.0))).alias("yhat"))

    return run


def counterfactual(context: DataFrame, labels: DataFrame, features: DataFrame, seasons: DataFrame, origin: int, p: int, season: int) -> DataFrame:
    """One row: score of the same forecaster with the features' future revealed and hidden, and the cut of it in percent."""
    one = lambda revealed: score(context, labels, seasons, p, driver_forecaster(visible(features, origin, p, revealed), origin, season)).select(*KEYS, "model")
    both = one(True).withColumnRenamed("model", "on").join(one(False).withColumnRenamed("model", "off"), KEYS)
    row = both.agg(gmean("on").alias("with_future"), gmean("off").alias("past_only"), F.count("*").alias("n"))
    return row.withColumn("cut_percent", 100 * (1 - F.col("with_future") / F.col("past_only")))


def reassembled(predicted: DataFrame, grid: DataFrame, p: int, width: int) -> DataFrame:
    """predicted: KEYS, j, values (``width`` steps of patch j). grid: KEYS. KEYS, h, yhat for h < p: NaN where no patch has it."""
    rows = predicted.select(*KEYS, "j", F.posexplode("values").alias("i", "yhat")).select(*KEYS, (F.col("j") * width + F.col("i")).alias("h"), "yhat")
    cells = grid.select(*KEYS).distinct().select(*KEYS, steps(p).alias("h"))
    return cells.join(rows, [*KEYS, "h"], "left").select(*KEYS, "h", F.coalesce("yhat", F.lit(float("nan"))).alias("yhat"))
