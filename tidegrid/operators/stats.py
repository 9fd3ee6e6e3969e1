"""Robust statistics of a channel: lower median, interquartile range, scale with its fallbacks, anchor, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import IQR_TO_SIGMA, MAD_TO_SIGMA, PATCH, RELATIVE_FLOOR

from .forecast import KEYS


def lower_median(x: str) -> Column:
    return F.expr(f"percentile_disc(0.5) within group (order by {x})")


def iqr(x: str) -> Column:
    """Linear interpolation; 0 with fewer than two values."""
    return F.when(F.count(x) < 2, 0.0).otherwise(F.expr(f"percentile({x}, 0.75) - percentile({x}, 0.25)"))


def differences(points: DataFrame, keys: list[str] = KEYS, order: str = "t", y: str = "y") -> DataFrame:
    """Adds diff: null when either side is missing; gaps aren't bridged."""
    return points.withColumn("diff", F.col(y) - F.lag(y).over(Window.partitionBy(*keys).orderBy(order)))


def robust_sigma(points: DataFrame, keys: list[str] = KEYS, order: str = "t", y: str = "y") -> DataFrame:
    """keys, sigma and fallback: median of absolute differences, else their mean, else the levels'
    interquartile range, else 1; then a floor by the levels' range that only raises it."""
    rows = differences(points, keys, order, y).withColumn("adx", F.abs("diff"))
    found = rows.groupBy(*keys).agg((MAD_TO_SIGMA * lower_median("adx")).alias("mad"), F.avg("adx").alias("mean_abs"), iqr(y).alias("iqr"))
    spread = F.col("iqr") * IQR_TO_SIGMA
    sigma = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("mean_abs") > 0, F.col("mean_abs")).when(spread > 0, spread).otherwise(1.0)
    label = F.when(F.col("mad") > 0, "mad").when(F.col("mean_abs") > 0, "mean_abs").when(spread > 0, "iqr").otherwise("unit")
    return found.select(*keys, F.when(F.col("iqr") > 0, F.greatest(sigma, RELATIVE_FLOOR * spread)).otherwise(sigma).alias("sigma"), label.alias("fallback"))


def anchors(context: DataFrame, window: int = 32, keys: list[str] = KEYS) -> DataFrame:
    """keys, a: lower median of what is observed in the last ``window`` steps, else of all, else 0."""
    rows = context.withColumn("back", F.max("t").over(Window.partitionBy(*keys)) - F.col("t"))
    tail = F.expr(f"percentile_disc(0.5) within group (order by case when back < {window} then y end)")
    return rows.groupBy(*keys).agg(F.coalesce(tail, lower_median("y"), F.lit(0.0)).alias("a"))


def tier_aggregate(context: DataFrame, patches: tuple[int, ...] = PATCH[1:], keys: list[str] = KEYS) -> DataFrame:
    """keys, tier, patch, back (0: newest), y: means of whole patches counted from the newest step; the oldest partial one goes."""
    rows = context.withColumns({"n": F.count("*").over(Window.partitionBy(*keys)), "at": F.max("t").over(Window.partitionBy(*keys)) - F.col("t")})
    tiers = F.explode(F.array(*[F.struct(F.lit(PATCH.index(p)).alias("tier"), F.lit(p).alias("patch")) for p in patches]))
    rows = rows.select("*", tiers.alias("x")).select("*", "x.tier", "x.patch").withColumn("back", F.floor(F.col("at") / F.col("patch")))
    rows = rows.where((F.col("back") + 1) * F.col("patch") <= F.col("n"))
    return rows.groupBy(*keys, "tier", "patch", "back").agg(F.avg("y").alias("y"))


def channel_stats(context: DataFrame, window: int = 32) -> DataFrame:
    """series, channel, a, sigma, fallback and sigma_delta: scale of the steps, then of each tier's patch means."""
    base = robust_sigma(context)
    patches = tier_aggregate(context).withColumn("ahead", -F.col("back"))
    count = patches.groupBy(*KEYS, "tier").agg(F.count("*").alias("k"))
    tiers = robust_sigma(patches, [*KEYS, "tier"], "ahead").join(count, [*KEYS, "tier"]).where("k >= 2")
    wide = tiers.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("tier", "sigma"))).alias("by_tier"))
    out = base.join(anchors(context, window), KEYS).join(wide, KEYS, "left")
    tier = [F.coalesce(F.col("by_tier")[k], F.col("sigma")) for k in range(1, len(PATCH))]
    return out.select(*KEYS, "a", "sigma", "fallback", F.array(F.col("sigma"), *tier).alias("sigma_delta"))


def standardise(points: DataFrame) -> DataFrame:
    """Adds z: centred, and divided by the population deviation where that isn't 0."""
    w = Window.partitionBy(*KEYS)
    centred = F.col("y") - F.avg("y").over(w)
    std = F.stddev_pop("y").over(w)
    return points.withColumn("z", F.when(std > 1e-12, centred / std).otherwise(centred))
