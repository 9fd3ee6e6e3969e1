"""Synthetic series as projections: every draw is a function of (seed, index, name), so tables don't depend on layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions.scalar import normal, steps, uniform


def _over() -> WindowSpec:
    return Window.partitionBy("idx").orderBy("t")


def _so_far() -> WindowSpec:
    return _over().rowsBetween(Window.unboundedPreceding, 0)


def grid(spark: SparkSession, n_series: int, n: int) -> DataFrame:
    """idx, t."""
    return spark.range(n_series).select(F.col("id").alias("idx"), steps(n).alias("t"))


def between(lo: float, hi: float, name: str) -> Column:
    """A parameter of a series, uniform in [lo, hi)."""
    return lo + (hi - lo) * uniform("0", F.col("idx"), name)


def noise(name: str = "eps") -> Column:
    """A standard normal of a step."""
    return normal("0", F.col("idx"), F.col("t"), name)


def step_uniform(name: str) -> Column:
    return uniform("0", F.col("idx"), F.col("t"), name)


def linear(g: DataFrame) -> DataFrame:
    return g.withColumn("y", between(-1, 1, "slope") * F.col("t") + between(-100, 100, "offset") + noise())


def exponential(g: DataFrame) -> DataFrame:
    return g.withColumn("y", F.exp(between(-0.01, 0.01, "rate") * F.col("t")) * between(1, 10, "scale"))


def sines(g: DataFrame) -> DataFrame:
    """One to three sines."""
    k = 1 + F.floor(uniform("0", F.col("idx"), "k") * 3)
    parts = [F.when(k > j, between(0.5, 2, f"a{j}") * F.sin(6.283185307179586 * F.col("t") / between(6, 48, f"p{j}") + between(0, 6.283185307179586, f"f{j}"))).otherwise(0.0) for j in range(3)]
    return g.withColumn("y", parts[0] + parts[1] + parts[2])


def autoregressive(g: DataFrame) -> DataFrame:
    """AR(2) with coefficients that keep their absolute sum at 0.95 or below; one pass over each series."""
    a, b = between(-1, 1, "c1"), between(-1, 1, "c2")
    scale = F.least(F.lit(1.0), 0.95 / F.greatest(F.abs(a) + F.abs(b), F.lit(1e-9)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        near = far = 0.0
        y = []
        for e, p, q in zip(rows["e"].tolist(), rows["a"].tolist(), rows["b"].tolist()):
            near, far = p * near + q * far + e, near
            y.append(near)
        return pd.DataFrame({"idx": rows["idx"], "t": rows["t"], "y": y})

    return g.withColumns({"e": noise(), "a": a * scale, "b": b * scale}).groupBy("idx").applyInPandas(run, "idx long, t long, y double")


def intermittent(g: DataFrame, rate: float = 0.1) -> DataFrame:
    return g.withColumn("y", F.when(step_uniform("hit") < rate, 1 + 9 * step_uniform("size")).otherwise(0.0))


def random_walk(g: DataFrame) -> DataFrame:
    return g.withColumn("e", noise()).withColumn("y", F.sum("e").over(_so_far())).drop("e")


def geometric_walk(g: DataFrame) -> DataFrame:
    return g.withColumn("e", 0.0005 + 0.02 * noise()).withColumn("y", 100 * F.exp(F.sum("e").over(_so_far()))).drop("e")


def regime_jump(g: DataFrame, n: int) -> DataFrame:
    """A walk with one step between 30 and 70 % of its length."""
    cut = F.floor(n * between(0.3, 0.7, "cut"))
    return random_walk(g).withColumn("y", F.col("y") + F.when(F.col("t") >= cut, between(-50, 50, "jump")).otherwise(0.0))


def shift(x: str, lag: int) -> Column:
    """The value ``lag`` steps before; at the beginning the first one."""
    return F.coalesce(F.lag(x, lag).over(_over()), F.first(x).over(_so_far()))


def lag_probe(g: DataFrame, lag: int = 5) -> DataFrame:
    """feature: white noise; y: the feature ``lag`` steps ago and a little noise."""
    rows = g.withColumn("feature", noise("feature"))
    return rows.withColumn("y", shift("feature", lag) + 0.1 * noise())


def sanity_sine(g: DataFrame, season: int = 24) -> DataFrame:
    amplitude = between(1, 5, "amp")
    return g.withColumn("y", between(-10, 10, "level") + amplitude * (F.sin(6.283185307179586 * F.col("t") / season + between(0, 6.283185307179586, "phase")) + 0.1 * noise()))


def standardised(x: str) -> Column:
    w = Window.partitionBy("idx")
    std = F.stddev_pop(x).over(w)
    return F.when(std > 1e-12, (F.col(x) - F.avg(x).over(w)) / std).otherwise(F.col(x) - F.avg(x).over(w))


def shared_factor(g: DataFrame, channels: int = 3, factors: int = 4) -> DataFrame:
    """idx, t, channel, y: weighted sums of common sines; factors meet channels by their number."""
    rows = g.withColumn("factor", F.explode(F.sequence(F.lit(0), F.lit(factors - 1))))
    rows = rows.withColumn("f", F.sin(6.283185307179586 * F.col("t") / (6 + 6 * F.col("factor")) + 6.283185307179586 * uniform("0", F.col("idx"), F.col("factor"), "phase")))
    rows = rows.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    weight = 2 * uniform("0", F.col("idx"), F.col("channel"), F.col("factor"), "w") - 1
    return rows.groupBy("idx", "t", "channel").agg(F.sum(weight * F.col("f")).alias("y"))


def kff_driver(g: DataFrame, season: int = 24) -> DataFrame:
    """feature: a standardised walk known ahead; y: 0.3 of a sine and 0.7 of the feature."""
    rows = random_walk(g).withColumnRenamed("y", "walk")
    rows = rows.withColumn("feature", standardised("walk"))
    return rows.withColumn("y", 0.3 * F.sin(6.283185307179586 * F.col("t") / season) + 0.7 * F.col("feature")).drop("walk")


def with_gaps(rows: DataFrame, n: int, cap: float = 0.3, run_probability: float = 0.2) -> DataFrame:
    """y null at scattered steps, and in some series over one run."""
    share = cap * uniform("0", F.col("idx"), "share")
    start, length = F.floor(n * uniform("0", F.col("idx"), "start")), 1 + F.floor(n / 8 * uniform("0", F.col("idx"), "length"))
    run = (uniform("0", F.col("idx"), "run") < run_probability) & (F.col("t") >= start) & (F.col("t") < start + length)
    return rows.withColumn("y", F.when((step_uniform("gap") < share) | run, None).otherwise(F.col("y")))


def case_of(index: Column, cases: list[str]) -> Column:
    """Round robin over named cases."""
    return F.element_at(F.array(*[F.lit(c) for c in cases]), (F.pmod(index, F.lit(len(cases))) + 1).cast("int"))
