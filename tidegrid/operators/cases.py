"""Multivariate synthetic cases and mixtures: channels, features, seasons; draws are functions of (seed, index, names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import integer, normal, steps, uniform

from . import generators as g

TWO_PI = 6.283185307179586
#: Periods that a series draws from, factors of a bank, and the mixture of the corpus.
POOL = (6, 8, 12, 24)
BANK, WIDE_BANK = 4, 7
MIXTURE = {"shared_factor": 0.5, "univariate": 0.4, "lag_probe": 0.1}
PRIMITIVES = ("linear", "exponential", "sines", "ar", "intermittent", "random_walk", "geometric_walk", "regime_jump")


def _u(lo: float, hi: float, *key) -> Column:
    return lo + (hi - lo) * uniform("0", *key)


def period(*key) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in POOL]), (F.floor(uniform("0", *key, "period") * len(POOL)) + 1).cast("int"))


def sine(season: Column, noise: float, *key) -> Column:
    """Offset, amplitude and phase by the key; noise in proportion to the amplitude."""
    amp = _u(1.0, 5.0, *key, "amp")
    wave = F.sin(TWO_PI * F.col("t") / season + _u(0.0, TWO_PI, *key, "phase"))
    return _u(-10.0, 10.0, *key, "offset") + amp * (wave + noise * normal("0", *key, F.col("t"), "eps") if noise else wave)


def channels(spark: SparkSession, n_series: int, least: int, most: int) -> DataFrame:
    """idx, channel: least..most channels of each series, by its own draw."""
    rows = spark.range(n_series).select(F.col("id").alias("idx"))
    return rows.select("idx", steps(integer(least, most, "0", F.col("idx"), "channels")).alias("channel"))


def independent_sines(spark: SparkSession, n_series: int, n: int, least: int = 1, most: int = 1, noise: float = 0.1) -> DataFrame:
    """idx, channel, season, t, y: every channel with a period of its own."""
    rows = channels(spark, n_series, least, most).withColumn("season", period(F.col("idx"), F.col("channel")))
    return rows.select("*", steps(n).alias("t")).withColumn("y", sine(F.col("season"), noise, F.col("idx"), F.col("channel")))


def loadings(rows: DataFrame, bank: int, least: int, most: int) -> DataFrame:
    """rows (idx, channel) by the factors each one reads: factor and signed weight; least..most of the bank without repeats."""
    picks = rows.select("idx", "channel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bank - 1).cast("long"))).alias("factor"))
    place = F.row_number().over(Window.partitionBy("idx", "channel").orderBy(uniform("0", F.col("idx"), F.col("channel"), F.col("factor"), "pick"), "factor"))
    sign = F.when(uniform("0", F.col("idx"), F.col("channel"), F.col("factor"), "sign") < 0.5, -1.0).otherwise(1.0)
    return picks.withColumn("place", place).where(F.col("place") <= integer(least, most, "0", F.col("idx"), F.col("channel"), "reads")).select("idx", "channel", "factor", (sign * _u(0.5, 1.5, F.col("idx"), F.col("channel"), F.col("factor"), "weight")).alias("weight"))


def _scaled(x: str, centred: bool) -> Column:
    w = Window.partitionBy("idx", "channel")
    std = F.stddev_pop(x).over(w)
    return (F.col(x) - F.avg(x).over(w) if centred else F.col(x)) / (std + 1e-9)


def shared_sines(spark: SparkSession, n_series: int, n: int, least: int = 2, most: int = 4, noise: float = 0.1) -> DataFrame:
    """idx, channel, season, t, y: channels are weighted sums of a bank of sines; the season is that of the heaviest factor."""
    bank = spark.range(n_series).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BANK - 1).cast("long"))).alias("factor"))
    bank = bank.withColumn("factor_season", period(F.col("idx"), F.col("factor"), "factor"))
    reads = loadings(channels(spark, n_series, least, most), BANK, 1, BANK).join(bank, ["idx", "factor"])
    season = reads.groupBy("idx", "channel").agg(F.max_by("factor_season", F.struct(F.abs("weight"), "factor")).alias("season"))
    values = reads.select("*", steps(n).alias("t")).withColumn("f", sine(F.col("factor_season"), 0.0, F.col("idx"), F.col("factor"), "factor"))
    rows = values.groupBy("idx", "channel", "t").agg(F.sum(F.col("weight") * F.col("f")).alias("mixed")).withColumn("mixed", _scaled("mixed", False))
    made = F.exp(_u(-1.0, 1.0, F.col("idx"), F.col("channel"), "scale")) * (F.col("mixed") + noise * normal("0", F.col("idx"), F.col("channel"), F.col("t"), "eps")) + _u(-10.0, 10.0, F.col("idx"), F.col("channel"), "offset")
    return rows.withColumn("y", made).join(season, ["idx", "channel"]).select("idx", "channel", "season", "t", "y")


def features_target(spark: SparkSession, n_series: int, n: int, noise: float = 0.1) -> DataFrame:
    """idx, season, lag, t, feature, y: the target reads the feature ``lag`` steps ago, at most its season or a quarter of the series."""
    rows = spark.range(n_series).select(F.col("id").alias("idx")).withColumn("season", period(F.col("idx"), "feature"))
    rows = rows.withColumn("lag", integer(1, F.least(F.col("season"), F.lit(n // 4)), "0", F.col("idx"), "lag"))
    rows = rows.select("*", steps(n).alias("t")).withColumn("feature", sine(F.col("season"), noise, F.col("idx"), "feature"))
    past = rows.select("idx", F.col("t").alias("__t"), F.col("feature").alias("__f"))
    rows = rows.withColumn("__t", F.greatest(F.col("t") - F.col("lag"), F.lit(0).cast("long"))).join(past, ["idx", "__t"])
    std = F.stddev_pop("feature").over(Window.partitionBy("idx"))
    return rows.withColumn("y", F.col("__f") + noise * std * normal("0", F.col("idx"), F.col("t"), "eps")).select("idx", "season", "lag", "t", "feature", "y")


def primitives(grid: DataFrame, n: int, kind: Column | None = None) -> DataFrame:
    """idx, t, kind, y: one of eight kinds of univariate series, by a draw of the series unless given."""
    kind = kind if kind is not None else F.element_at(F.array(*[F.lit(k) for k in PRIMITIVES]), (F.floor(uniform("0", F.col("idx"), "kind") * len(PRIMITIVES)) + 1).cast("int"))
    makers = dict(zip(PRIMITIVES, (g.linear, g.exponential, g.sines, g.autoregressive, g.intermittent, g.random_walk, g.geometric_walk, lambda x: g.regime_jump(x, n))))
    keyed, out = grid.withColumn("kind", kind), None
    for name, make in makers.items():
        part = make(keyed.where(F.col("kind") == name).select("idx", "t")).select("idx", "t", F.lit(name).alias("kind"), "y")
        out = part if out is None else out.unionByName(part)
    return out


def shared_factors(spark: SparkSession, n_series: int, n: int, least: int = 2, most: int = 4) -> DataFrame:
    """idx, channel, t, y: channels read three or four of seven standardised primitives, some of them lagged by up to 20 steps,
    with noise of 0.3, a scale in exp(-2..2) and an offset in -100..100."""
    own = primitives(g.grid(spark, n_series * WIDE_BANK, n), n).withColumn("f", g.standardised("y"))
    factors = own.select(F.floor(F.col("idx") / WIDE_BANK).alias("idx"), F.pmod(F.col("idx"), F.lit(WIDE_BANK)).alias("factor"), "t", "f")
    reads = loadings(channels(spark, n_series, least, most), WIDE_BANK, 3, 4)
    late = uniform("0", F.col("idx"), F.col("channel"), F.col("factor"), "late") < 0.3
    reads = reads.withColumn("lag", F.when(late, integer(1, 20, "0", F.col("idx"), F.col("channel"), F.col("factor"), "lag")).otherwise(0).cast("long"))
    values = reads.select("*", steps(n).alias("t")).withColumn("__t", F.greatest(F.col("t") - F.col("lag"), F.lit(0).cast("long")))
    values = values.join(factors.withColumnRenamed("t", "__t"), ["idx", "factor", "__t"])
    rows = values.groupBy("idx", "channel", "t").agg(F.sum(F.col("weight") * F.col("f")).alias("mixed")).withColumn("mixed", _scaled("mixed", True))
    made = F.exp(_u(-2.0, 2.0, F.col("idx"), F.col("channel"), "scale")) * (F.col("mixed") + 0.3 * normal("0", F.col("idx"), F.col("channel"), F.col("t"), "eps")) + _u(-100.0, 100.0, F.col("idx"), F.col("channel"), "offset")
    return rows.withColumn("y", made).select("idx", "channel", "t", "y")


# --- sources made of cases -----------------------------------------------------------------


def corpus(spark: SparkSession, n_series: int, length: tuple[int, int] = (64, 256), most_channels: int = 4, gap_share: float = 0.3) -> DataFrame:
    """idx, kind, channel, role, t, y: the mixture of MIXTURE, each series with its own length and channels;
    half of them with gaps. A lag probe's feature is channel 0; all else are targets."""
    total, upto, kind = sum(MIXTURE.values()), 0.0, F.lit(list(MIXTURE)[-1])
    draw = uniform("0", F.col("idx"), "mixture")
    for name, share in reversed(list(MIXTURE.items())[:-1]):
        upto = sum(s for k, s in MIXTURE.items() if list(MIXTURE).index(k) <= list(MIXTURE).index(name)) / total
        kind = F.when(draw < upto, name).otherwise(kind)
    series = spark.range(n_series).select(F.col("id").alias("idx")).withColumns({"kind": kind, "n": integer(*length, "0", F.col("idx"), "length")})
    one = primitives(g.grid(spark, n_series, length[1]), length[1]).select("idx", F.lit("univariate").alias("kind"), F.lit(0).cast("long").alias("channel"), "t", "y")
    probe = g.lag_probe(g.grid(spark, n_series, length[1])).select("idx", F.lit("lag_probe").alias("kind"), F.posexplode(F.array("feature", "y")).alias("channel", "y"), "t")
    many = shared_factors(spark, n_series, length[1], 2, most_channels).select("idx", F.lit("shared_factor").alias("kind"), "channel", "t", "y")
    rows = one.unionByName(probe.withColumn("channel", F.col("channel").cast("long"))).unionByName(many).join(series, ["idx", "kind"]).where("t < n")
    gap = (uniform("0", F.col("idx"), "gaps") < 0.5) & (uniform("0", F.col("idx"), F.col("channel"), F.col("t"), "gap") < gap_share * uniform("0", F.col("idx"), "share"))
    role = F.when((F.col("kind") == "lag_probe") & (F.col("channel") == 0), "feature").otherwise("target")
    return rows.select("idx", "kind", "channel", role.alias("role"), "t", F.when(gap, None).otherwise(F.col("y")).alias("y"))


def held_out(rows: DataFrame, n: int, horizon: int, case: str) -> DataFrame:
    """Adds part (context, label), h and the config id of a case's rows: case, its channels' seasons, series."""
    seasons = rows.groupBy("idx").agg(F.sort_array(F.collect_set(F.struct("channel", "season"))).alias("s"))
    tag = F.when(F.size(F.array_distinct("s.season")) == 1, F.element_at("s.season", 1).cast("string")).otherwise(F.array_join(F.transform("s.season", lambda x: x.cast("string")), "x"))
    named = seasons.select("idx", F.concat(F.lit(f"sanity/{case}/m"), tag, F.lit("/series_"), F.col("idx").cast("string")).alias("config_id"))
    at = F.col("t") - (n - horizon)
    return rows.join(named, "idx").withColumns({"part": F.when(at < 0, "context").otherwise("label"), "h": F.when(at >= 0, at)})


def training_stream(rows: DataFrame, n: int, horizon: int, epochs: int, world: int, rank: int) -> DataFrame:
    """Context rows of this rank's series, once an epoch."""
    own = rows.where((F.col("t") < n - horizon) & (F.pmod(F.col("idx"), F.lit(world)) == rank))
    return own.select(steps(epochs).alias("epoch"), *rows.columns)
