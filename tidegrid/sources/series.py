"""Raw tables to dense series: (series_id, channel_idx, t, y), y null where nothing was observed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalar import steps
from tidegrid.operators.packing import numbered

#: Channels whose numbers are broadcast at most; a shuffled join serves beyond it.
BROADCAST_CHANNELS = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regularise(rows: DataFrame, keys: list[str], t: Column, value: Column, n: int, fill: float | None = None) -> DataFrame:
    """keys, t = 0..n-1 and y: ``value`` (an aggregate) of the rows at each step, ``fill`` where there are none.

    The grid comes from exploding a sequence for each key, so it needs no cross join;
    rows outside the grid don't count.
    """
    cells = rows.withColumn("t", t.cast("long")).where((F.col("t") >= 0) & (F.col("t") < n)).groupBy(*keys, "t").agg(value.cast("double").alias("y"))
    grid = rows.select(*keys).distinct().select("*", steps(n).alias("t"))
    out = grid.join(cells, [*keys, "t"], "left")
    return out if fill is None else out.withColumn("y", F.coalesce("y", F.lit(float(fill))))


def _channels(df: DataFrame, key: str) -> DataFrame:
    """Channel numbers by the key's order."""
    names = numbered(df.select(key).distinct(), [key], "channel_idx").withColumn("channel_idx", F.col("channel_idx").cast("int"))
    return df.join(F.broadcast(names) if names.count() <= BROADCAST_CHANNELS else names, key)


def _hours(ts: str) -> Column:
    return F.expr(f"timestampdiff(HOUR, timestamp_ntz'2024-01-01', {ts})")


def _days(ts: str, start: str) -> Column:
    return F.expr(f"datediff(cast({ts} as date), date'{start}')")


def ev_hourly(spark, d) -> DataFrame:
    out = regularise(read(spark, d, "events"), ["event_type"], _hours("ts"), F.avg("value"), 720)
    return _channels(out, "event_type").select(F.lit("ev_hourly").alias("series_id"), "channel_idx", "t", "y", F.col("event_type").alias("channel"))


def ev_user_daily(spark, d) -> DataFrame:
    out = regularise(read(spark, d, "events"), ["user_id"], _days("ts", "2024-01-01"), F.count("*"), 30, 0.0)
    return out.select(F.col("user_id").cast("string").alias("series_id"), F.lit(0).alias("channel_idx"), "t", "y")


def ev_user_hourly(spark, d, counts: bool = False) -> DataFrame:
    out = regularise(read(spark, d, "events"), ["user_id"], _hours("ts"), F.count("*") if counts else F.avg("value"), 720, 0.0 if counts else None)
    return out.select(F.col("user_id").cast("string").alias("series_id"), F.lit(0).alias("channel_idx"), "t", "y")


def li_daily(spark, d) -> DataFrame:
    out = regularise(read(spark, d, "lineitem"), ["l_returnflag"], _days("l_shipdate", "1995-01-02"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 2499)
    return _channels(out, "l_returnflag").select(F.lit("li_daily").alias("series_id"), "channel_idx", "t", "y")


def ord_daily(spark, d) -> DataFrame:
    out = regularise(read(spark, d, "orders"), ["o_orderpriority"], _days("o_orderdate", "1995-01-01"), F.avg("o_totalprice"), 2405)
    return _channels(out, "o_orderpriority").select(F.lit("ord_daily").alias("series_id"), "channel_idx", "t", "y")


def ord_segment(spark, d) -> DataFrame:
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    weeks = F.floor(_days("o_orderdate", "1995-01-01") / 7)
    out = regularise(rows, ["c_mktsegment"], weeks, F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 343, 0.0)
    return out.select(F.col("c_mktsegment").alias("series_id"), F.lit(0).alias("channel_idx"), "t", "y")


def emb_series(spark, d) -> DataFrame:
    rows = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("series_id"), F.col("label").cast("string").alias("config_id"), F.posexplode("embedding"))
    return rows.select("series_id", F.lit(0).alias("channel_idx"), F.col("pos").cast("long").alias("t"), F.col("col").cast("double").alias("y"), "config_id")


def doc_lengths(spark, d, l_pack: int = 256) -> DataFrame:
    """Items of a packing workload: size = ceil(n_chars / 64), l_pack at most."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("item"), F.least(F.lit(l_pack), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 64))).cast("long").alias("size"))


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ev_hourly": ev_hourly, "ev_user_daily": ev_user_daily, "ev_user_hourly": ev_user_hourly, "li_daily": li_daily,
    "ord_daily": ord_daily, "ord_segment": ord_segment, "emb_series": emb_series,
}


def build_loader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A view by name."""
    if name not in VIEWS:
        raise NotImplementedError(f"no such source: {name}")
    return VIEWS[name]


@dataclass(frozen=True)
class EvalSplit:
    """What is held out: steps origin..origin+p, and the season to score by."""

    origin: int
    p: int
    season: int


def context(points: DataFrame, split: EvalSplit) -> DataFrame:
    return points.where(F.col("t") < split.origin)


def labels(points: DataFrame, split: EvalSplit) -> DataFrame:
    """Held-out rows with h = 0..p-1."""
    return points.where((F.col("t") >= split.origin) & (F.col("t") < split.origin + split.p)).withColumn("h", F.col("t") - split.origin)


def merge_context_horizon(ctx: DataFrame, horizon: DataFrame) -> DataFrame:
    """Context and horizon rows as one series again; columns that one side lacks are null."""
    return ctx.unionByName(horizon, allowMissingColumns=True)


def drop_short(points: DataFrame, least: int) -> DataFrame:
    """Series of at least that many steps."""
    long = points.groupBy("series_id").agg(F.countDistinct("t").alias("n")).where(F.col("n") >= least)
    return points.join(long, "series_id", "left_semi")


def shard(items: DataFrame, index: str, world: int, rank: int) -> DataFrame:
    """Round robin over a running index."""
    return items.where(F.pmod(F.col(index), F.lit(world)) == rank)


def rolling_windows(meta: DataFrame, windows: int, terms: dict[str, int]) -> DataFrame:
    """meta: config_id, n, p. Origins of each window and term; those with an origin below 2 are skipped."""
    term = F.explode(F.array(*[F.struct(F.lit(k).alias("term"), F.lit(v).alias("times")) for k, v in terms.items()]))
    rows = meta.select("*", term.alias("x")).select("config_id", "n", F.col("x.term").alias("term"), (F.col("p") * F.col("x.times")).alias("p"))
    rows = rows.withColumn("w", steps(windows))
    return rows.withColumn("origin", F.col("n") - (windows - F.col("w")) * F.col("p")).where("origin >= 2").select("config_id", "term", "w", "p", "origin")


def window_rows(points: DataFrame, windows: DataFrame, first: int | None = None) -> DataFrame:
    """config_id, term, w, channel_idx, part (context, label), t, h, y: the rows of each test window.

    points: config_id, channel_idx, t, y. windows: config_id, term, w, p, origin. ``first``: only so many windows of a
    configuration and term, the earliest.
    """
    if first is not None:
        windows = windows.where(F.col("w") < first)
    rows = points.join(windows, "config_id").where(F.col("t") < F.col("origin") + F.col("p"))
    ahead = F.col("t") - F.col("origin")
    return rows.select("config_id", "term", "w", "channel_idx", F.when(ahead < 0, "context").otherwise("label").alias("part"), "t", F.when(ahead >= 0, ahead).alias("h"), "y")


def violations(points: DataFrame) -> DataFrame:
    """Rows that break the contract: a null key, a negative step, a repeated cell."""
    bad = points.where("series_id is null or channel_idx is null or t is null or channel_idx < 0 or t < 0").select("series_id", "channel_idx", "t", F.lit("key").alias("problem"))
    twice = points.groupBy("series_id", "channel_idx", "t").count().where("count > 1").select("series_id", "channel_idx", "t", F.lit("repeated").alias("problem"))
    return bad.unionByName(twice)
