"""Token tables of segments, offsets in buffers, and the attention relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import PATCH, forward, steps

from . import telescope as ts
from .forecast import KEYS

# Codes of the enumerations.
OBSERVED, MASK, NA = 0, 1, 2
CTX, QRY = 0, 1
FEATURE, TARGET, KFF = 0, 1, 2


def observed_before(points: DataFrame) -> DataFrame:
    """series, channel, t, seen: observed steps up to and with t; two lookups count any range."""
    w = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*KEYS, "t", F.count("y").over(w).alias("seen"))


def _count_between(rows: DataFrame, seen: DataFrame, lo: Column, hi: Column, out: str) -> DataFrame:
    """Adds the number of observed steps in [lo, hi) of the row's series and channel: equi-joins, no range join."""
    low = seen.select(*KEYS, F.col("t").alias("__lo"), F.col("seen").alias("__low"))
    high = seen.select(*KEYS, F.col("t").alias("__hi"), F.col("seen").alias("__high"))
    last = seen.groupBy(*KEYS).agg(F.max("t").alias("__last"))
    rows = rows.join(last, KEYS).withColumns({"__lo": lo - 1, "__hi": F.least(hi - 1, F.col("__last"))})
    rows = rows.join(low, [*KEYS, "__lo"], "left").join(high, [*KEYS, "__hi"], "left")
    return rows.withColumn(out, F.greatest(F.coalesce("__high", F.lit(0)) - F.coalesce("__low", F.lit(0)), F.lit(0))).drop("__lo", "__hi", "__low", "__high", "__last")


def token_table(segments: DataFrame, channels: DataFrame, points: DataFrame, p_out: int) -> DataFrame:
    """One row a token. segments: segment_id, series_id, origin, p, n_eff, q_tok, counts.
    channels: series_id, channel_idx, role (FEATURE, TARGET, KFF)."""
    segs = segments.join(channels, "series_id")
    width = F.col("n_eff") + F.when(F.col("role") == FEATURE, 0).otherwise(F.col("q_tok"))
    w = Window.partitionBy("segment_id").orderBy("channel_idx").rowsBetween(Window.unboundedPreceding, 0)
    segs = segs.withColumn("base", F.sum(width).over(w) - width)
    keys = ["segment_id", "series_id", "channel_idx", "role", "base", "n_eff", "q_tok", "p"]
    seen = observed_before(points)
    ctx = ts.dispatch(segs, keys).join(segments.select("segment_id", "origin"), "segment_id")
    ctx = _count_between(ctx, seen, F.greatest(F.col("raw_start"), F.lit(0)), F.greatest(F.col("raw_end"), F.lit(0)), "n_obs")
    ctx = _count_between(ctx, seen, F.greatest(F.col("raw_end"), F.lit(0)), F.col("raw_end") + F.col("patch"), "n_next")
    fits = (F.col("raw_end") + F.col("patch") <= F.col("origin")) & (F.col("raw_end") >= 0)
    ctx = ctx.select(
        "segment_id", "channel_idx", "tier", (F.col("base") + F.col("pos")).alias("pos"), F.lit(CTX).alias("role"),
        F.when(F.col("n_obs") > 0, OBSERVED).otherwise(NA).alias("content_state"),
        F.when(F.col("role") == TARGET, TARGET).otherwise(FEATURE).alias("role_ft"),
        ((F.col("raw_start") + F.col("raw_end")) * 0.5 - F.col("origin")).alias("t_center"),
        (fits & (F.col("n_next") > 0)).alias("valid_aux"), F.col("raw_start"),
    )
    hor = segs.where(F.col("role") != FEATURE).select(*keys, "origin", steps(F.col("q_tok")).alias("j"))
    hor = _count_between(hor, seen, F.col("origin") + F.col("j") * p_out, F.col("origin") + (F.col("j") + 1) * p_out, "n_obs")
    target = F.col("role") == TARGET
    hor = hor.select(
        "segment_id", "channel_idx", F.lit(PATCH.index(p_out)).alias("tier"), (F.col("base") + F.col("n_eff") + F.col("j")).alias("pos"),
        F.when(target, QRY).otherwise(CTX).alias("role"),
        F.when(target, MASK).when(F.col("n_obs") > 0, OBSERVED).otherwise(NA).alias("content_state"),
        F.when(target, TARGET).otherwise(FEATURE).alias("role_ft"),
        (F.col("j") * p_out + p_out * 0.5).alias("t_center"), F.lit(False).alias("valid_aux"), (F.col("origin") + F.col("j") * p_out).alias("raw_start"),
    )
    return ctx.unionByName(hor)


def norm_store(segments: DataFrame, points: DataFrame, stats: DataFrame) -> DataFrame:
    """segment, channel, offset, z, observed over [origin - coverage, origin); missing or out of range: (0, false)."""
    grid = segments.select("segment_id", "series_id", "origin", "coverage", steps(F.col("coverage")).alias("offset"))
    grid = grid.withColumn("t", F.col("origin") - F.col("coverage") + F.col("offset")).join(stats, "series_id")
    rows = grid.join(points.select(*KEYS, "t", "y"), [*KEYS, "t"], "left")
    return rows.select("segment_id", "channel_idx", "offset", F.coalesce(F.when(F.col("y").isNotNull(), forward("y", "a", "sigma")), F.lit(0.0)).alias("z"), F.col("y").isNotNull().alias("observed"))


def pack_offsets(segments: DataFrame) -> DataFrame:
    """segments: buffer_id, seq, size, c, store. Adds where each segment's tokens, store and channels begin in its buffer."""
    w = Window.partitionBy("buffer_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.sum(c).over(w) - F.col(c)
    return segments.withColumns({"token_base": before("size"), "store_base": before("store"), "channel_base": before("c"), "sample": F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})


def pad_fill(packed: DataFrame, l_pack: int) -> DataFrame:
    """buffer_id, used, pads of each buffer; more used than the buffer holds is an error to the caller."""
    return packed.groupBy("buffer_id").agg(F.sum("size").alias("used")).withColumn("pads", l_pack - F.col("used"))


def attention_pairs(tokens: DataFrame) -> DataFrame:
    """(buffer, q, k) that may attend: one sample; context keys not later than a context query, any for a query token,
    and query tokens among themselves. Padding (sample -1) attends to itself alone."""
    q = tokens.select("buffer_id", "sample", F.col("slot").alias("q"), F.col("role").alias("rq"), F.col("t_center").alias("tq"))
    k = tokens.select("buffer_id", "sample", F.col("slot").alias("k"), F.col("role").alias("rk"), F.col("t_center").alias("tk"))
    ok = ((F.col("rk") == CTX) & ((F.col("rq") == QRY) | (F.col("tk") <= F.col("tq")))) | ((F.col("rq") == QRY) & (F.col("rk") == QRY))
    full = q.where("sample >= 0").join(k.where("sample >= 0"), ["buffer_id", "sample"]).where(ok).select("buffer_id", "q", "k")
    return full.unionByName(q.where("sample < 0").select("buffer_id", "q", F.col("q").alias("k")))


def route_rank(tokens: DataFrame, cap: int) -> DataFrame:
    """Observed tokens of each tier and buffer by slot, the first ``cap`` of them."""
    w = Window.partitionBy("buffer_id", "tier").orderBy("slot")
    return tokens.where(F.col("content_state") == OBSERVED).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < cap)
