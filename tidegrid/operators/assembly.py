"""Segments put together: what a token reads of its store, targets, packed buffers with padding, steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import PATCH, forward, steps

from . import tokens as tk
from .forecast import KEYS
from .stats import anchors, robust_sigma

SEGMENT = ["segment_id", "channel_idx"]


def context_stats(segments: DataFrame, points: DataFrame) -> DataFrame:
    """segment_id, channel_idx, a, sigma: of each segment's own context, [origin - coverage, origin) clipped to the series."""
    own = segments.select("segment_id", "series_id", "origin", "coverage")
    # segments are few beside points, but nothing bounds them: a plain join
    rows = points.select(*KEYS, "t", "y").join(own, "series_id").where((F.col("t") < F.col("origin")) & (F.col("t") >= F.col("origin") - F.col("coverage")))
    rows = rows.select(F.col("segment_id").cast("string").alias("series_id"), "segment_id", "channel_idx", "t", "y")
    ids = rows.select("series_id", "segment_id").distinct()
    found = robust_sigma(rows).join(anchors(rows), KEYS).join(ids, "series_id")
    return found.select(*SEGMENT, "a", "sigma")


def store(segments: DataFrame, points: DataFrame, stats: DataFrame) -> DataFrame:
    """segment_id, channel_idx, offset, z, observed over the coverage; missing steps are (0, false)."""
    grid = segments.select("segment_id", "series_id", "origin", "coverage", steps(F.col("coverage")).alias("offset")).join(stats, "segment_id")
    grid = grid.withColumn("t", F.col("origin") - F.col("coverage") + F.col("offset"))
    rows = grid.join(points.select(*KEYS, "t", "y"), [*KEYS, "t"], "left")
    return rows.select(*SEGMENT, "offset", F.coalesce(F.when(F.col("y").isNotNull(), forward("y", "a", "sigma")), F.lit(0.0)).alias("z"), F.col("y").isNotNull().alias("observed"))


def patches(tokens: DataFrame, segments: DataFrame, stored: DataFrame) -> DataFrame:
    """Context tokens with z and observed, arrays over their patch, gathered from the store by offset."""
    width = F.element_at(F.array(*[F.lit(p) for p in PATCH]), F.col("tier") + 1)
    rows = tokens.join(segments.select("segment_id", "origin", "coverage"), "segment_id").where(F.col("raw_start") < F.col("origin"))
    rows = rows.select(*SEGMENT, "pos", (F.col("raw_start") - F.col("origin") + F.col("coverage")).alias("first"), steps(width).alias("i"))
    rows = rows.withColumn("offset", F.col("first") + F.col("i")).join(stored, [*SEGMENT, "offset"], "left")
    cell = F.struct("i", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("observed", F.lit(False)).alias("observed"))
    made = rows.groupBy(*SEGMENT, "pos").agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # a patch: 512 cells at most
    return made.select(*SEGMENT, "pos", F.col("cells.z").alias("z"), F.col("cells.observed").alias("observed"))


def targets(segments: DataFrame, points: DataFrame, stats: DataFrame, p_out: int) -> DataFrame:
    """segment_id, channel_idx, j, i, target, valid: the p steps after the origin by patch, normalised; null labels aren't valid."""
    ahead = segments.select("segment_id", "series_id", "origin", steps(F.col("p")).alias("h")).join(stats, "segment_id")
    rows = ahead.withColumn("t", F.col("origin") + F.col("h")).join(points.select(*KEYS, "t", "y"), [*KEYS, "t"], "left")
    z = F.when(F.col("y").isNotNull(), forward("y", "a", "sigma"))
    return rows.select(*SEGMENT, F.floor(F.col("h") / p_out).alias("j"), F.pmod("h", F.lit(p_out)).alias("i"), F.coalesce(z, F.lit(0.0)).alias("target"), F.col("y").isNotNull().alias("valid"))


def scatter_add(slots: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """slots with the sum of the values that go to each; 0 where none does."""
    return slots.join(values.groupBy(*keys).agg(F.sum(value).alias(value)), keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def concatenated(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys and values: the arrays of a key on end, by order."""
    made = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("parts"))
    return made.select(*keys, F.flatten(F.col("parts").getField(value)).alias("values"))


def packed(segments: DataFrame, l_pack: int) -> DataFrame:
    """segments: buffer_id, seq, item, size, c, store. A row for each of l_pack slots of every buffer.

    buffer_id, slot, item, sample (-1: padding), variate (numbered through the buffer), store_begin (of its
    segment in the buffer's store), content_state, sigma. Tokens go to a segment's channels in turn.
    Segments that don't fit their buffer are an error.
    """
    placed = tk.pack_offsets(segments)
    whole = F.sum("size").over(Window.partitionBy("buffer_id"))
    fits = F.when(whole <= l_pack, F.col("size")).otherwise(F.raise_error(F.concat(F.lit("segments overflow buffer "), F.col("buffer_id").cast("string"))))
    rows = placed.withColumn("size", fits).select("*", steps(F.col("size")).alias("i"))
    rows = rows.select(
        "buffer_id", (F.col("token_base") + F.col("i")).alias("slot"), "item", F.col("sample").cast("long").alias("sample"),
        (F.col("channel_base") + F.floor(F.col("i") * F.col("c") / F.col("size"))).alias("variate"), F.col("store_base").alias("store_begin"), F.lit(tk.OBSERVED).alias("content_state"), F.lit(1.0).alias("sigma"),
    )
    used = segments.groupBy("buffer_id").agg(F.sum("size").alias("used")).where(F.col("used") < l_pack)
    none = F.lit(None).cast("long")
    pads = used.select("buffer_id", F.explode(F.sequence(F.col("used"), F.lit(l_pack - 1).cast("long"))).alias("slot"))
    pads = pads.select("buffer_id", "slot", none.alias("item"), F.lit(-1).cast("long").alias("sample"), none.alias("variate"), none.alias("store_begin"), F.lit(tk.NA).alias("content_state"), F.lit(1.0).alias("sigma"))
    return rows.unionByName(pads)


def eval_batches(items: DataFrame, l_pack: int) -> DataFrame:
    """items: item, size, c, store. One segment to a buffer, padded: the batch that scoring takes."""
    return packed(items.withColumns({"buffer_id": F.col("item"), "seq": F.lit(0)}), l_pack)


def fill(segments: DataFrame, l_pack: int) -> DataFrame:
    """buffer_id, fill, waste, store: used share and tail of a buffer, and its store's width."""
    rows = segments.groupBy("buffer_id").agg(F.sum("size").alias("used"), F.sum("store").alias("store"))
    return rows.select("buffer_id", (F.col("used") / l_pack).alias("fill"), (l_pack - F.col("used")).alias("waste"), "store")
