"""Buffers: cost, schedule, trivial batches, and best-fit-decreasing packing through a bounded reservoir."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are numbered in, and items of a packing shard.
PARTS, SHARD = 64, 100_000


def buffer_costs(packed: DataFrame) -> DataFrame:
    """buffer_id, cost: half the sum of squared sizes."""
    return packed.groupBy("buffer_id").agg((F.sum(F.col("size") * F.col("size")) / 2).alias("cost"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the running number of each row by ``order`` (which tells rows apart), from 0, without one task that sees all rows.

    Rows fall into PARTS ranges by bounds from a sample, which the driver holds; a row's number is its place in
    its range after the rows of all earlier ranges. Numbers are exact whatever the bounds.
    """
    keys = [F.col(c) for c in order]
    by = F.xxhash64(*order)
    share = min(1.0, 20.0 * PARTS / max(1, rows.count()))
    sample = rows.select(*keys).where(F.col(order[0]).isNotNull() & (F.pmod(by, F.lit(1 << 30)) < int(share * (1 << 30)))).orderBy(*keys).limit(100 * PARTS).collect()
    bounds = sorted({tuple(sample[len(sample) * k // PARTS]) for k in range(1, PARTS)}) if sample else []
    part = F.lit(0)
    if bounds:
        fields = rows.select(*order).schema.simpleString()
        held = rows.sparkSession.createDataFrame(bounds, fields).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("__bounds"))
        rows = rows.join(F.broadcast(held))  # one row
        part = F.size(F.filter("__bounds", lambda b: b <= F.struct(*keys)))
    rows = rows.withColumn("__part", part)
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))  # PARTS rows at most
    before = counts.withColumn("__before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return rows.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__place", "__before", "__bounds")


def schedule(costs: DataFrame, per_step: int, window: str | None = None) -> DataFrame:
    """Adds place and step: buffers by cost (then id), ``per_step`` to a step, within each window."""
    if window:
        w = Window.partitionBy(window).orderBy("cost", "buffer_id")
        placed = costs.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    else:
        placed = numbered(costs, ["cost", "buffer_id"], "place")
    return placed.withColumn("step", F.floor(F.col("place") / per_step))


def trivial_batches(items: DataFrame, order: str, per_batch: int) -> DataFrame:
    """One item a buffer, ``per_batch`` buffers to a batch, in order."""
    return numbered(items, [order], "buffer_id").withColumn("batch", F.floor(F.col("buffer_id") / per_batch))


class Reservoir:
    """Holds up to ``k`` items; each buffer takes the largest that still fits, the earliest of equals."""

    def __init__(self, l_pack: int, k: int, tolerance: float = 0.05):
        self.l_pack, self.k, self.tolerance = l_pack, k, tolerance
        self.items: list[tuple[int, int]] = []  # (item, size) in order of arrival

    def full(self) -> bool:
        return len(self.items) >= self.k

    def form(self) -> list[tuple[int, int]]:
        buffer, room = [], self.l_pack
        while self.items:
            fits = [(size, -i) for i, (_, size) in enumerate(self.items) if size <= room]
            if not fits:
                break
            size, at = max(fits)
            buffer.append(self.items.pop(-at))
            room -= size
            if room < self.tolerance * self.l_pack:
                break
        return buffer


def buffers(items: Iterator[tuple[int, int]], l_pack: int, k: int, tolerance: float = 0.05) -> Iterator[list[tuple[int, int]]]:
    """Refills the reservoir before each buffer, as long as items come."""
    held, more = Reservoir(l_pack, k, tolerance), True
    while True:
        while more and not held.full():
            item = next(items, None)
            more = item is not None
            if more:
                held.items.append(item)
        if not held.items:
            return
        made = held.form()
        if not made:
            raise ValueError(f"an item is larger than a buffer of {l_pack}")
        yield made


def best_fit(items: DataFrame, l_pack: int, k: int, shards: int | None = None, tolerance: float = 0.05) -> DataFrame:
    """items: item, size. shard, buffer_id, seq, item, size. Each shard packs on its own, in the order of items.

    A shard is one task's state, so by default there is one for each SHARD items, and 4 at least."""
    shards = shards or max(4, -(-items.count() // SHARD))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        out = []
        for b, made in enumerate(buffers(iter(zip(rows["item"].tolist(), rows["size"].tolist())), l_pack, k, tolerance)):
            out += [(int(rows["shard"].iloc[0]), b, seq, item, size) for seq, (item, size) in enumerate(made)]
        return pd.DataFrame(out, columns=["shard", "buffer_id", "seq", "item", "size"])

    dealt = items.select(F.pmod("item", F.lit(shards)).cast("int").alias("shard"), "item", "size")
    return dealt.groupBy("shard").applyInPandas(run, "shard int, buffer_id long, seq long, item long, size long")


def invariants(packed: DataFrame, items: DataFrame, l_pack: int) -> DataFrame:
    """One row: overfull and empty buffers, packed items, distinct ones, lost ones, tokens, and whether the mean fill of all but
    each shard's last buffer is above 0.9."""
    fill = packed.groupBy("shard", "buffer_id").agg(F.sum("size").alias("used"))
    last = fill.groupBy("shard").agg(F.max("buffer_id").alias("last"))
    full = fill.join(last, "shard").agg(
        F.count_if(F.col("used") > l_pack).alias("n_overfull"),
        F.count_if(F.col("used") <= 0).alias("n_empty"),
        F.sum("used").alias("n_tokens"),
        (F.avg(F.when(F.col("buffer_id") < F.col("last"), F.col("used") / l_pack)) > 0.9).alias("well_filled"),
    )
    lost = items.join(packed.select("item"), "item", "left_anti").agg(F.count("*").alias("n_lost"))
    count = packed.agg(F.count("*").alias("n_packed"), F.countDistinct("item").alias("n_distinct"))
    return full.join(count).join(lost)
