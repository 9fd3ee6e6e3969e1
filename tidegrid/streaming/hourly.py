"""Event streams: tumbling aggregates with a watermark, and packing through a stateful reservoir."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators.packing import Reservoir
from tidegrid.sources.durable import folder


def stream_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder; a stream takes a file only by a glob."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """event_type, hour, n, y. Rows later than the watermark are dropped by Spark once their window is closed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("y")).select("event_type", F.col("w.start").alias("hour"), "n", "y")


def sink(out: str):
    """Writes each micro-batch to a folder of its epoch; a batch that runs again replaces what it wrote."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return keep


def drained(stream: DataFrame, label: str, checkpoint: str | None = None, keys: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over all that is there and read what it wrote, once each micro-batch; the checkpoint makes it resumable.

    keys: the stream updates rows (state older than the watermark goes), and the latest row of each key counts;
    else rows are appended. With ``out`` and ``checkpoint`` of an earlier run, the two runs' results are read together.
    """
    spark = stream.sparkSession
    out = out or folder(spark, label)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/epoch=-1")
    query = stream.writeStream.outputMode("update" if keys else "append").foreachBatch(sink(out)).option("checkpointLocation", checkpoint or folder(spark, f"{label}-at")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{stream.schema.toDDL()}, epoch BIGINT").option("basePath", out).parquet(out)
    if not keys:
        return rows.drop("epoch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("row")).select(*keys, "row.*").select(*stream.columns)


def packed(items: DataFrame, l_pack: int, k: int, shards: int) -> DataFrame:
    """items: item, size. Buffers as the reservoir of their shard fills; a size of 0 in a shard flushes it.

    State of a shard: what its reservoir holds, k items at most, and the number of buffers made.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sizes, ids, made = state.get if state.exists else ([], [], 0)
        held = Reservoir(l_pack, k)
        held.items = list(zip(ids, sizes))
        out = []

        def form() -> None:
            nonlocal made
            for seq, (item, size) in enumerate(held.form()):
                out.append((key[0], made, seq, item, size))
            made += 1

        for rows in batches:
            for item, size in rows.sort_values("item")[["item", "size"]].itertuples(index=False):
                if size == 0:
                    while held.items:
                        form()
                    continue
                held.items.append((int(item), int(size)))
                if held.full():
                    form()
        state.update(([s for _, s in held.items], [i for i, _ in held.items], made))
        yield pd.DataFrame(out, columns=["shard", "buffer_id", "seq", "item", "size"])

    dealt = items.withColumn("shard", F.pmod("item", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandasWithState(
        step, "shard int, buffer_id long, seq long, item long, size long", "sizes array<long>, ids array<long>, made long", "append", GroupStateTimeout.NoTimeout
    )


def packed_whole(items: DataFrame, l_pack: int, k: int, shards: int) -> DataFrame:
    """Buffers of all of a drained stream's items: once it has ended, a second run from the same checkpoint flushes every shard."""
    spark = items.sparkSession
    flushes, at = folder(spark, "flushes"), folder(spark, "reservoir-at")
    schema = "item long, size long"
    spark.createDataFrame([], schema).write.parquet(flushes)
    both = items.select(F.col("item").cast("long"), F.col("size").cast("long")).unionByName(spark.readStream.schema(schema).parquet(flushes))
    stream, out = packed(both, l_pack, k, shards), folder(spark, "reservoir")
    drained(stream, "reservoir", at, out=out)
    spark.range(shards).select(F.col("id").alias("item"), F.lit(0).cast("long").alias("size")).write.mode("append").parquet(flushes)
    return drained(stream, "reservoir", at, out=out)
