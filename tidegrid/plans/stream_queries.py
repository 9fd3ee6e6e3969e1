"""Queries: streams drained over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import packing as pk
from tidegrid.sources import series as src
from tidegrid.streaming import hourly as hs

QUERIES, ORACLE = {}, {}


def stream_hourly(spark, d):
    rows = hs.drained(hs.hourly(hs.stream_of(spark, d, "events")), "hourly", keys=["event_type", "hour"])
    hour = F.floor((F.unix_timestamp("hour") - F.lit(1704067200)) / 3600)
    return rows.select("event_type", hour.cast("long").alias("t"), "n", F.round("y", 4).alias("y"))


def stream_reservoir(spark, d):
    items = hs.stream_of(spark, d, "documents").select(F.col("doc_id").alias("item"), F.least(F.lit(256), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 64))).cast("long").alias("size"))
    return hs.packed_whole(items, 256, 48, 4)


def stream_reservoir_invariants(spark, d):
    """Every document is in one buffer, and none is overfull."""
    return pk.invariants(stream_reservoir(spark, d).drop("seq"), src.doc_lengths(spark, d), 256)


QUERIES["stream_reservoir_invariants"] = stream_reservoir_invariants
QUERIES["stream_hourly"] = stream_hourly
QUERIES["stream_reservoir"] = stream_reservoir
ORACLE["stream_hourly"] = "SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01', ts)::BIGINT AS t, count(*)::BIGINT AS n, round(avg(value), 4) AS y FROM events GROUP BY ALL"
ORACLE["stream_reservoir_invariants"] = """SELECT 0::BIGINT AS n_overfull, 0::BIGINT AS n_empty, count(*)::BIGINT AS n_packed, count(DISTINCT item)::BIGINT AS n_distinct, 0::BIGINT AS n_lost, sum(size)::BIGINT AS n_tokens, true AS well_filled
FROM (SELECT doc_id AS item, greatest(1, least(256, ceil(n_chars / 64.0)))::BIGINT AS size FROM documents)"""
