"""Texts: names of configurations, durations, and KEY=VALUE lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col


def config_id(*parts) -> Column:
    """Parts joined by a slash."""
    return F.concat_ws("/", *[col(p) for p in parts])


def duration(seconds) -> Column:
    """12.3s, 4m05s, 1h02m03s."""
    s = col(seconds)
    whole = F.floor(s).cast("long")
    h, m = F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long")
    rest = F.pmod(whole, F.lit(60))
    return F.when(s < 60, F.format_string("%.1fs", s)).when(h > 0, F.format_string("%dh%02dm%02ds", h, m, rest)).otherwise(F.format_string("%dm%02ds", m, rest))


def dotenv(lines: DataFrame) -> DataFrame:
    """lines: line_no, line. key, value of each KEY=VALUE line; comments and lines without a key go, the first of equal keys stays."""
    line = F.trim("line")
    at = F.locate("=", line)
    value = F.trim(F.expr("substring(trim(line), locate('=', trim(line)) + 1)"))
    # outer quotes go, double ones first
    value = F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", "")
    rows = lines.where((at > 0) & ~F.startswith(line, F.lit("#"))).select("line_no", F.trim(F.substring_index(line, "=", 1)).alias("key"), value.alias("value")).where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("value", "line_no").alias("value"))
