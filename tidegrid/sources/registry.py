"""Storage roots, listings of configurations, and sources by name."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalar import steps
from tidegrid.operators import cases
from tidegrid.settings import read_environment

from . import series as src

MARKER = "dataset_info.json"


def root_of(given: str, variable: str = "TIDEGRID_ROOT", environment: dict[str, str] | None = None, file: str = ".env") -> str:
    """The folder given, else that of a variable in the environment or in a file of KEY=VALUE lines; ~ is expanded."""
    found = given or read_environment(file, dict(os.environ if environment is None else environment)).get(variable, "")
    if not found:
        raise ValueError(f"no storage root: give a folder or set {variable}")
    return os.path.expanduser(found)


def configurations(spark: SparkSession, root: str, marker: str = MARKER) -> DataFrame:
    """config_id: paths, relative to the root, of folders that hold the marker file, in order. Spark lists, so any store will do."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker)
    path = F.regexp_replace("path", r"^(file:)/+", "/")
    base = root.rstrip("/").removeprefix("file://")
    inner = F.regexp_extract(path, rf"^(?:.*?){base.replace('.', chr(92) + '.')}/(.+)/{marker.replace('.', chr(92) + '.')}$", 1)
    return reader.load(root).select(inner.alias("config_id")).where("config_id <> ''").distinct().orderBy("config_id")


def overfit_stream(windows: DataFrame, least: int, epochs: int, world: int, rank: int) -> tuple[DataFrame, int]:
    """(rows, series dropped): windows merged back to whole series, short ones dropped, one rank's share of them, once an epoch.

    windows: series_id, channel_idx, t, y. A rank without series is an error.
    """
    whole = src.drop_short(windows, least)
    kept, every = whole.select("series_id").distinct().count(), windows.select("series_id").distinct().count()
    own = whole.where(F.pmod(F.xxhash64("series_id"), F.lit(world)) == rank)
    if own.isEmpty():
        raise ValueError(f"no series for rank {rank} of {world}")
    return own.select(steps(epochs).alias("epoch"), *windows.columns), every - kept


def _corpus(spark: SparkSession, settings: dict) -> DataFrame:
    data = settings["data"]
    return cases.corpus(spark, data["series"], tuple(data["length"]), data["channels"][1], data["gap_share"])


def _sanity(spark: SparkSession, settings: dict) -> DataFrame:
    n, horizon = 512, settings["data"]["horizon"]
    return cases.training_stream(cases.independent_sines(spark, settings["data"]["series"], n, 2, 4), n, horizon, 1, 1, 0)


def _sanity_eval(spark: SparkSession, settings: dict) -> DataFrame:
    n, horizon = 512, settings["data"]["horizon"]
    return cases.held_out(cases.independent_sines(spark, settings["data"]["series"], n, 2, 4), n, horizon, "multivariate_independent")


def _synthetic_eval(spark: SparkSession, settings: dict) -> DataFrame:
    return eval_shard(spark, settings["eval"]["windows"], settings["model"]["out_patch"])


def eval_shard(spark: SparkSession, n_items: int, p_out: int) -> DataFrame:
    """config_id, channel, t, y, part, h: series of 64 to 256 steps, half of them of one channel, the last one or two patches held out."""
    from tidegrid.operators.generators import grid

    idx = F.col("idx")
    items = spark.range(n_items).select(F.col("id").alias("idx")).withColumns(
        {"n": cases.integer(64, 256, "0", idx, "eval-length"), "p": p_out * cases.integer(1, 2, "0", idx, "eval-patches"), "many": cases.uniform("0", idx, "eval-kind") >= 0.5}
    )
    one = cases.primitives(grid(spark, n_items, 256), 256).select("idx", F.lit(0).cast("long").alias("channel"), "t", "y")
    several = cases.shared_factors(spark, n_items, 256, 2, 3)
    rows = one.join(items.where("not many"), "idx").unionByName(several.join(items.where("many"), "idx")).where("t < n")
    at = F.col("t") - F.col("n") + F.col("p")
    return rows.select(F.concat(F.lit("synthetic/item_"), idx.cast("string")).alias("config_id"), "channel", "t", "y", F.when(at < 0, "context").otherwise("label").alias("part"), F.when(at >= 0, at).alias("h"))


TRAINING: dict[str, Callable[[SparkSession, dict], DataFrame]] = {"corpus": _corpus, "sanity": _sanity}
EVALUATION: dict[str, Callable[[SparkSession, dict], DataFrame]] = {"sanity_eval": _sanity_eval, "synthetic_eval": _synthetic_eval}


def build(kind: dict[str, Callable[[SparkSession, dict], DataFrame]], name: str) -> Callable[[SparkSession, dict], DataFrame]:
    """A source of TRAINING or EVALUATION by name."""
    if name not in kind:
        raise NotImplementedError(f"no source {name!r}; there are {sorted(kind)}")
    return kind[name]
