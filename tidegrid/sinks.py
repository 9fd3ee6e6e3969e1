"""Where a run leaves its scalars, tables and settings: a folder, or nowhere."""

from __future__ import annotations

import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Nowhere:
    """Takes everything and keeps nothing."""

    def settings(self, values: dict) -> None: ...

    def scalars(self, rows: DataFrame, step: int) -> None: ...

    def table(self, name: str, rows: DataFrame) -> None: ...

    def finish(self) -> None: ...


class Folder(Nowhere):
    """settings, command and tables below a folder; scalars are appended as (run, step, key, value).

    What can't be written is told once on standard error; a sink never ends a run.
    """

    def __init__(self, spark: SparkSession, path: str, run: str | None = None):
        self.spark, self.path, self.run, self.told = spark, path.rstrip("/"), run or uuid.uuid4().hex, False

    def _try(self, write) -> None:
        try:
            write()
        except Exception as e:  # a sink of metrics must not stop what it measures
            if not self.told:
                print(f"sink {self.path}: {e}", file=sys.stderr)
            self.told = True

    def settings(self, values: dict) -> None:
        text = json.dumps({"run": self.run, "command": sys.argv, "settings": values}, sort_keys=True)
        self._try(lambda: self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/settings"))

    def scalars(self, rows: DataFrame, step: int) -> None:
        """rows: key, value. The same step of a run written again replaces itself."""
        made = rows.select(F.lit(self.run).alias("run"), F.lit(step).cast("long").alias("step"), "key", F.col("value").cast("double").alias("value"))
        self._try(lambda: made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/scalars/part={self.run}-{step}"))

    def table(self, name: str, rows: DataFrame) -> None:
        self._try(lambda: rows.write.mode("overwrite").parquet(f"{self.path}/tables/{name}"))

    def read_scalars(self) -> DataFrame:
        return self.spark.read.schema("run string, step long, key string, value double").option("basePath", f"{self.path}/scalars").parquet(f"{self.path}/scalars").select("run", "step", "key", "value")


def sink_of(spark: SparkSession, settings: dict, environment: dict[str, str] | None = None) -> Nowhere:
    """By settings; a mode in the environment (TIDEGRID_TRACKING) wins, and what needs a network stays off."""
    mode = (environment or {}).get("TIDEGRID_TRACKING") or settings["tracking"]["mode"]
    if settings["tracking"]["sink"] == "none" or mode == "disabled" or not settings["run"]["out"]:
        return Nowhere()
    return Folder(spark, settings["run"]["out"])
