"""Shared scratch space and session settings of the corpus operators.

Executors may be lost at any time, so lineage is cut only with tables written
to the folder that ``spark.checkpoint.dir`` names, which every executor shares.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]
_own: dict[str, str] = {}
#: Bytes of an Arrow batch to a worker, beyond which a row begins a new one.
BATCH_BYTES = 16 << 20
#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 500_000
#: A key with more rows than this, and than a HOT_KEYS-th of all, is joined by broadcast.
HOT_ROWS, HOT_KEYS = 2_000, 100_000
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; a local one of our own only where none is set and all executors are in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
    return _own[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/tidegrid-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a durable cut of lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_by_hash(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` distinct keys (all, if fewer) by a hash, the same whatever the layout.

    Rows are cut by a threshold on the hash before they are sorted, one that about 2 n
    rows pass, so what tasks hand on doesn't grow with the input.
    """
    by, rows = F.xxhash64(*keys), df.select(*keys)
    share = (2 * n + 1000) / max(1, rows.count())
    if share < 1:
        few = rows.where(by < F.lit(int(-(2**63) + share * 2**64))).distinct()
        # keys that repeat much may leave too few of them below it
        rows = few if few.count() >= n else rows
    return rows.distinct().orderBy(by, *keys).limit(n)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to table (one row a key, ``count``: how many rows have it), without a hot key in one task.

    A table of BROADCAST_ROWS at most is broadcast. Of a larger one those keys are whose count is above one
    that HOT_KEYS of them at most can have; the others are shuffled.
    """
    size = table.agg(F.count("*"), F.coalesce(F.sum(count), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(count)), keys, how)
    hot = F.col(count) > max(HOT_ROWS, size[1] // HOT_KEYS)
    heavy = F.broadcast(table.where(hot).drop(count))
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(table.where(~hot).drop(count), keys, how)
    return rows.join(heavy, keys).unionByName(rest)


def prepare(spark: SparkSession, records: int = 512) -> None:
    """Bound Arrow batches (texts may be long) and make the package importable on workers.

    The settings stay for the session, as plans read them when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > records:
        spark.conf.set(key, str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    target = Path(tempfile.mkdtemp(prefix="tidegrid-zip-")) / "tidegrid_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((_ROOT / "tidegrid").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(target))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of tables that have been cut and are no longer held.

    The cleaner acts on what the JVM has collected; else files of finished rounds fill the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
