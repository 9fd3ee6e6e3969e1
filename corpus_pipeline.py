"""A corpus pipeline: quality rules, near duplicates, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents, whatever their names: while an operator runs, columns that it
doesn't read have names of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontamination, ngram_join, packing, quality_rules, secret_scan
from tidegrid.llm.queries import table
from tidegrid.llm.store import scratch
from tidegrid.llm.tokenizer import public_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
READ = ("doc_id", "text", "n_chars")


def keeps_columns(stage: Stage) -> Stage:
    """Renames all columns that stages don't read while the stage runs, so that none clashes with what it adds."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = docs.toDF(*[c if c in READ else f"__column_{k}" for k, c in enumerate(docs.columns)])
        return stage(spark, own, sf_dir).select(*own.columns).toDF(*docs.columns)

    return run


@keeps_columns
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The model is fitted on the labelled ones among docs."""
    crf = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score(docs, crf).where("kept")


@keeps_columns
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, that with the smallest doc_id; rows are told apart by id and text."""
    return ngram_join.keep_one(docs)


@keeps_columns
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@keeps_columns
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; n_chars follows the text."""
    out = secret_scan.scan(docs, secret_scan.fit(docs), redact="[SECRET]")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs, public_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: A fitted model decides in the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage-{name}")
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
        docs = out
    return docs
