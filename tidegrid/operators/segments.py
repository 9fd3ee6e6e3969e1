"""Shapes of crops: horizon caps, budgets, coverage; deterministic for scoring, sampled by key for training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import PATCH, computed, integer, uniform

from . import telescope as ts


@dataclass(frozen=True)
class SamplerParams:
    l_pack: int = 256
    p_out: int = 16
    q_tok_max: int = 4
    max_query_tokens: int = 128
    kff_reveal_prob: float = 0.5

    def __post_init__(self):
        if self.p_out not in PATCH:
            raise ValueError(f"p_out must be one of {PATCH}")


def capped_horizon(p: Column, channels: Column, c: Column, params: SamplerParams) -> Column:
    """Steps that one pass may predict under the query budget."""
    budget = F.least(F.lit(params.max_query_tokens), F.greatest(F.lit(1), params.l_pack - c))
    q = F.greatest(F.lit(1), F.floor(budget / F.greatest(F.lit(1), channels)))
    return F.least(p, q * params.p_out).cast("long")


def _finished(df: DataFrame, params: SamplerParams) -> DataFrame:
    """From c, n_targets, n_kff, q_tok, origin: budget, coverage, counts and size."""
    df = df.withColumn("q_total", ((F.col("n_targets") + F.col("n_kff")) * F.col("q_tok")).cast("long"))
    df = computed(df.withColumn("n", F.greatest(F.lit(1), F.floor((params.l_pack - F.col("q_total")) / F.col("c"))).cast("long")), "n", "q_total")
    df = df.withColumn("target", F.least(ts.coverage(ts.default_counts(F.col("n"))), F.col("origin")))
    df = df.withColumn("n_eff", F.greatest(F.lit(1), ts.tokens_for_coverage(F.col("target"), F.col("n"), params.l_pack)).cast("long"))
    df = ts.with_allocation(computed(df, "n", "target", "n_eff"), "n_eff", "target")
    return df.withColumn("coverage", ts.coverage(F.col("counts"))).withColumn("size", (F.col("c") * F.col("n_eff") + F.col("q_total")).cast("long"))


def eval_spec(items: DataFrame, params: SamplerParams, kff: bool = False) -> DataFrame:
    """items: n_features, n_targets, origin, p."""
    df = items.withColumn("c", F.col("n_features") + F.col("n_targets")).withColumn("q_tok", F.ceil(F.col("p") / params.p_out))
    return _finished(df.withColumn("n_kff", F.col("n_features") if kff else F.lit(0)), params)


def sample_spec(items: DataFrame, params: SamplerParams, seed: str = "0", key: str = "series_id") -> DataFrame:
    """items: key, n_features, n_targets, t_raw. Draws depend on the key alone."""
    k = F.col(key)
    reveal = lambda c: uniform(seed, k, "kff", c.cast("string")) < params.kff_reveal_prob
    df = items.withColumn("c", F.col("n_features") + F.col("n_targets"))
    kff = F.when(F.col("n_features") > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_features"))), reveal))).otherwise(0)
    df = df.withColumn("n_kff", kff)
    h = F.greatest(F.lit(1), F.col("n_targets") + F.col("n_kff"))
    caps = [F.floor((params.l_pack - F.col("c")) / h), F.floor((F.col("t_raw") - 1) / params.p_out), F.floor(params.max_query_tokens / h)]
    top = F.greatest(F.lit(1), F.least(F.lit(params.q_tok_max), *[F.greatest(F.lit(1), x) for x in caps]))
    df = df.withColumn("q_tok", integer(1, top, seed, k, "q"))
    hi = F.least(F.col("q_tok") * params.p_out, F.col("t_raw") - 1)
    df = df.withColumn("p", integer(F.least((F.col("q_tok") - 1) * params.p_out + 1, hi), hi, seed, k, "p"))
    df = df.withColumn("origin", integer(1, F.col("t_raw") - F.col("p"), seed, k, "origin"))
    return _finished(df, params)


def spec_violations(specs: DataFrame, params: SamplerParams) -> DataFrame:
    """Rows whose sizes contradict each other."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    bad = (F.col("size") != F.col("c") * F.col("n_eff") + F.col("q_total")) | (total != F.col("n_eff")) | F.exists("counts", lambda x: x < 0) | (F.ceil(F.col("p") / params.p_out) != F.col("q_tok")) | (F.col("origin") < 1)
    return specs.where(bad)
