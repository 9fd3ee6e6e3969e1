"""Masked losses over supplied predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def masked_mae(error: Column, mask: Column) -> Column:
    """Sum of absolute errors under the mask by their number, at least 1."""
    return F.sum(F.when(mask, F.abs(error)).otherwise(0.0)) / F.greatest(F.count_if(mask), F.lit(1))


def weighted_total(tiers: DataFrame, weights: list[float], horizon: Column) -> DataFrame:
    """tiers: tier, loss (six rows). One row: horizon, aux and total."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("tier") + 1)
    return tiers.agg(F.sum(w * F.col("loss")).alias("aux")).select(horizon.alias("horizon"), "aux", (horizon + F.col("aux")).alias("total"))
