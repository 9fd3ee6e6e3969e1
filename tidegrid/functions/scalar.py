"""Scalar expressions shared by the operators: all built in, so they stay in compiled stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patch widths by tier, scale factors and floors.
PATCH = (4, 8, 16, 64, 256, 512)
MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 1 / 1.349
RELATIVE_FLOOR = 1e-3
DENOM_FLOOR = 1e-8
GMEAN_FLOOR = 1e-12
CLAMP = 10.0
SEASONS = {"H": 24, "M": 12, "D": 1, "W": 1, "T": 1440, "Q": 4, "B": 5}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def asinh(x: Column) -> Column:
    """Odd by construction: the built-in loses precision for large negative values."""
    return F.signum(x) * F.asinh(F.abs(x))


def forward(x, a, sigma) -> Column:
    """Anchored arcsinh."""
    return asinh((col(x) - col(a)) / col(sigma))


def inverse(z, a, sigma) -> Column:
    return F.sinh(col(z)) * col(sigma) + col(a)


def clamp(z, limit: float = CLAMP) -> Column:
    """NaN stays NaN."""
    z = col(z)
    return F.when(F.isnan(z), z).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))


def finite(x) -> Column:
    """NaN and infinities as null: missing data."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def fed_back(x) -> Column:
    """What a forecast turns into when it is fed back: anything not finite is 0."""
    return F.coalesce(finite(x), F.lit(0.0))


def gmean(x) -> Column:
    """Geometric mean with a floor; nulls don't count, NaN on nothing, poisoned by NaN and infinity."""
    x = col(x)
    held = F.when(x.isNotNull(), F.greatest(x, F.lit(GMEAN_FLOOR)))  # greatest alone would pass over a null
    return F.coalesce(F.exp(F.avg(F.log(held))), F.lit(float("nan")))


def skill(model, naive) -> Column:
    """NaN where the naive score is 0 or NaN."""
    model, naive = col(model), col(naive)
    return F.when((naive == 0) | F.isnan(naive), float("nan")).otherwise(model / F.nullif(naive, F.lit(0.0)))


def uniform(*key) -> Column:
    """Uniform in [0, 1) by the key alone: 52 bits of its md5."""
    text = F.concat_ws(":", *[k if isinstance(k, Column) else F.lit(str(k)) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def integer(lo, hi, *key) -> Column:
    """Integer in [lo, hi] by the key."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return (lo + F.floor(uniform(*key) * (hi - lo + 1))).cast("long")


def normal(*key) -> Column:
    """Standard normal by Box-Muller on two keys."""
    return F.sqrt(-2 * F.log(1 - uniform(*key, "n1"))) * F.cos(2 * F.lit(3.141592653589793) * uniform(*key, "n2"))


def fourier(x, low: float, high: float, n: int) -> Column:
    """sin and cos of x at n frequencies, spaced evenly in their logarithm."""
    steps = [low * (high / low) ** (k / (n - 1)) for k in range(n)] if n > 1 else [low]
    freqs = F.array(*[F.lit(float(f)) for f in steps])
    return F.concat(F.transform(freqs, lambda f: F.sin(col(x) * f)), F.transform(freqs, lambda f: F.cos(col(x) * f)))


def computed(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with these columns computed at this place.

    The optimizer merges projections and would copy a column's expression to each of
    its uses; a chain of uses then grows without bound. It doesn't merge over a
    generator, and one of a single element costs nothing.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("__at")).select(*rest, *[F.col(f"__at.{c}").alias(c) for c in columns])


def steps(n) -> Column:
    """A generator of 0..n-1 as long."""
    last = (n if isinstance(n, Column) else F.lit(n)).cast("long") - 1
    return F.explode(F.sequence(F.lit(0).cast("long"), last))
