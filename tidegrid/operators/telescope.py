"""Multi-resolution patches under a token budget, in closed form: expressions only, no loop, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import PATCH, computed, steps

PRIOR = (2, 2, 2, 2, 2, 1)


def default_counts(n: Column, prior: tuple[int, ...] = PRIOR) -> Column:
    """Array of tokens by tier: largest remainders of n in the prior's ratio; ties go to the finer tier."""
    if len(prior) != len(PATCH) or min(prior) <= 0:
        raise ValueError(f"a prior has {len(PATCH)} positive weights")
    total = sum(prior)
    rem = [F.pmod(n * w, F.lit(total)) for w in prior]
    floor = [F.floor(n * w / total) for w in prior]
    left = n - sum(floor[1:], floor[0])
    counts = []
    for k in range(len(prior)):
        ahead = sum((F.when((rem[j] >= rem[k]) if j < k else (rem[j] > rem[k]), 1).otherwise(0) for j in range(len(prior)) if j != k), F.lit(0))
        counts.append((floor[k] + F.when(ahead < left, 1).otherwise(0)).cast("long"))
    return F.array(*counts)


def coverage(counts: Column) -> Column:
    """Raw steps that the counts cover."""
    return sum((F.element_at(counts, k + 1) * p for k, p in enumerate(PATCH)), F.lit(0)).cast("long")


def default_coverages(top: int, prior: tuple[int, ...] = PRIOR) -> list[int]:
    """Coverage of the default counts of 1..top tokens."""
    out, total = [], sum(prior)
    for n in range(1, top + 1):
        counts = [n * w // total for w in prior]
        order = sorted(range(len(prior)), key=lambda k: (-(n * prior[k] % total), k))
        for k in order[: n - sum(counts)]:
            counts[k] += 1
        out.append(sum(c * p for c, p in zip(counts, PATCH)))
    return out


def tokens_for_coverage(t: Column, cap: Column, top: int = 512) -> Column:
    """Fewest tokens whose default coverage reaches t, the cap at most; ``top`` bounds the cap."""
    least = F.size(F.filter(F.array(*[F.lit(c) for c in default_coverages(top)]), lambda c: c < t)) + 1
    return F.when(t <= 0, 0).when(least == 1, 1).otherwise(F.least(least, cap)).cast("long")


def with_allocation(df: DataFrame, n: str, t: str, out: str = "counts") -> DataFrame:
    """Adds counts of n tokens whose coverage comes near t.

    Moves run in a fixed order: while too long, from the coarsest tier to the finest;
    while too short, from the finest to the coarsest. In each tier as many moves as fit
    are taken at once; one that crosses t is taken if it ends no farther away (a coarsest
    move that ties would be undone again and is not taken).
    """
    v = len(PATCH)
    df = computed(df.withColumn("__c", default_counts(F.col(n))), "__c")
    df = df.withColumn("__cov", coverage(F.col("__c")))
    df = df.withColumn("__gap", F.abs(F.col("__cov") - F.col(t))).withColumn("__over", F.col("__cov") > F.col(t)).withColumn("__stop", F.col("__gap") == 0)
    df, moved = computed(df, "__cov", "__gap", "__over", "__stop"), []
    for i in range(v - 1):
        down, up = v - 1 - i, i  # the tier that gives tokens in this step, too long and too short
        c = F.when(F.col("__over"), F.element_at("__c", down + 1)).otherwise(F.element_at("__c", up + 1))
        d = F.when(F.col("__over"), PATCH[down] - PATCH[0]).otherwise(PATCH[v - 1] - PATCH[up])
        fit = F.least(c, F.floor(F.col("__gap") / d))
        rest = F.col("__gap") - fit * d
        tie = F.col("__over") & (F.lit(down) == v - 1) & (2 * rest == d)
        cross = (fit < c) & (rest > 0) & (d <= 2 * rest) & ~tie
        m = f"__m{i}"
        moved.append(m)
        df = df.withColumn("__fit", F.when(F.col("__stop"), 0).otherwise(fit)).withColumn("__cross", ~F.col("__stop") & cross)
        df = df.withColumn(m, (F.col("__fit") + F.col("__cross").cast("int")).cast("long"))
        df = df.withColumn("__stop", F.col("__stop") | F.col("__cross") | (F.col("__fit") < c) | (rest == 0)).withColumn("__gap", F.col("__gap") - F.col("__fit") * d)
        df = computed(df, m, "__stop", "__gap")
    total = sum((F.col(m) for m in moved[1:]), F.col(moved[0]))
    counts = []
    for k in range(v):
        base = F.element_at("__c", k + 1)
        shorter = base - F.col(moved[v - 1 - k]) if k else base + total
        longer = base - F.col(moved[k]) if k < v - 1 else base + total
        counts.append(F.when(F.col("__over"), shorter).otherwise(longer))
    return computed(df.withColumn(out, F.array(*counts)), out).drop("__c", "__cov", "__gap", "__over", "__stop", "__fit", "__cross", *moved)


def dispatch(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tier, i, raw_start, raw_end, pos: patches of each segment, newest first, from counts and origin."""
    counts = F.col("counts")
    before = F.array(*[sum((F.element_at(counts, j + 1) * PATCH[j] for j in range(k)), F.lit(0)) for k in range(len(PATCH))])
    ahead = F.array(*[sum((F.element_at(counts, j + 1) for j in range(k)), F.lit(0)) for k in range(len(PATCH))])
    widths = F.array(*[F.lit(p) for p in PATCH])
    rows = segments.select(*keys, "origin", before.alias("__b"), ahead.alias("__a"), F.posexplode("counts").alias("tier", "c")).where("c > 0")
    rows = rows.select("*", steps(F.col("c")).alias("i")).withColumn("patch", F.element_at(widths, F.col("tier") + 1))
    end = F.col("origin") - F.element_at("__b", F.col("tier") + 1) - F.col("i") * F.col("patch")
    return rows.select(*keys, "tier", "i", "patch", (end - F.col("patch")).alias("raw_start"), end.alias("raw_end"), (F.element_at("__a", F.col("tier") + 1) + F.col("i")).alias("pos"))
