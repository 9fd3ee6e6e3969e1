"""Queries: targets, losses, rollout, and the dense forward pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.scalar import PATCH
from tidegrid.operators import forecast as fc
from tidegrid.operators import losses, model
from tidegrid.sources import series as src

from . import views_sql as V
from .scoring_queries import _NORM, EV, LI, _normalised, r6
from .segment_queries import _mask_tokens

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


_TARGET = "SELECT channel_idx, ((t - 672) // 16)::BIGINT AS patch, count(y)::BIGINT AS n_valid, round(sum(coalesce(z, 0)), 6) AS z_sum FROM nz WHERE t >= 672 AND t < 720 AND channel_idx >= 2 GROUP BY ALL"


@query("horizon_targets", V.with_(*_NORM, select=_TARGET))
def horizon_targets(spark, d):
    rows = _normalised(spark, d).where("t >= 672 and t < 720 and channel_idx >= 2")
    out = rows.groupBy("channel_idx", F.floor((F.col("t") - 672) / 16).alias("patch"))
    return out.agg(F.count("y").alias("n_valid"), F.round(F.sum(F.coalesce("z", F.lit(0.0))), 6).alias("z_sum"))


_PATCHES = """tp AS (SELECT * FROM (VALUES (0, 4), (1, 8), (2, 16), (3, 64), (4, 256), (5, 512)) v(tier, p)),
er AS (SELECT tp.tier, a.channel_idx, a.t // p AS patch, b.z FROM nz a JOIN tp ON true LEFT JOIN nz b ON b.channel_idx = a.channel_idx AND b.t = a.t + tp.p AND b.t < 672 WHERE a.t < 672 AND (a.t // p + 2) * p <= 672),
ls AS (SELECT tp.tier, coalesce(sum(abs(z)), 0) / greatest(count(z), 1) AS loss FROM tp LEFT JOIN er ON er.tier = tp.tier GROUP BY ALL)"""


def _aux(spark, d):
    """Loss by tier of predicting 0 for the patch after each whole patch of the context."""
    rows = _normalised(spark, d).where("t < 672").select("channel_idx", "t", "z")
    tiers = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(p).alias("p")) for k, p in enumerate(PATCH)]))
    at = rows.select("channel_idx", "t", tiers.alias("x")).select("channel_idx", "t", "x.*").where((F.floor(F.col("t") / F.col("p")) + 2) * F.col("p") <= 672)
    ahead = at.withColumn("t", F.col("t") + F.col("p")).join(rows, ["channel_idx", "t"], "left")
    by = ahead.groupBy("tier").agg(losses.masked_mae(F.coalesce("z", F.lit(0.0)), F.col("z").isNotNull()).alias("loss"))
    every = spark.range(len(PATCH)).select(F.col("id").cast("int").alias("tier"))
    return every.join(by, "tier", "left").select("tier", F.coalesce("loss", F.lit(0.0)).alias("loss"))


@query("aux_loss_by_tier", V.with_(*_NORM, _PATCHES, select="SELECT tier::INT AS tier, round(loss, 6) AS loss FROM ls"))
def aux_loss_by_tier(spark, d):
    return _aux(spark, d).select("tier", r6("loss"))


@query(
    "total_loss",
    V.with_(*_NORM, _PATCHES, select="""SELECT round(h, 6) AS horizon, round(a, 6) AS aux, round(h + a, 6) AS total
FROM (SELECT avg(abs(z)) AS h FROM nz WHERE t >= 672 AND t < 720 AND channel_idx >= 2 AND z IS NOT NULL) CROSS JOIN (SELECT sum(0.1::DOUBLE * loss) AS a FROM ls)"""),
)
def total_loss(spark, d):
    rows = _normalised(spark, d).where("t >= 672 and t < 720 and channel_idx >= 2")
    horizon = rows.agg(losses.masked_mae(F.coalesce("z", F.lit(0.0)), F.col("z").isNotNull()).alias("horizon"))
    # one row beside one row
    return losses.weighted_total(_aux(spark, d), [0.1] * 6, F.lit(0.0)).select("aux").join(horizon).select(r6("horizon"), r6("aux"), F.round(F.col("horizon") + F.col("aux"), 6).alias("total"))


@query("rollout_forecast", V.with_("li_daily", V.impute("li_daily", "t < 2400"), V.snaive(90, 7), select="SELECT channel_idx, h, round(yhat, 2) AS yhat, (h // 32)::INT AS pass FROM fc"))
def rollout_forecast(spark, d):
    filled = fc.impute_last(src.context(src.li_daily(spark, d), LI))
    return model.rollout(filled, LI.p, 32, LI.season).select("channel_idx", "h", F.round("yhat", 2).alias("yhat"), "pass")


@query(
    "visible_future",
    V.with_("ev_hourly", select="SELECT channel_idx, count(CASE WHEN t < 672 THEN y END)::BIGINT AS past_only, count(CASE WHEN t < 672 OR (t < 720 AND channel_idx < 2) THEN y END)::BIGINT AS with_future FROM ev_hourly GROUP BY ALL"),
)
def visible_future(spark, d):
    """What a forecaster may see of each channel: the context alone, and with the features' future revealed."""
    seen = (F.col("t") < EV.origin) | ((F.col("t") < EV.origin + EV.p) & (F.col("channel_idx") < 2))
    return src.ev_hourly(spark, d).groupBy("channel_idx").agg(F.count(F.when(F.col("t") < EV.origin, F.col("y"))).alias("past_only"), F.count(F.when(seen, F.col("y"))).alias("with_future"))


@query(
    "plot_table",
    V.with_(
        "ev_hourly", V.impute("ev_hourly", "t < 672"), V.snaive(48, 24),
        select="""SELECT 'context' AS kind, channel_idx, t, round(y, 6) AS y FROM ev_hourly WHERE t >= 576 AND t < 672
UNION ALL SELECT 'truth', channel_idx, t, round(y, 6) FROM ev_hourly WHERE t >= 672 AND t < 720 UNION ALL SELECT 'naive', channel_idx, h + 672, round(yhat, 6) FROM fc""",
    ),
)
def plot_table(spark, d):
    points = src.ev_hourly(spark, d)
    tail = points.where((F.col("t") >= EV.origin - max(3 * EV.season, 96)) & (F.col("t") < EV.origin)).select(F.lit("context").alias("kind"), "channel_idx", "t", "y")
    truth = src.labels(points, EV).select(F.lit("truth").alias("kind"), "channel_idx", "t", "y")
    naive = fc.seasonal_naive(src.context(points, EV), EV.p, EV.season).select(F.lit("naive").alias("kind"), "channel_idx", (F.col("h") + EV.origin).alias("t"), F.col("yhat").alias("y"))
    return tail.unionByName(truth).unionByName(naive).select("kind", "channel_idx", "t", r6("y"))


@query("forward_smoke")
def forward_smoke(spark, d):
    tokens = _mask_tokens(spark, d).withColumn("value", F.pmod(F.col("slot") * 37, F.lit(11)) / 11.0)
    return model.forward_rows(tokens).select("buffer_id", "slot", r6("pred"))
