"""Queries: scores of forecasters, the counterfactual of a known future, and forecasts put together from patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import cases as cs
from tidegrid.operators import forecast as fc
from tidegrid.operators import forecasters as fs
from tidegrid.operators import generators as g
from tidegrid.operators import scoring as sc
from tidegrid.sources import series as src

from . import case_queries as cq
from . import generator_queries as gq
from . import views_sql as V
from .scoring_queries import EMB, r6

QUERIES, ORACLE = {}, {}
SERIES, N, P, SEASON = gq.SERIES, gq.N, 24, 24
ORIGIN = N - P


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# --- a driver known ahead ------------------------------------------------------------------


def _driven(spark):
    """(points of the target, features) of the driver case."""
    rows = g.kff_driver(g.grid(spark, SERIES, N)).withColumn("series_id", F.col("idx").cast("string"))
    return rows.select("series_id", F.lit(1).alias("channel_idx"), "t", "y"), rows.select("series_id", "t", F.col("feature").alias("x"))


_DRIVEN = f"kd AS (SELECT idx, t, feature AS x, y FROM ({gq.ORACLE['gen_kff_driver'].replace('round(', '(').replace(', 6)', ')')}))"
_FIT = f"""ft AS (SELECT idx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(x, t) AS x0 FROM kd WHERE t < {ORIGIN} GROUP BY idx),
rs AS (SELECT idx, t % {SEASON} AS phase, avg(y - a - b * x) AS r FROM kd JOIN ft USING (idx) WHERE t < {ORIGIN} GROUP BY ALL),
dn AS (SELECT p.idx, avg(abs(p.y - q.y)) AS denom FROM kd p JOIN kd q ON q.idx = p.idx AND q.t = p.t - {SEASON} WHERE p.t < {ORIGIN} GROUP BY ALL),
er AS (SELECT kd.idx, avg(abs(a + b * x + r - y)) / any_value(denom) AS m1, avg(abs(a + b * x0 + r - y)) / any_value(denom) AS m0, avg(abs(nv.y2 - y)) / any_value(denom) AS mn
  FROM kd JOIN ft USING (idx) JOIN rs ON rs.idx = kd.idx AND rs.phase = kd.t % {SEASON} JOIN dn ON dn.idx = kd.idx
  JOIN (SELECT idx AS i, t AS t2, y AS y2 FROM kd) nv ON nv.i = kd.idx AND nv.t2 = {ORIGIN} - {SEASON} + (kd.t - {ORIGIN}) % {SEASON} WHERE kd.t >= {ORIGIN} GROUP BY ALL)"""


@query(
    "kff_counterfactual",
    f"WITH {_DRIVEN}, {_FIT} SELECT round(w, 6) AS with_future, round(o, 6) AS past_only, n, round(100 * (1 - w / o), 4) AS cut_percent FROM (SELECT exp(avg(ln(greatest(m1, 1e-12)))) AS w, exp(avg(ln(greatest(m0, 1e-12)))) AS o, count(*)::BIGINT AS n FROM er)",
)
def kff_counterfactual(spark, d):
    points, features = _driven(spark)
    split = src.EvalSplit(ORIGIN, P, SEASON)
    seasons = points.select(*fc.KEYS).distinct().withColumn("season", F.lit(SEASON))
    row = fs.counterfactual(src.context(points, split), src.labels(points, split), features, seasons, ORIGIN, P, SEASON)
    return row.select(r6("with_future"), r6("past_only"), "n", F.round("cut_percent", 4).alias("cut_percent"))


_SCORED = f"""sk AS (SELECT idx, CASE WHEN idx % 3 < 2 THEN m1 END AS model, CASE WHEN idx % 3 < 2 THEN mn END AS naive FROM er)"""


@query(
    "mase_report",
    f"WITH {_DRIVEN}, {_FIT}, {_SCORED} SELECT round(m, 6) AS model_mase, round(v, 6) AS naive_mase, n, skipped, round(m / v, 6) AS skill FROM (SELECT exp(avg(CASE WHEN model IS NOT NULL THEN ln(greatest(model, 1e-12)) END)) AS m, exp(avg(CASE WHEN naive IS NOT NULL THEN ln(greatest(naive, 1e-12)) END)) AS v, count(model)::BIGINT AS n, count_if(model IS NULL)::BIGINT AS skipped FROM sk)",
)
def mase_report(spark, d):
    """Of all series, a third have no season: they are counted and not scored."""
    points, features = _driven(spark)
    split = src.EvalSplit(ORIGIN, P, SEASON)
    known = points.select("series_id").distinct().where("cast(series_id as int) % 3 < 2").withColumn("season", F.lit(SEASON))
    seasons = fs.channel_seasons(points, known, known.select("series_id", F.lit(7).alias("channel_idx"), "season"))
    scores = fs.score(src.context(points, split), src.labels(points, split), seasons, P, fs.driver_forecaster(fs.visible(features, ORIGIN, P, True), ORIGIN, SEASON))
    return fs.report(scores, points).select(r6("model_mase"), r6("naive_mase"), "n", "skipped", r6("skill"))


# --- seasons by channel --------------------------------------------------------------------


@query(
    "mase_by_channel_season",
    f"""WITH {cq.channels(2, 4)}, {cq._IND},
dn AS (SELECT a.idx, a.channel, greatest(avg(abs(a.y - b.y)), 1e-8) AS denom FROM ind a JOIN ind b ON b.idx = a.idx AND b.channel = a.channel AND b.t = a.t - a.season WHERE a.t < {cq.N - cq.HORIZON} GROUP BY ALL)
SELECT l.idx::VARCHAR AS series_id, l.channel::INT AS channel_idx, round(avg(abs(f.y - l.y)) / any_value(dn.denom), 6) AS mase
FROM ind l JOIN ind f ON f.idx = l.idx AND f.channel = l.channel AND f.t = {cq.N - cq.HORIZON} - l.season + (l.t - {cq.N - cq.HORIZON}) % l.season JOIN dn ON dn.idx = l.idx AND dn.channel = l.channel
WHERE l.t >= {cq.N - cq.HORIZON} GROUP BY ALL""",
)
def mase_by_channel_season(spark, d):
    rows = cs.independent_sines(spark, cq.SERIES, cq.N, 2, 4).select(F.col("idx").cast("string").alias("series_id"), F.col("channel").cast("int").alias("channel_idx"), "t", "y", "season")
    split = src.EvalSplit(cq.N - cq.HORIZON, cq.HORIZON, 1)
    whole = rows.groupBy("series_id").agg(F.lit(1).alias("season"))  # what a channel without its own would take
    seasons = fs.channel_seasons(rows, whole, rows.select(*fc.KEYS, "season").distinct())
    ctx = src.context(rows.drop("season"), split)
    scores = sc.mase(fs.naive_by_season(ctx, cq.HORIZON, seasons), src.labels(rows, split), fs.denominator_by_season(ctx, seasons))
    return scores.select(*fc.KEYS, r6("mase"))


@query(
    "mean_test_loss",
    V.with_("emb_series", V.impute("emb_series", "t < 48"), V.snaive(16, 8), select="""SELECT round(avg(loss), 6) AS loss, count(*)::BIGINT AS n FROM (
  SELECT l.series_id, avg(abs(fc.yhat - l.y)) AS loss FROM emb_series l JOIN fc ON fc.series_id = l.series_id AND fc.h = l.t - 48 WHERE l.t >= 48 AND l.t < 64 GROUP BY ALL ORDER BY l.series_id LIMIT 20)"""),
)
def mean_test_loss(spark, d):
    """Mean over the first 20 series of each one's loss: the cap is the feature."""
    points = src.emb_series(spark, d)
    rows = fs.mean_loss(fc.seasonal_naive(src.context(points, EMB), EMB.p, EMB.season), src.labels(points, EMB), 20)
    return rows.select(r6("loss"), "n")


# --- patches -------------------------------------------------------------------------------


@query(
    "forecast_reassembly",
    "SELECT channel_idx::INT AS channel_idx, h::BIGINT AS h, CASE WHEN h // 16 = 1 THEN NULL ELSE (channel_idx * 1000 + h)::DOUBLE END AS yhat FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem) JOIN (SELECT unnest(range(3)) AS channel_idx) ON true CROSS JOIN (SELECT unnest(range(40)) AS h) WHERE f = (SELECT min(l_returnflag) FROM lineitem)",
)
def forecast_reassembly(spark, d):
    """Three channels of three patches of 16 steps, the second patch missing, cut at 40 steps."""
    grid = src.li_daily(spark, d).select(*fc.KEYS).distinct()
    made = grid.select(*fc.KEYS, F.explode(F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j"))
    made = made.withColumn("values", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.col("channel_idx") * 1000 + F.col("j") * 16 + i).cast("double")))
    rows = fs.reassembled(made, grid, 40, 16)
    return rows.select("channel_idx", "h", F.when(~F.isnan("yhat"), F.col("yhat")).alias("yhat"))
