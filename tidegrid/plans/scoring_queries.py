"""Queries: series views, baseline forecasts, scores, leaderboards; and robust statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import scalar as S
from tidegrid.operators import forecast as fc
from tidegrid.operators import scoring as sc
from tidegrid.operators import stats as st
from tidegrid.sources import series as src

from . import views_sql as V

EV = src.EvalSplit(672, 48, 24)
EMB = src.EvalSplit(48, 16, 8)
LI = src.EvalSplit(2400, 90, 7)
QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


def _view(name, f, rounding):
    @query(f"series_{name}", V.with_(name, select=f"SELECT series_id, channel_idx, t, round(y, {rounding}) AS y FROM {name}"))
    def run(spark, d):
        return f(spark, d).select("series_id", "channel_idx", "t", F.round("y", rounding).alias("y"))


for _name, _f in src.VIEWS.items():
    _view(_name, _f, 4)
_view("ev_user_counts", lambda s, d: src.ev_user_hourly(s, d, counts=True), 4)


@query(
    "contract_violations",
    """SELECT 'documents' AS series_id, source AS channel, count(*)::BIGINT AS n FROM documents WHERE text IS NULL OR n_chars <> length(text) GROUP BY ALL
UNION ALL SELECT 'events', event_type, count(*)::BIGINT FROM events WHERE value IS NULL OR isnan(value) GROUP BY ALL""",
)
def contract_violations(spark, d):
    docs = src.read(spark, d, "documents").where("text is null or n_chars <> length(text)").groupBy(F.col("source").alias("channel")).agg(F.count("*").alias("n"))
    ev = src.read(spark, d, "events").where("value is null or isnan(value)").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    return docs.select(F.lit("documents").alias("series_id"), "channel", "n").unionByName(ev.select(F.lit("events").alias("series_id"), "channel", "n"))


@query("impute_last_value", V.with_("ord_daily", V.impute("ord_daily", "true"), select="SELECT channel_idx, t, round(filled, 4) AS filled FROM filled"))
def impute_last_value(spark, d):
    return fc.impute_last(src.ord_daily(spark, d)).select("channel_idx", "t", F.round("filled", 4).alias("filled"))


def _parts(view, s: src.EvalSplit, label=True):
    parts = [view, V.impute(view, f"t < {s.origin}"), V.snaive(s.p, s.season), V.denom(s.season)]
    return parts + ([V.mase(view, s.origin, s.p)] if label else [])


@query("snaive_forecast", V.with_(*_parts("ev_hourly", EV, False), select="SELECT channel_idx, h, round(yhat, 6) AS yhat FROM fc"))
def snaive_forecast(spark, d):
    return fc.seasonal_naive(src.context(src.ev_hourly(spark, d), EV), EV.p, EV.season).select("channel_idx", "h", r6("yhat"))


@query("snaive_denom", V.with_(*_parts("ev_hourly", EV, False), select="SELECT channel_idx, round(denom, 6) AS denom FROM den"))
def snaive_denom(spark, d):
    return fc.seasonal_denominator(src.context(src.ev_hourly(spark, d), EV), EV.season).select("channel_idx", r6("denom"))


@query(
    "seasonal_difference",
    V.with_("ev_hourly", select="SELECT a.channel_idx, a.t, round(a.y - b.y, 6) AS diff FROM ev_hourly a JOIN ev_hourly b ON a.channel_idx = b.channel_idx AND a.t = b.t + 24 WHERE a.y IS NOT NULL AND b.y IS NOT NULL"),
)
def seasonal_difference(spark, d):
    return fc.seasonal_difference(src.ev_hourly(spark, d), 24).where("diff is not null").select("channel_idx", "t", r6("diff"))


@query(
    "drift_forecast",
    V.with_(
        "li_daily", V.impute("li_daily", "t < 2400"),
        select="""SELECT e.channel_idx, h.h::BIGINT AS h, round(e.b + (h.h + 1) * (e.b - e.a) / greatest(e.n - 1, 1), 2) AS yhat
FROM (SELECT channel_idx, arg_min(filled, t) AS a, arg_max(filled, t) AS b, count(*) AS n FROM filled GROUP BY ALL) e CROSS JOIN (SELECT unnest(range(90)) AS h) h""",
    ),
)
def drift_forecast(spark, d):
    return fc.drift(src.context(src.li_daily(spark, d), LI), LI.p).select("channel_idx", "h", F.round("yhat", 2).alias("yhat"))


def naive_scores(points, s: src.EvalSplit):
    """series, channel and mase of the seasonal-naive forecast."""
    ctx = src.context(points, s)
    return sc.mase(fc.seasonal_naive(ctx, s.p, s.season), src.labels(points, s), fc.seasonal_denominator(ctx, s.season))


@query("mase_by_channel", V.with_(*_parts("ev_hourly", EV), select="SELECT channel_idx, round(mase, 6) AS mase FROM sc"))
def mase_by_channel(spark, d):
    return naive_scores(src.ev_hourly(spark, d), EV).select("channel_idx", r6("mase"))


@query(
    "gmean_mase",
    V.with_(*_parts("ev_hourly", EV), select="SELECT 'all' AS channel, round(exp(avg(ln(greatest(mase, 1e-12)))), 6) AS mase FROM sc UNION ALL SELECT channel_idx::VARCHAR, round(mase, 6) FROM sc"),
)
def gmean_mase(spark, d):
    scores = naive_scores(src.ev_hourly(spark, d), EV)
    # one pass: the grand total of a rollup is the row over all channels
    rows = scores.rollup(F.col("channel_idx").cast("string").alias("channel")).agg(S.gmean("mase").alias("mase"))
    return rows.select(F.coalesce("channel", F.lit("all")).alias("channel"), r6("mase"))


@query("mase_long_history", V.with_(*_parts("li_daily", LI), select="SELECT channel_idx, round(mase, 6) AS mase FROM sc"))
def mase_long_history(spark, d):
    return naive_scores(src.li_daily(spark, d), LI).select("channel_idx", r6("mase"))


def _emb_scores(spark, d):
    """By series of emb_series: configuration, and MASE of last-value (model) and seasonal naive."""
    points = src.emb_series(spark, d)
    ctx = src.context(points, EMB)
    den, lab = fc.seasonal_denominator(ctx, EMB.season), src.labels(points, EMB)
    naive = sc.mase(fc.seasonal_naive(ctx, EMB.p, EMB.season), lab, den).withColumnRenamed("mase", "naive")
    model = sc.mase(fc.last_value(ctx, EMB.p), lab, den).withColumnRenamed("mase", "model")
    config = src.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("series_id"), F.col("label").cast("string").alias("config_id"), F.col("vec_id").alias("item_seq"))
    return config.join(model, "series_id").join(naive, ["series_id", "channel_idx"])


_EMB = [
    "emb_series", V.impute("emb_series", "t < 48"), V.snaive(16, 8), V.denom(8), V.mase("emb_series", 48, 16),
    "fc1 AS (SELECT series_id, channel_idx, arg_max(filled, t) AS yhat FROM filled GROUP BY ALL)",
    """sc1 AS (SELECT l.series_id, any_value(l.config_id) AS config_id, avg(abs(fc1.yhat - l.y)) / any_value(den.denom) AS mase
  FROM emb_series l JOIN fc1 ON fc1.series_id = l.series_id JOIN den ON den.series_id = l.series_id WHERE l.t >= 48 GROUP BY l.series_id)""",
    "pair AS (SELECT sc1.config_id, sc1.series_id, sc1.mase AS model, sc.mase AS naive, sc1.series_id::BIGINT AS item_seq FROM sc1 JOIN sc ON sc.series_id = sc1.series_id)",
]
_CONF = """conf AS (SELECT config_id, exp(avg(ln(greatest(model, 1e-12)))) AS model_mase, exp(avg(ln(greatest(naive, 1e-12)))) AS naive_mase,
  count(DISTINCT series_id)::BIGINT AS n_items, count(model)::BIGINT AS n_channels FROM {} GROUP BY ALL)"""


@query("leaderboard_per_config", V.with_(*_EMB, _CONF.format("pair"), select="SELECT config_id, round(model_mase, 6) AS model_mase, round(naive_mase, 6) AS naive_mase, n_items, n_channels, round(model_mase / naive_mase, 6) AS skill FROM conf"))
def leaderboard_per_config(spark, d):
    return sc.per_config(_emb_scores(spark, d)).select("config_id", r6("model_mase"), r6("naive_mase"), "n_items", "n_channels", r6("skill"))


_BOARD = """SELECT round(exp(avg(ln(model_mase))), 6) AS model_mase, round(exp(avg(ln(naive_mase))), 6) AS naive_mase, count(*)::BIGINT AS n_configs, count(*)::BIGINT AS n_scored,
  count(*)::BIGINT AS n_finite, sum(n_items)::BIGINT AS n_items, round(exp(avg(ln(model_mase))) / exp(avg(ln(naive_mase))), 6) AS skill FROM conf"""


@query("leaderboard_board", V.with_(*_EMB, _CONF.format("pair"), select=_BOARD))
def leaderboard_board(spark, d):
    return sc.board(sc.per_config(_emb_scores(spark, d))).select(r6("model_mase"), r6("naive_mase"), "n_configs", "n_scored", "n_finite", "n_items", r6("skill"))


@query("leaderboard_capped", V.with_(*_EMB, "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY item_seq) AS rn FROM pair) WHERE rn <= 5)", _CONF.format("top"), select=_BOARD))
def leaderboard_capped(spark, d):
    return sc.board(sc.per_config(sc.first_items(_emb_scores(spark, d), 5))).select(r6("model_mase"), r6("naive_mase"), "n_configs", "n_scored", "n_finite", "n_items", r6("skill"))


@query("skill_ranking", V.with_(*_EMB, _CONF.format("pair"), select="SELECT config_id, round(model_mase / naive_mase, 6) AS skill FROM conf ORDER BY model_mase / naive_mase, config_id LIMIT 3"))
def skill_ranking(spark, d):
    return sc.ranking(sc.per_config(_emb_scores(spark, d)), 3).select("config_id", r6("skill"))


@query(
    "scalars_flatten",
    V.with_(*_EMB, _CONF.format("pair"), f"b AS ({_BOARD})", select="SELECT 'eval/' || key AS key, value FROM (SELECT model_mase::DOUBLE AS model_mase, naive_mase::DOUBLE AS naive_mase, n_configs::DOUBLE AS n_configs, n_scored::DOUBLE AS n_scored, n_finite::DOUBLE AS n_finite, n_items::DOUBLE AS n_items, skill::DOUBLE AS skill FROM b) UNPIVOT (value FOR key IN (model_mase, naive_mase, n_configs, n_scored, n_finite, n_items, skill))"),
)
def scalars_flatten(spark, d):
    return sc.scalars(leaderboard_board(spark, d), "eval")


# --- robust statistics ---------------------------------------------------------------------


@query("lower_median", V.with_("ev_hourly", select="SELECT channel_idx, round(quantile_disc(y, 0.5), 6) AS med FROM ev_hourly WHERE y IS NOT NULL GROUP BY ALL"))
def lower_median(spark, d):
    return src.ev_hourly(spark, d).groupBy("channel_idx").agg(F.round(st.lower_median("y"), 6).alias("med"))


@query("iqr", V.with_("ev_hourly", select="SELECT channel_idx, round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 6) AS iqr FROM ev_hourly GROUP BY ALL"))
def iqr(spark, d):
    return src.ev_hourly(spark, d).groupBy("channel_idx").agg(F.round(st.iqr("y"), 6).alias("iqr"))


@query("differences", V.with_("ord_daily", select="SELECT * FROM (SELECT channel_idx, t, round(y - lag(y) OVER (PARTITION BY channel_idx ORDER BY t), 4) AS diff FROM ord_daily) WHERE diff IS NOT NULL"))
def differences(spark, d):
    return st.differences(src.ord_daily(spark, d)).where("diff is not null").select("channel_idx", "t", F.round("diff", 4).alias("diff"))


def _sigma_sql(view):
    return f"""d AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY series_id, channel_idx ORDER BY t)) AS adx FROM {view}),
c AS (SELECT series_id, channel_idx, 1.4826::DOUBLE * quantile_disc(adx, 0.5) AS mad, avg(adx) AS mean_abs,
  CASE WHEN count(y) < 2 THEN 0 ELSE quantile_cont(y, 0.75) - quantile_cont(y, 0.25) END AS iqr FROM d GROUP BY ALL),
s AS (SELECT series_id, channel_idx, CASE WHEN mad > 0 THEN mad WHEN mean_abs > 0 THEN mean_abs WHEN iqr > 0 THEN iqr / 1.349::DOUBLE ELSE 1 END AS s0, iqr,
  CASE WHEN mad > 0 THEN 'mad' WHEN mean_abs > 0 THEN 'mean_abs' WHEN iqr > 0 THEN 'iqr' ELSE 'unit' END AS fallback FROM c),
sg AS (SELECT series_id, channel_idx, CASE WHEN iqr > 0 THEN greatest(s0, 0.001::DOUBLE * iqr / 1.349::DOUBLE) ELSE s0 END AS sigma, fallback FROM s)"""


for _v, _f in (("ev_user_hourly", src.ev_user_hourly), ("ev_user_counts", lambda s, d: src.ev_user_hourly(s, d, counts=True)), ("ord_daily", src.ord_daily)):

    def _add(v, f):
        @query(f"robust_sigma_{v}", V.with_(v, _sigma_sql(v), select="SELECT series_id, channel_idx, round(sigma, 6) AS sigma, fallback FROM sg"))
        def run(spark, d):
            return st.robust_sigma(f(spark, d)).select("series_id", "channel_idx", r6("sigma"), "fallback")

    _add(_v, _f)

_ANCHOR = """an AS (SELECT series_id, channel_idx, coalesce(quantile_disc(CASE WHEN mx - t < 32 THEN y END, 0.5), quantile_disc(y, 0.5), 0) AS a
  FROM (SELECT *, max(t) OVER (PARTITION BY series_id, channel_idx) AS mx FROM {}) GROUP BY ALL)"""


@query("anchor_tail", V.with_("ev_user_hourly", _ANCHOR.format("ev_user_hourly"), select="SELECT series_id, round(a, 6) AS a FROM an"))
def anchor_tail(spark, d):
    return st.anchors(src.ev_user_hourly(spark, d)).select("series_id", r6("a"))


_TIERS = """tr AS (SELECT series_id, channel_idx, tier, patch, (mx - t) // patch AS back, avg(y) AS y
  FROM (SELECT *, max(t) OVER (PARTITION BY series_id, channel_idx) AS mx, count(*) OVER (PARTITION BY series_id, channel_idx) AS n FROM {0})
  CROSS JOIN (VALUES (1, 8), (2, 16), (3, 64), (4, 256), (5, 512)) p(tier, patch) WHERE ((mx - t) // patch + 1) * patch <= n GROUP BY ALL)"""


@query("tier_aggregate", V.with_("emb_series", _TIERS.format("emb_series"), select="SELECT series_id, tier, back::BIGINT AS back, round(y, 6) AS y FROM tr"))
def tier_aggregate(spark, d):
    return st.tier_aggregate(src.emb_series(spark, d)).select("series_id", "tier", "back", r6("y"))


_TIER_SIGMA = """td AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY series_id, channel_idx, tier ORDER BY back DESC)) AS adx FROM tr),
tc AS (SELECT series_id, channel_idx, tier, count(*) AS k, 1.4826::DOUBLE * quantile_disc(adx, 0.5) AS mad, avg(adx) AS mean_abs,
  CASE WHEN count(y) < 2 THEN 0 ELSE quantile_cont(y, 0.75) - quantile_cont(y, 0.25) END AS iqr FROM td GROUP BY ALL),
ts AS (SELECT series_id, channel_idx, tier, greatest(CASE WHEN mad > 0 THEN mad WHEN mean_abs > 0 THEN mean_abs WHEN iqr > 0 THEN iqr / 1.349::DOUBLE ELSE 1 END,
  CASE WHEN iqr > 0 THEN 0.001::DOUBLE * iqr / 1.349::DOUBLE ELSE 0 END) AS sigma FROM tc WHERE k >= 2)"""


@query(
    "channel_stats",
    V.with_(
        "li_daily", _sigma_sql("li_daily"), _ANCHOR.format("li_daily"), _TIERS.format("li_daily"), _TIER_SIGMA,
        select="""SELECT sg.channel_idx, k.tier::INT AS tier, round(an.a, 2) AS a, round(coalesce(ts.sigma, sg.sigma), 2) AS sigma, sg.fallback
FROM sg JOIN an USING (series_id, channel_idx) CROSS JOIN (SELECT unnest(range(6)) AS tier) k LEFT JOIN ts ON ts.channel_idx = sg.channel_idx AND ts.tier = k.tier""",
    ),
)
def channel_stats(spark, d):
    rows = st.channel_stats(src.li_daily(spark, d))
    return rows.select("channel_idx", "a", "fallback", F.posexplode("sigma_delta").alias("tier", "sigma")).select("channel_idx", "tier", F.round("a", 2).alias("a"), F.round("sigma", 2).alias("sigma"), "fallback")


def _normalised(spark, d):
    points = src.ev_hourly(spark, d)
    ctx = src.context(points, EV)
    return points.join(st.robust_sigma(ctx), fc.KEYS).join(st.anchors(ctx), fc.KEYS).withColumn("z", S.forward("y", "a", "sigma"))


_NORM = ["ev_hourly", "cx AS (SELECT * FROM ev_hourly WHERE t < 672)", _sigma_sql("cx"), _ANCHOR.format("cx"), "nz AS (SELECT p.channel_idx, p.t, p.y, an.a, sg.sigma, asinh((p.y - an.a) / sg.sigma) AS z FROM ev_hourly p JOIN sg USING (channel_idx) JOIN an USING (channel_idx))"]


@query("normalize_forward", V.with_(*_NORM, select="SELECT channel_idx, t, round(z, 6) AS z FROM nz"))
def normalize_forward(spark, d):
    return _normalised(spark, d).select("channel_idx", "t", r6("z"))


@query("normalize_roundtrip", V.with_(*_NORM, select="SELECT channel_idx, t, round(y, 6) AS back FROM nz"))
def normalize_roundtrip(spark, d):
    return _normalised(spark, d).select("channel_idx", "t", F.round(S.inverse("z", "a", "sigma"), 6).alias("back"))


@query("clamped_inverse", V.with_(*_NORM, select="SELECT channel_idx, t, round(sinh(greatest(-10, least(10, 20 * z))) * sigma + a, 2) AS back FROM nz"))
def clamped_inverse(spark, d):
    return _normalised(spark, d).select("channel_idx", "t", F.round(S.inverse(S.clamp(F.col("z") * 20), "a", "sigma"), 2).alias("back"))


@query(
    "aux_target_local",
    V.with_(*_NORM, select="SELECT b.channel_idx, b.t, round(asinh((b.y - a.y) / a.sigma), 6) AS target FROM nz a JOIN nz b ON a.channel_idx = b.channel_idx AND b.t = a.t + 4 WHERE a.y IS NOT NULL AND b.y IS NOT NULL"),
)
def aux_target_local(spark, d):
    rows = _normalised(spark, d)
    level = F.lag("y", 4).over(fc.Window.partitionBy(*fc.KEYS).orderBy("t"))
    return rows.withColumn("target", S.asinh((F.col("y") - level) / F.col("sigma"))).where("target is not null").select("channel_idx", "t", r6("target"))


@query("standardize", V.with_("ev_user_daily", select="SELECT series_id, t, round(CASE WHEN sd > 1e-12 THEN (y - mu) / sd ELSE y - mu END, 6) AS z FROM (SELECT *, avg(y) OVER w AS mu, stddev_pop(y) OVER w AS sd FROM ev_user_daily WINDOW w AS (PARTITION BY series_id))"))
def standardize(spark, d):
    return st.standardise(src.ev_user_daily(spark, d)).select("series_id", "t", r6("z"))


@query("fourier_features", V.with_(*_NORM, select="SELECT channel_idx, t, k::INT AS k, round(CASE WHEN k < 16 THEN sin(z * f) ELSE cos(z * f) END, 6) AS value FROM (SELECT *, 0.25 * pow(256, (k % 16) / 15.0) AS f FROM nz CROSS JOIN (SELECT unnest(range(32)) AS k) WHERE z IS NOT NULL)"))
def fourier_features(spark, d):
    rows = _normalised(spark, d).where("z is not null")
    return rows.select("channel_idx", "t", F.posexplode(S.fourier("z", 0.25, 64.0, 16)).alias("k", "value")).select("channel_idx", "t", "k", r6("value"))


@query("time_features", "SELECT t::BIGINT AS t, k::INT AS k, round(CASE WHEN k < 32 THEN sin(t * f) ELSE cos(t * f) END, 6) AS value FROM (SELECT t, k, 0.001::DOUBLE * pow(1000, (k % 32) / 31.0) AS f FROM (SELECT unnest(range(720)) AS t) CROSS JOIN (SELECT unnest(range(64)) AS k))")
def time_features(spark, d):
    """The 32 frequencies of time, over every hour of the month."""
    return spark.range(720).select(F.col("id").alias("t")).select("t", F.posexplode(S.fourier("t", 1e-3, 1.0, 32)).alias("k", "value")).select("t", "k", r6("value"))


@query("masked_mae", V.with_(*_parts("ev_hourly", EV, False), select="SELECT l.channel_idx, round(sum(CASE WHEN l.y IS NOT NULL THEN abs(fc.yhat - l.y) ELSE 0 END) / greatest(count(l.y), 1), 6) AS mae FROM ev_hourly l JOIN fc ON fc.channel_idx = l.channel_idx AND fc.h = l.t - 672 WHERE l.t >= 672 GROUP BY ALL"))
def masked_mae(spark, d):
    from tidegrid.operators import losses

    points = src.ev_hourly(spark, d)
    rows = src.labels(points, EV).join(fc.seasonal_naive(src.context(points, EV), EV.p, EV.season), [*fc.KEYS, "h"])
    return rows.groupBy("channel_idx").agg(F.round(losses.masked_mae(F.col("yhat") - F.col("y"), F.col("y").isNotNull()), 6).alias("mae"))
