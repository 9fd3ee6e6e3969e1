"""Queries: multivariate cases, mixtures and their splits, with the same draws in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import cases as cs
from tidegrid.operators import generators as g

from . import generator_queries as gq

QUERIES, ORACLE = {}, {}
SERIES, N, HORIZON = 8, 96, 24
u, z, TWO_PI = gq.u, gq.z, gq.TWO_PI


def query(name: str, oracle: str | None = None):
    def add(f):
        def run(spark, d):
            out = f(spark)
            return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def between(lo, hi, *key: str) -> str:
    return f"({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {u(*key)})"


def period(*key: str) -> str:
    return f"([6, 8, 12, 24])[floor({u(*key, 'period')} * 4)::INT + 1]"


def sine(season: str, noise: str, *key: str) -> str:
    eps = f" + {noise} * {z(*key, '{t}', 'eps')}" if noise else ""
    return f"({between(-10, 10, *key, 'offset')} + {between(1, 5, *key, 'amp')} * (sin({TWO_PI} * t / {season} + {between(0, TWO_PI, *key, 'phase')}){eps}))"


def channels(least: int, most: int, n: int = SERIES) -> str:
    return f"chn AS (SELECT idx, unnest(range({least} + floor({u('{idx}', 'channels')} * {most - least + 1})::BIGINT)) AS channel FROM (SELECT unnest(range({n})) AS idx))"


TS = f"(SELECT unnest(range({N})) AS t)"
_IND = f"ind AS (SELECT idx, channel, season, t, {sine('season', '0.1::DOUBLE', '{idx}', '{channel}')} AS y FROM (SELECT *, {period('{idx}', '{channel}')} AS season FROM chn) CROSS JOIN {TS})"
_ROWS = "idx::BIGINT AS idx, channel::BIGINT AS channel, season::INT AS season, t::BIGINT AS t, round(y, 6) AS y"


@query("case_sine_univariate", f"WITH {channels(1, 1)}, {_IND} SELECT {_ROWS} FROM ind")
def case_sine_univariate(spark):
    return cs.independent_sines(spark, SERIES, N)


@query("case_multivariate_independent", f"WITH {channels(2, 4)}, {_IND} SELECT {_ROWS} FROM ind")
def case_multivariate_independent(spark):
    return cs.independent_sines(spark, SERIES, N, 2, 4)


def loadings(bank: int, least: int, most: int) -> str:
    key = ("{idx}", "{channel}", "{factor}")
    return f"""ld AS (SELECT idx, channel, factor, CASE WHEN {u(*key, 'sign')} < 0.5 THEN -1 ELSE 1 END * {between(0.5, 1.5, *key, 'weight')} AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY idx, channel ORDER BY {u(*key, 'pick')}, factor) AS place FROM chn CROSS JOIN (SELECT unnest(range({bank})) AS factor))
  WHERE place <= {least} + floor({u('{idx}', '{channel}', 'reads')} * {most - least + 1}))"""


_SHARED = f"""{channels(2, 4)}, {loadings(4, 1, 4)}, rd AS (SELECT *, {period('{idx}', '{factor}', 'factor')} AS fs FROM ld),
ss AS (SELECT idx, channel, arg_max(fs, abs(weight)) AS season FROM rd GROUP BY ALL),
mx AS (SELECT idx, channel, t, sum(weight * {sine('fs', '', '{idx}', '{factor}', 'factor')}) AS m FROM rd CROSS JOIN {TS} GROUP BY ALL),
sh AS (SELECT idx, channel, season, t, exp({between(-1, 1, '{idx}', '{channel}', 'scale')}) * (m / sd + 0.1::DOUBLE * {z('{idx}', '{channel}', '{t}', 'eps')}) + {between(-10, 10, '{idx}', '{channel}', 'offset')} AS y
  FROM (SELECT *, stddev_pop(m) OVER (PARTITION BY idx, channel) + 1e-9 AS sd FROM mx) JOIN ss USING (idx, channel))"""


@query("case_shared_sines", f"WITH {_SHARED} SELECT {_ROWS} FROM sh")
def case_shared_sines(spark):
    return cs.shared_sines(spark, SERIES, N)


@query("dominant_factor", f"WITH {_SHARED} SELECT idx::BIGINT AS idx, channel::BIGINT AS channel, season::INT AS season FROM ss")
def dominant_factor(spark):
    return cs.shared_sines(spark, SERIES, N).select("idx", "channel", "season").distinct()


@query(
    "case_features_target",
    f"""WITH s AS (SELECT *, 1 + floor({u('{idx}', 'lag')} * least(season, {N // 4}))::BIGINT AS lag FROM (SELECT idx, {period('{idx}', 'feature')} AS season FROM (SELECT unnest(range({SERIES})) AS idx))),
f AS (SELECT idx, season, lag, t, {sine('season', '0.1::DOUBLE', '{idx}', 'feature')} AS feature FROM s CROSS JOIN {TS}),
w AS (SELECT *, stddev_pop(feature) OVER (PARTITION BY idx) AS sd, {z('{idx}', '{t}', 'eps')} AS e FROM f)
SELECT a.idx::BIGINT AS idx, a.season::INT AS season, a.lag::BIGINT AS lag, a.t::BIGINT AS t, round(a.feature, 6) AS feature, round(b.feature + 0.1::DOUBLE * a.sd * a.e, 6) AS y
FROM w a JOIN f b ON b.idx = a.idx AND b.t = greatest(a.t - a.lag, 0)""",
)
def case_features_target(spark):
    return cs.features_target(spark, SERIES, N)


def primitives(series: int) -> str:
    """idx, t, kind, y of the eight kinds, from the queries of each."""
    made = ("gen_linear", "gen_exponential", "gen_sines", "gen_ar", "gen_intermittent", "gen_random_walk", "gen_geometric_walk", "gen_regime_jump")
    parts = [
        f"SELECT idx, t, '{kind}' AS kind, y FROM ({gq.ORACLE[name].replace(f'range({gq.SERIES})', f'range({series})').replace('round(', '(').replace(', 6)', ')')}) WHERE floor({u('{idx}', 'kind')} * 8) = {k}"
        for k, (kind, name) in enumerate(zip(cs.PRIMITIVES, made))
    ]
    return "pr AS (" + " UNION ALL ".join(parts) + ")"


@query("gen_primitive", f"WITH {primitives(40)} SELECT idx, t, kind, round(y, 6) AS y FROM pr")
def gen_primitive(spark):
    return cs.primitives(g.grid(spark, 40, gq.N), gq.N)


@query(
    "gen_shared_factors",
    f"""WITH {primitives(6 * 7)}, fc AS (SELECT idx // 7 AS idx, idx % 7 AS factor, t, CASE WHEN sd > 1e-12 THEN (y - mu) / sd ELSE y - mu END AS f FROM (SELECT *, avg(y) OVER w AS mu, stddev_pop(y) OVER w AS sd FROM pr WINDOW w AS (PARTITION BY idx))),
{channels(2, 4, 6)}, {loadings(7, 3, 4)},
lg AS (SELECT *, CASE WHEN {u('{idx}', '{channel}', '{factor}', 'late')} < 0.3::DOUBLE THEN 1 + floor({u('{idx}', '{channel}', '{factor}', 'lag')} * 20)::BIGINT ELSE 0 END AS lag FROM ld),
mx AS (SELECT lg.idx, channel, g.t, sum(weight * f) AS m FROM lg CROSS JOIN {TS} g JOIN fc ON fc.idx = lg.idx AND fc.factor = lg.factor AND fc.t = greatest(g.t - lag, 0) GROUP BY ALL)
SELECT idx::BIGINT AS idx, channel::BIGINT AS channel, t::BIGINT AS t, round(exp({between(-2, 2, '{idx}', '{channel}', 'scale')}) * ((m - mu) / (sd + 1e-9) + 0.3::DOUBLE * {z('{idx}', '{channel}', '{t}', 'eps')}) + {between(-100, 100, '{idx}', '{channel}', 'offset')}, 6) AS y
FROM (SELECT *, avg(m) OVER w AS mu, stddev_pop(m) OVER w AS sd FROM mx WINDOW w AS (PARTITION BY idx, channel))""",
)
def gen_shared_factors(spark):
    return cs.shared_factors(spark, 6, N)


_TAG = "tg AS (SELECT idx, 'sanity/multivariate_independent/m' || CASE WHEN count(DISTINCT season) = 1 THEN min(season)::VARCHAR ELSE string_agg(season::VARCHAR, 'x' ORDER BY channel) END || '/series_' || idx AS config_id FROM (SELECT DISTINCT idx, channel, season FROM ind) GROUP BY idx)"


@query(
    "sanity_eval_shard",
    f"WITH {channels(2, 4)}, {_IND}, {_TAG} SELECT config_id, channel::BIGINT AS channel, CASE WHEN t < {N - HORIZON} THEN 'context' ELSE 'label' END AS part, CASE WHEN t >= {N - HORIZON} THEN (t - {N - HORIZON})::BIGINT END AS h, t::BIGINT AS t, round(y, 6) AS y FROM ind JOIN tg USING (idx)",
)
def sanity_eval_shard(spark):
    rows = cs.held_out(cs.independent_sines(spark, SERIES, N, 2, 4), N, HORIZON, "multivariate_independent")
    return rows.select("config_id", "channel", "part", "h", "t", "y")


@query(
    "sanity_train_stream",
    f"WITH {channels(2, 4)}, {_IND} SELECT e::BIGINT AS epoch, {_ROWS} FROM ind CROSS JOIN (SELECT unnest(range(2)) AS e) WHERE t < {N - HORIZON} AND idx % 3 = 1",
)
def sanity_train_stream(spark):
    return cs.training_stream(cs.independent_sines(spark, SERIES, N, 2, 4), N, HORIZON, 2, 3, 1)


@query("pretraining_corpus")
def pretraining_corpus(spark):
    return cs.corpus(spark, 30, (64, 160))


_LEN = f"(64 + floor({u('{idx}', 'length')} * 97)::BIGINT)"
_KIND = f"CASE WHEN {u('{idx}', 'mixture')} < 0.5 THEN 'shared_factor' WHEN {u('{idx}', 'mixture')} < 0.9::DOUBLE THEN 'univariate' ELSE 'lag_probe' END"
_WIDE = f"(2 + floor({u('{idx}', 'channels')} * 3)::BIGINT)"


@query(
    "pretraining_corpus_shape",
    f"""SELECT idx::BIGINT AS idx, kind, CASE kind WHEN 'shared_factor' THEN {_WIDE} WHEN 'lag_probe' THEN 2 ELSE 1 END::BIGINT AS n_channels, CASE kind WHEN 'lag_probe' THEN 1 ELSE 0 END::BIGINT AS n_features, {_LEN} AS length, {u('{idx}', 'gaps')} < 0.5 AS may_have_gaps, true AS gaps_in_bounds
FROM (SELECT idx, {_KIND} AS kind FROM (SELECT unnest(range(30)) AS idx))""",
)
def pretraining_corpus_shape(spark):
    rows = cs.corpus(spark, 30, (64, 160))
    made = rows.groupBy("idx", "kind").agg(
        F.countDistinct("channel").alias("n_channels"),
        F.countDistinct(F.when(F.col("role") == "feature", F.col("channel"))).alias("n_features"),
        F.countDistinct("t").alias("length"),
        F.avg(F.col("y").isNull().cast("int")).alias("gaps"),
    )
    may = cs.uniform("0", F.col("idx"), "gaps") < 0.5
    return made.select("idx", "kind", "n_channels", "n_features", "length", may.alias("may_have_gaps"), F.when(may, F.col("gaps") < 0.4).otherwise(F.col("gaps") == 0).alias("gaps_in_bounds"))
