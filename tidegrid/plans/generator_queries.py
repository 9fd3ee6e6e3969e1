"""Queries: synthetic generators, with the same draws in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import generators as g

QUERIES, ORACLE = {}, {}
SERIES, N = 6, 96
TWO_PI = "6.283185307179586::DOUBLE"


def u(*key: str) -> str:
    """Uniform of a key; parts in braces are columns."""
    text = " || ':' || ".join(f"{k[1:-1]}::VARCHAR" if k.startswith("{") else f"'{k}'" for k in ("0", *key))
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def z(*key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u(*key, 'n1')})) * cos({TWO_PI} * {u(*key, 'n2')}))"


def par(lo, hi, name: str) -> str:
    return f"({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {u('{idx}', name)})"


EPS = z("{idx}", "{t}", "eps")
GRID = f"g AS (SELECT idx, t FROM (SELECT unnest(range({SERIES})) AS idx) CROSS JOIN (SELECT unnest(range({N})) AS t))"
WALK = f"wk AS (SELECT idx, t, sum({EPS}) OVER (PARTITION BY idx ORDER BY t) AS y FROM g)"


def query(name: str, oracle: str | None = None):
    def add(f):
        def run(spark, d):
            out = f(g.grid(spark, SERIES, N))
            return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def plain(expression: str) -> str:
    return f"WITH {GRID} SELECT idx::BIGINT AS idx, t::BIGINT AS t, round({expression}, 6) AS y FROM g"


query("gen_linear", plain(f"{par(-1, 1, 'slope')} * t + {par(-100, 100, 'offset')} + {EPS}"))(g.linear)
query("gen_exponential", plain(f"exp({par(-0.01, 0.01, 'rate')} * t) * {par(1, 10, 'scale')}"))(g.exponential)
_SINES = " + ".join(f"CASE WHEN 1 + floor({u('{idx}', 'k')} * 3) > {j} THEN {par(0.5, 2, f'a{j}')} * sin({TWO_PI} * t / {par(6, 48, f'p{j}')} + {par(0, TWO_PI, f'f{j}')}) ELSE 0 END" for j in range(3))
query("gen_sines", plain(_SINES))(g.sines)
query("gen_intermittent", plain(f"CASE WHEN {u('{idx}', '{t}', 'hit')} < 0.1::DOUBLE THEN 1 + 9 * {u('{idx}', '{t}', 'size')} ELSE 0 END"))(g.intermittent)
query("gen_random_walk", f"WITH {GRID}, {WALK} SELECT idx::BIGINT AS idx, t::BIGINT AS t, round(y, 6) AS y FROM wk")(g.random_walk)
query("gen_geometric_walk", f"WITH {GRID} SELECT idx::BIGINT AS idx, t::BIGINT AS t, round(100 * exp(sum(0.0005::DOUBLE + 0.02::DOUBLE * {EPS}) OVER (PARTITION BY idx ORDER BY t)), 6) AS y FROM g")(g.geometric_walk)
query("gen_regime_jump", f"WITH {GRID}, {WALK} SELECT idx::BIGINT AS idx, t::BIGINT AS t, round(y + CASE WHEN t >= floor({N} * {par(0.3, 0.7, 'cut')}) THEN {par(-50, 50, 'jump')} ELSE 0 END, 6) AS y FROM wk")(lambda x: g.regime_jump(x, N))
query(
    "gen_ar",
    f"""WITH RECURSIVE {GRID}, cf AS (SELECT idx, t, {EPS} AS e, {par(-1, 1, 'c1')} AS a, {par(-1, 1, 'c2')} AS b FROM g),
r AS (SELECT idx, t, e AS y, 0::DOUBLE AS p FROM cf WHERE t = 0
  UNION ALL SELECT r.idx, r.t + 1, cf.a * least(1, 0.95::DOUBLE / greatest(abs(cf.a) + abs(cf.b), 1e-9)) * r.y + cf.b * least(1, 0.95::DOUBLE / greatest(abs(cf.a) + abs(cf.b), 1e-9)) * r.p + cf.e, r.y FROM r JOIN cf ON cf.idx = r.idx AND cf.t = r.t + 1)
SELECT idx::BIGINT AS idx, t::BIGINT AS t, round(y, 6) AS y FROM r""",
)(g.autoregressive)
query(
    "gen_lag_probe",
    f"WITH {GRID}, f AS (SELECT idx, t, {z('{idx}', '{t}', 'feature')} AS feature FROM g) SELECT a.idx::BIGINT AS idx, a.t::BIGINT AS t, round(a.feature, 6) AS feature, round(b.feature + 0.1::DOUBLE * {EPS.replace('idx', 'a.idx').replace('t::', 'a.t::')}, 6) AS y FROM f a JOIN f b ON b.idx = a.idx AND b.t = greatest(a.t - 5, 0)",
)(g.lag_probe)
query("gen_sanity_sine", plain(f"{par(-10, 10, 'level')} + {par(1, 5, 'amp')} * (sin({TWO_PI} * t / 24 + {par(0, TWO_PI, 'phase')}) + 0.1::DOUBLE * {EPS})"))(g.sanity_sine)
query(
    "gen_shared_factor",
    f"""WITH {GRID} SELECT idx::BIGINT AS idx, t::BIGINT AS t, ch::INT AS channel, round(sum((2 * {u('{idx}', '{ch}', '{f}', 'w')} - 1) * sin({TWO_PI} * t / (6 + 6 * f) + {TWO_PI} * {u('{idx}', '{f}', 'phase')})), 6) AS y
FROM g CROSS JOIN (SELECT unnest(range(4)) AS f) CROSS JOIN (SELECT unnest(range(3)) AS ch) GROUP BY ALL""",
)(g.shared_factor)
_STD = "st AS (SELECT idx, t, CASE WHEN stddev_pop(y) OVER (PARTITION BY idx) > 1e-12 THEN (y - avg(y) OVER (PARTITION BY idx)) / stddev_pop(y) OVER (PARTITION BY idx) ELSE y - avg(y) OVER (PARTITION BY idx) END AS feature FROM wk)"
query("gen_kff_driver", f"WITH {GRID}, {WALK}, {_STD} SELECT idx::BIGINT AS idx, t::BIGINT AS t, round(feature, 6) AS feature, round(0.3::DOUBLE * sin({TWO_PI} * t / 24) + 0.7::DOUBLE * feature, 6) AS y FROM st")(g.kff_driver)
_GAP = f"{u('{idx}', '{t}', 'gap')} < 0.3::DOUBLE * {u('{idx}', 'share')} OR ({u('{idx}', 'run')} < 0.2::DOUBLE AND t >= floor({N} * {u('{idx}', 'start')}) AND t < floor({N} * {u('{idx}', 'start')}) + 1 + floor({N} / 8.0::DOUBLE * {u('{idx}', 'length')}))"
query("inject_nans", f"WITH {GRID}, {WALK} SELECT idx::BIGINT AS idx, t::BIGINT AS t, CASE WHEN {_GAP} THEN NULL ELSE round(y, 6) END AS y FROM wk")(lambda x: g.with_gaps(g.random_walk(x), N))
query("case_mix", f"WITH {GRID} SELECT DISTINCT idx::BIGINT AS idx, (['sine', 'walk', 'kff'])[idx % 3 + 1] AS name FROM g")(lambda x: x.select("idx", g.case_of(F.col("idx"), ["sine", "walk", "kff"]).alias("name")).distinct())
