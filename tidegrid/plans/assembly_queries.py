"""Queries: assembled segments, packed buffers, schedules of windows, samples and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import text as tx
from tidegrid.operators import assembly as asm
from tidegrid.operators import network as nw
from tidegrid.operators import packing as pk
from tidegrid.operators import scoring as sc
from tidegrid.sources import series as src
from tidegrid.sources.durable import written

from . import segment_queries as sq
from . import views_sql as V
from .scoring_queries import _ANCHOR, _NORM, EV, _normalised, _sigma_sql, r6

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# --- segments ------------------------------------------------------------------------------

_STATS = "SELECT * FROM (WITH cx AS (SELECT p.* FROM ev_hourly p JOIN seg ON seg.segment_id = {o} WHERE p.t < origin AND p.t >= origin - cov), " + _sigma_sql("cx") + ", " + _ANCHOR.format("cx") + " SELECT {o} AS segment_id, channel_idx, a, sigma FROM sg JOIN an USING (series_id, channel_idx))"
_CSTATS = "cst AS (" + " UNION ALL ".join(_STATS.replace("{o}", str(o)) for o in sq.ORIGINS) + ")"
_HEAD = f"WITH RECURSIVE {V.VIEWS['ev_hourly']}, {sq._SEG}, {_CSTATS}"


def _assembled(spark, d):
    points, segments = written(src.ev_hourly(spark, d), "points"), sq._segments(spark, d)
    return points, segments, written(asm.context_stats(segments, points), "stats")


@query("context_stats", f"{_HEAD} SELECT segment_id::BIGINT AS segment_id, channel_idx, round(a, 6) AS a, round(sigma, 6) AS sigma FROM cst")
def context_stats(spark, d):
    return _assembled(spark, d)[2].select("segment_id", "channel_idx", r6("a"), r6("sigma"))


_STORE = """sto AS (SELECT g.segment_id, s.channel_idx, g.o, coalesce(asinh((p.y - s.a) / s.sigma), 0) AS z, p.y IS NOT NULL AS observed
  FROM (SELECT segment_id, origin, cov, unnest(range(cov)) AS o FROM seg) g JOIN cst s ON s.segment_id = g.segment_id LEFT JOIN ev_hourly p ON p.channel_idx = s.channel_idx AND p.t = g.origin - g.cov + g.o)"""


@query(
    "token_patches",
    f"""{_HEAD}, {sq._DISPATCH}, {_STORE}, chn AS (SELECT unnest(range(5)) AS ch)
SELECT dp.segment_id::BIGINT AS segment_id, ch::INT AS channel_idx, (ch * n_eff + greatest(ch - 2, 0) * 3 + pos)::BIGINT AS pos, dp.p::BIGINT AS width, round(coalesce(sum(z), 0), 6) AS z_sum, count_if(observed)::BIGINT AS n_observed
FROM dp JOIN seg USING (segment_id) CROSS JOIN chn LEFT JOIN sto ON sto.segment_id = dp.segment_id AND sto.channel_idx = ch AND sto.o >= raw_start - seg.origin + cov AND sto.o < raw_end - seg.origin + cov GROUP BY ALL""",
)
def token_patches(spark, d):
    points, segments, stats = _assembled(spark, d)
    rows = asm.patches(sq._token_table(spark, d), segments, asm.store(segments, points, stats))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    return rows.select("segment_id", "channel_idx", F.col("pos").cast("long").alias("pos"), F.size("z").cast("long").alias("width"), F.round(total, 6).alias("z_sum"), F.size(F.filter("observed", lambda x: x)).cast("long").alias("n_observed"))


@query(
    "segment_targets",
    f"""{_HEAD} SELECT seg.segment_id::BIGINT AS segment_id, s.channel_idx, (h // 16)::BIGINT AS j, (h % 16)::BIGINT AS i, round(coalesce(asinh((p.y - s.a) / s.sigma), 0), 6) AS target, p.y IS NOT NULL AS valid
FROM seg CROSS JOIN (SELECT unnest(range(48)) AS h) JOIN cst s ON s.segment_id = seg.segment_id LEFT JOIN ev_hourly p ON p.channel_idx = s.channel_idx AND p.t = origin + h""",
)
def segment_targets(spark, d):
    points, segments, stats = _assembled(spark, d)
    return asm.targets(segments, points, stats, 16).select("segment_id", "channel_idx", F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), r6("target"), "valid")


@query("global_target", V.with_(*_NORM, select="SELECT channel_idx, (t - 672)::BIGINT AS h, round(z, 6) AS target FROM nz WHERE t >= 672 AND t < 720 AND channel_idx >= 2 AND y IS NOT NULL"))
def global_target(spark, d):
    """Labels in the space of the context's own normalisation, not anchored anew."""
    rows = _normalised(spark, d).where(f"t >= {EV.origin} and t < {EV.origin + EV.p} and channel_idx >= 2 and y is not null")
    return rows.select("channel_idx", (F.col("t") - EV.origin).alias("h"), F.round("z", 6).alias("target"))


def _network_tokens(spark, d):
    points, segments, stats = _assembled(spark, d)
    tokens = written(sq._token_table(spark, d), "tokens")
    return written(nw.segment_tokens(tokens, asm.patches(tokens, segments, asm.store(segments, points, stats)), stats), "network")


@query("network_shapes", f"""WITH RECURSIVE {sq._tokens_sql(False)} SELECT segment_id::BIGINT AS segment_id, pos::BIGINT AS slot, CASE WHEN role = 1 THEN 16 END::BIGINT AS horizon, CASE WHEN role = 0 THEN ([4, 8, 16, 64, 256, 512])[tier + 1] END::BIGINT AS aux, true AS finite FROM tok""")
def network_shapes(spark, d):
    """What every token of every segment predicts: a horizon for query tokens, the next patch for the others."""
    rows = nw.outputs(_network_tokens(spark, d), nw.Network(), "segment_id")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(c)
    finite = F.forall(F.coalesce("horizon", "aux"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("segment_id", "slot", size("horizon"), size("aux"), finite.alias("finite"))


@query("network_forecast")
def network_forecast(spark, d):
    rows = nw.forecast(_network_tokens(spark, d), nw.Network())
    steps = rows.select("segment_id", "channel_idx", "j", F.posexplode("values").alias("i", "yhat"))
    return steps.select("segment_id", "channel_idx", (F.col("j") * 16 + F.col("i")).alias("h"), r6("yhat"))


# --- buffers -------------------------------------------------------------------------------

_PACKED = f"""WITH {sq._BUF}, pl AS (SELECT *, coalesce(sum(size) OVER w, 0) AS tb, coalesce(sum(store) OVER w, 0) AS sb, row_number() OVER (PARTITION BY buffer_id ORDER BY seq) - 1 AS sample
  FROM buf WINDOW w AS (PARTITION BY buffer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
us AS (SELECT buffer_id, sum(size) AS used FROM buf GROUP BY ALL)"""


@query(
    "packed_buffers",
    f"""{_PACKED} SELECT buffer_id::BIGINT AS buffer_id, (tb + i)::BIGINT AS slot, item, sample::BIGINT AS sample, sample::BIGINT AS variate, sb::BIGINT AS store_begin, 0::INT AS content_state FROM (SELECT *, unnest(range(size)) AS i FROM pl)
UNION ALL SELECT buffer_id::BIGINT, unnest(range(used::BIGINT, {sq._ROOM})), NULL, -1, NULL, NULL, 2 FROM us""",
)
def packed_buffers(spark, d):
    return asm.packed(sq._buffers(spark, d), sq._ROOM).drop("sigma")


@query("eval_batch", f"WITH {sq._ITEMS} SELECT item AS buffer_id, count(*)::BIGINT AS slots, size AS used, size * 4 AS store FROM (SELECT *, unnest(range(256)) AS slot FROM items) GROUP BY item, size")
def eval_batch(spark, d):
    items = src.doc_lengths(spark, d).withColumns({"c": F.lit(1).cast("long"), "store": F.col("size") * 4})
    rows = asm.eval_batches(items, 256).groupBy("buffer_id").agg(F.count("*").alias("slots"), F.count_if(F.col("sample") >= 0).alias("used"))
    return rows.join(items.select(F.col("item").alias("buffer_id"), "store"), "buffer_id")


@query("buffer_fill", f"WITH {sq._BUF} SELECT buffer_id::BIGINT AS buffer_id, round(sum(size) / {sq._ROOM}.0::DOUBLE, 6) AS fill, ({sq._ROOM} - sum(size))::BIGINT AS waste, sum(store)::BIGINT AS store FROM buf GROUP BY ALL")
def buffer_fill(spark, d):
    return asm.fill(sq._buffers(spark, d), sq._ROOM).select("buffer_id", r6("fill"), "waste", "store")


@query("max_store_width", f"WITH {sq._BUF} SELECT max(s)::BIGINT AS width FROM (SELECT sum(store) AS s FROM buf GROUP BY buffer_id)")
def max_store_width(spark, d):
    return asm.fill(sq._buffers(spark, d), sq._ROOM).agg(F.max("store").alias("width"))


@query("store_concat", f"WITH {sq._BUF} SELECT buffer_id::BIGINT AS buffer_id, string_agg(item || ':' || k, ',' ORDER BY seq, k) AS store FROM (SELECT *, unnest(range(least(size, 3))) AS k FROM buf) GROUP BY ALL")
def store_concat(spark, d):
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(3)) - 1), lambda k: F.concat_ws(":", "item", k))
    rows = asm.concatenated(sq._buffers(spark, d).withColumn("cells", cells), ["buffer_id"], ["seq"], "cells")
    return rows.select("buffer_id", F.array_join("values", ",").alias("store"))


@query("scatter_to_slots", f"{_PACKED}, sl AS (SELECT buffer_id, tb + i AS slot, i FROM (SELECT *, unnest(range(size)) AS i FROM pl)) SELECT buffer_id::BIGINT AS buffer_id, slot::BIGINT AS slot, CASE WHEN i % 3 = 0 THEN 1.5 * i ELSE 0 END::DOUBLE AS value FROM sl")
def scatter_to_slots(spark, d):
    """Two parts of a value come to every third token's slot, nothing to the others."""
    placed = asm.tk.pack_offsets(sq._buffers(spark, d)).select("buffer_id", "token_base", asm.steps(F.col("size")).alias("i"))
    slots = placed.select("buffer_id", (F.col("token_base") + F.col("i")).alias("slot"))
    third = placed.where("i % 3 = 0").select("buffer_id", (F.col("token_base") + F.col("i")).alias("slot"), F.explode(F.array(F.col("i") * 1.0, F.col("i") * 0.5)).alias("value"))
    return asm.scatter_add(slots, third, ["buffer_id", "slot"], "value")


@query("window_schedule", f"WITH {sq._BUF}, c AS (SELECT buffer_id, sum(size * size) / 2.0::DOUBLE AS cost FROM buf GROUP BY ALL) SELECT buffer_id::BIGINT AS buffer_id, w::BIGINT AS round, place, place // 2 AS step FROM (SELECT *, buffer_id // 8 AS w, row_number() OVER (PARTITION BY buffer_id // 8 ORDER BY cost, buffer_id) - 1 AS place FROM c)")
def window_schedule(spark, d):
    """Rounds of eight buffers; within each, by cost, two to a step."""
    costs = pk.buffer_costs(sq._buffers(spark, d)).withColumn("round", F.floor(F.col("buffer_id") / 8))
    return pk.schedule(costs, 2, "round").select("buffer_id", "round", "place", "step")


# --- samples and texts ---------------------------------------------------------------------


@query("keyed_sample", "SELECT user_id::BIGINT AS user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('7:' || user_id), user_id LIMIT 12")
def keyed_sample(spark, d):
    """Twelve users without replacement: a sample is the feature."""
    return sc.keyed_sample(src.read(spark, d, "events").select("user_id").distinct(), "user_id", 12, "7").select(F.col("user_id").cast("long").alias("user_id"))


@query("item_counts", V.with_("emb_series", select="SELECT config_id, count(DISTINCT series_id)::BIGINT AS n_items, count(DISTINCT (series_id, channel_idx))::BIGINT AS n_channels, count(y)::BIGINT AS n_values FROM emb_series GROUP BY ALL"))
def item_counts(spark, d):
    return sc.item_counts(src.emb_series(spark, d))


_LINES = ["# a comment", "", "KEY=value", "  SPACED = \"quoted value\"  ", "EMPTY=", "no equals sign", "QUOTED='single'", "=nokey", "KEY=second", "URL=a=b=c"]


@query(
    "dotenv_lines",
    "SELECT * FROM (VALUES ('KEY', 'value'), ('SPACED', 'quoted value'), ('EMPTY', ''), ('QUOTED', 'single'), ('URL', 'a=b=c')) v(key, value)",
)
def dotenv_lines(spark, d):
    return tx.dotenv(spark.createDataFrame(list(enumerate(_LINES)), "line_no int, line string"))


@query(
    "duration_text",
    "SELECT s::DOUBLE AS seconds, CASE WHEN s < 60 THEN printf('%.1fs', s::DOUBLE) WHEN s >= 3600 THEN printf('%dh%02dm%02ds', (s // 3600)::INT, (s % 3600 // 60)::INT, (s % 60)::INT) ELSE printf('%dm%02ds', (s // 60)::INT, (s % 60)::INT) END AS text FROM (SELECT unnest(range(0, 20000, 59)) AS s)",
)
def duration_text(spark, d):
    return spark.range(0, 20000, 59).select(F.col("id").cast("double").alias("seconds")).withColumn("text", tx.duration("seconds"))


@query("config_names", "SELECT s || '/' || term AS config_id FROM (SELECT DISTINCT c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey) CROSS JOIN (SELECT unnest(['short', 'medium', 'long']) AS term)")
def config_names(spark, d):
    meta = src.ord_segment(spark, d).select(F.col("series_id").alias("name")).distinct()
    return meta.select("name", F.explode(F.array(*[F.lit(t) for t in sq.TERMS])).alias("term")).select(tx.config_id("name", "term").alias("config_id"))
