"""Queries: tiers, segments, tokens, masks, packing, splits and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import scalar as S
from tidegrid.operators import packing as pk
from tidegrid.operators import segments as sg
from tidegrid.operators import stats as st
from tidegrid.operators import telescope as ts
from tidegrid.operators import tokens as tk
from tidegrid.sources import series as src
from tidegrid.sources.durable import written

from . import views_sql as V
from .scoring_queries import _ANCHOR, _sigma_sql, r6

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# Oracle parts: default counts of every n, their coverage, and the moves of an allocation one by one.
_TIER = "tier AS (SELECT * FROM (VALUES (0, 2, 4), (1, 2, 8), (2, 2, 16), (3, 2, 64), (4, 2, 256), (5, 1, 512)) v(k, w, p))"
_DEFAULT = """dc AS (SELECT n, k, p, (n * w) // 11 + CASE WHEN row_number() OVER (PARTITION BY n ORDER BY (n * w) % 11 DESC, k) <= n - sum((n * w) // 11) OVER (PARTITION BY n) THEN 1 ELSE 0 END AS c
  FROM (SELECT unnest(range(1, 513)) AS n) CROSS JOIN tier),
cv AS (SELECT n, list(c ORDER BY k) AS counts, sum(c * p)::BIGINT AS cov FROM dc GROUP BY n)"""
_SHIFT = "list_transform(range(6), lambda k: c[k + 1] - CASE WHEN k = {s} THEN 1 ELSE 0 END + CASE WHEN k = {d} THEN 1 ELSE 0 END)"
_ALLOCATE = f"""mv AS (
  SELECT id, n, t, counts AS c, cov, false AS done, 0 AS step FROM {{0}} JOIN cv USING (n)
  UNION ALL
  SELECT id, n, t, CASE WHEN good THEN nc ELSE c END, CASE WHEN good THEN ncov ELSE cov END, NOT good OR ncov = t OR (ncov > t) <> (cov > t), step + 1
  FROM (SELECT *, abs(ncov - t) <= abs(cov - t) AND NOT (cov > t AND src = 5 AND cov - t = t - ncov) AS good FROM (
    SELECT *, cov + ([4, 8, 16, 64, 256, 512])[dst + 1] - ([4, 8, 16, 64, 256, 512])[src + 1] AS ncov, {_SHIFT.format(s="src", d="dst")} AS nc FROM (
      SELECT *, CASE WHEN cov > t THEN 0 ELSE 5 END AS dst,
        CASE WHEN cov > t THEN list_max(list_filter(range(1, 6), lambda k: c[k + 1] > 0)) ELSE list_min(list_filter(range(0, 5), lambda k: c[k + 1] > 0)) END AS src
      FROM mv WHERE NOT done AND cov <> t) WHERE src IS NOT NULL))),
al AS (SELECT id, arg_max(c, step) AS counts FROM mv GROUP BY id)"""


@query("default_counts", f"WITH {_TIER}, {_DEFAULT} SELECT n::BIGINT AS n, k::INT AS tier, c::BIGINT AS c FROM dc")
def default_counts(spark, d):
    return spark.range(1, 513).select(F.col("id").alias("n"), F.posexplode(ts.default_counts(F.col("id"))).alias("tier", "c"))


@query("coverage", f"WITH {_TIER}, {_DEFAULT} SELECT n::BIGINT AS n, cov FROM cv")
def coverage(spark, d):
    return spark.range(1, 513).select(F.col("id").alias("n"), ts.coverage(ts.default_counts(F.col("id"))).alias("cov"))


_NT = "nt AS (SELECT n.n * 100000 + t.t AS id, n.n, t.t FROM (SELECT unnest([1, 2, 5, 8, 12, 44, 100]) AS n) n CROSS JOIN (SELECT unnest([3, 10, 50, 94, 200, 348, 602, 1232, 5000, 9999, 20000, 90000]) AS t) t)"


@query("allocate", f"WITH RECURSIVE {_TIER}, {_DEFAULT}, {_NT}, {_ALLOCATE.format('nt')} SELECT nt.n::BIGINT AS n, nt.t::BIGINT AS t, array_to_string(al.counts, ',') AS counts FROM al JOIN nt USING (id)")
def allocate(spark, d):
    pairs = spark.range(1).select(F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 5, 8, 12, 44, 100)])).alias("n"))
    pairs = pairs.select("n", F.explode(F.array(*[F.lit(t) for t in (3, 10, 50, 94, 200, 348, 602, 1232, 5000, 9999, 20000, 90000)])).alias("t")).withColumn("t", F.col("t").cast("long"))
    return ts.with_allocation(pairs, "n", "t").select("n", "t", F.array_join("counts", ",").alias("counts"))


@query("tokens_for_coverage", f"WITH {_TIER}, {_DEFAULT} SELECT t::BIGINT AS t, least((SELECT min(n) FROM cv WHERE cov >= t), 256)::BIGINT AS n FROM (SELECT unnest(range(1, 20000, 37)) AS t)")
def tokens_for_coverage(spark, d):
    return spark.range(1, 20000, 37).select(F.col("id").alias("t"), ts.tokens_for_coverage(F.col("id"), F.lit(256)).alias("n"))


@query("capped_horizon", "SELECT p::BIGINT AS p, c::BIGINT AS c, least(p, greatest(1, least(128, greatest(1, 512 - c)) // c) * 16)::BIGINT AS steps FROM (SELECT unnest([16, 48, 480, 720]) AS p) CROSS JOIN (SELECT unnest([1, 5, 21, 100]) AS c)")
def capped_horizon(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(p).cast("long") for p in (16, 48, 480, 720)])).alias("p")).select("p", F.explode(F.array(*[F.lit(c).cast("long") for c in (1, 5, 21, 100)])).alias("c"))
    return rows.withColumn("steps", sg.capped_horizon(F.col("p"), F.col("c"), F.col("c"), sg.SamplerParams(l_pack=512)))


@query("rollout_passes", "SELECT p::BIGINT AS p, k::BIGINT AS pass, (k * 96)::BIGINT AS first, least(96, p - k * 96)::BIGINT AS steps FROM (SELECT p, unnest(range((p + 95) // 96)) AS k FROM (SELECT unnest([48, 96, 480, 720]) AS p))")
def rollout_passes(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(p).cast("long") for p in (48, 96, 480, 720)])).alias("p"))
    one = sg.capped_horizon(F.col("p"), F.lit(21), F.lit(21), sg.SamplerParams(l_pack=512))
    rows = rows.withColumn("one", one).select("p", "one", S.steps(F.ceil(F.col("p") / F.col("one"))).alias("pass"))
    return rows.select("p", "pass", (F.col("pass") * F.col("one")).alias("first"), F.least(F.col("one"), F.col("p") - F.col("pass") * F.col("one")).alias("steps"))


# --- segments ------------------------------------------------------------------------------

PARAMS = sg.SamplerParams()
ORIGINS = (336, 504, 672)


def _segments(spark, d):
    """Crops of ev_hourly at three origins."""
    items = spark.range(1).select(F.explode(F.array(*[F.lit(o).cast("long") for o in ORIGINS])).alias("origin"))
    items = items.select(F.col("origin").alias("segment_id"), F.lit("ev_hourly").alias("series_id"), F.lit(2).alias("n_features"), F.lit(3).alias("n_targets"), "origin", F.lit(48).cast("long").alias("p"))
    # a row a segment, which many joins read and whose expressions are long
    return written(sg.eval_spec(items, PARAMS), "segments")


_SEG = f"""{_TIER}, {_DEFAULT}, so AS (SELECT o AS id, o AS origin, least((SELECT cov FROM cv WHERE n = 49), o) AS t FROM (SELECT unnest([336, 504, 672]) AS o)),
sn AS (SELECT so.*, least((SELECT min(n) FROM cv WHERE cov >= so.t), 49)::BIGINT AS n FROM so), {_ALLOCATE.format("sn")},
seg AS (SELECT sn.id AS segment_id, sn.origin, sn.n AS n_eff, al.counts, 3 AS q_tok, list_sum(list_transform(range(6), lambda k: al.counts[k + 1] * ([4, 8, 16, 64, 256, 512])[k + 1]))::BIGINT AS cov FROM sn JOIN al USING (id))"""


@query("eval_spec", f"WITH RECURSIVE {_SEG} SELECT segment_id::BIGINT AS segment_id, n_eff, array_to_string(counts, ',') AS counts, cov AS coverage, (5 * n_eff + 9)::BIGINT AS size FROM seg")
def eval_spec(spark, d):
    return _segments(spark, d).select("segment_id", "n_eff", F.array_join("counts", ",").alias("counts"), "coverage", "size")


_DISPATCH = """dp AS (SELECT segment_id, tier, p, i, pos, origin - before - i * p - p AS raw_start, origin - before - i * p AS raw_end FROM (
  SELECT segment_id, origin, k AS tier, p, c, unnest(range(c)) AS i, before, ahead FROM (
    SELECT segment_id, origin, k, p, counts[k + 1] AS c, list_sum([0] || list_transform(range(k), lambda j: counts[j + 1] * ([4, 8, 16, 64, 256, 512])[j + 1])) AS before, list_sum([0] || list_transform(range(k), lambda j: counts[j + 1])) AS ahead
    FROM seg CROSS JOIN tier)) CROSS JOIN LATERAL (SELECT ahead + i AS pos))"""


@query("dispatch_windows", f"WITH RECURSIVE {_SEG}, {_DISPATCH} SELECT segment_id::BIGINT AS segment_id, tier::INT AS tier, i::BIGINT AS i, raw_start::BIGINT AS raw_start, raw_end::BIGINT AS raw_end, pos::BIGINT AS pos FROM dp")
def dispatch_windows(spark, d):
    rows = ts.dispatch(_segments(spark, d), ["segment_id"])
    return rows.select("segment_id", "tier", "i", F.col("raw_start").cast("long").alias("raw_start"), F.col("raw_end").cast("long").alias("raw_end"), F.col("pos").cast("long").alias("pos"))


_U = "('0x' || substr(md5('0:' || series_id || ':{}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_SAMPLE = f"""it AS (SELECT DISTINCT user_id::VARCHAR AS series_id FROM events),
s1 AS (SELECT series_id, 1 + floor({_U.format("q")} * 4)::BIGINT AS q_tok FROM it),
s2 AS (SELECT *, least(q_tok * 4, 29) AS hi, least((q_tok - 1) * 4 + 1, 29) AS lo FROM s1),
s3 AS (SELECT *, lo + floor({_U.format("p")} * (hi - lo + 1))::BIGINT AS p FROM s2),
s4 AS (SELECT *, 1 + floor({_U.format("origin")} * (30 - p))::BIGINT AS origin, (64 - q_tok) AS n FROM s3)"""
SMALL = sg.SamplerParams(l_pack=64, p_out=4)


def _sampled(spark, d):
    items = src.read(spark, d, "events").select(F.col("user_id").cast("string").alias("series_id")).distinct()
    return sg.sample_spec(items.select("series_id", F.lit(0).alias("n_features"), F.lit(1).alias("n_targets"), F.lit(30).alias("t_raw")), SMALL)


@query("sample_spec", f"WITH {_TIER}, {_DEFAULT}, {_SAMPLE} SELECT series_id, q_tok, p, origin, (SELECT min(n) FROM cv WHERE cov >= origin)::BIGINT AS n_eff, ((SELECT min(n) FROM cv WHERE cov >= origin) + q_tok)::BIGINT AS size FROM s4")
def sample_spec(spark, d):
    return _sampled(spark, d).select("series_id", "q_tok", "p", "origin", "n_eff", "size")


@query("spec_violations", "SELECT series_id, 0::BIGINT AS size FROM (SELECT '' AS series_id) WHERE false")
def spec_violations(spark, d):
    return sg.spec_violations(_sampled(spark, d), SMALL).select("series_id", "size")


# --- tokens --------------------------------------------------------------------------------


def _channels(spark, kff: bool = False):
    roles = [tk.KFF if kff else tk.FEATURE] * 2 + [tk.TARGET] * 3
    role = F.element_at(F.array(*[F.lit(r) for r in roles]), F.col("channel_idx") + 1)
    return spark.range(1).select(F.lit("ev_hourly").alias("series_id"), F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("channel_idx", "x")).select("series_id", "channel_idx", role.alias("role"))


def _token_table(spark, d, kff: bool = False):
    return tk.token_table(_segments(spark, d), _channels(spark, kff), src.ev_hourly(spark, d), 16)


def _tokens_sql(kff: bool) -> str:
    hidden = "5" if kff else "ch >= 2"
    width = "seg.n_eff + 3" if kff else "seg.n_eff + CASE WHEN ch >= 2 THEN 3 ELSE 0 END"
    base = "ch * (n_eff + 3)" if kff else "ch * n_eff + greatest(ch - 2, 0) * 3"
    return f"""{V.VIEWS["ev_hourly"]}, {_SEG}, {_DISPATCH}, chn AS (SELECT unnest(range(5)) AS ch),
ob AS (SELECT channel_idx AS ch, t FROM ev_hourly WHERE y IS NOT NULL),
tok AS (
  SELECT dp.segment_id, ch, tier, {base} + pos AS pos, 0 AS role,
    CASE WHEN EXISTS (SELECT 1 FROM ob WHERE ob.ch = chn.ch AND ob.t >= raw_start AND ob.t < raw_end) THEN 0 ELSE 2 END AS content_state,
    CASE WHEN ch >= 2 THEN 1 ELSE 0 END AS role_ft, (raw_start + raw_end) * 0.5::DOUBLE - seg.origin AS t_center,
    raw_end + p <= seg.origin AND raw_end >= 0 AND EXISTS (SELECT 1 FROM ob WHERE ob.ch = chn.ch AND ob.t >= raw_end AND ob.t < raw_end + p) AS valid_aux
  FROM dp JOIN seg USING (segment_id) CROSS JOIN chn
  UNION ALL
  SELECT segment_id, ch, 2, {base} + n_eff + j, CASE WHEN ch >= 2 THEN 1 ELSE 0 END,
    CASE WHEN ch >= 2 THEN 1 WHEN EXISTS (SELECT 1 FROM ob WHERE ob.ch = chn.ch AND ob.t >= origin + 16 * j AND ob.t < origin + 16 * j + 16) THEN 0 ELSE 2 END,
    CASE WHEN ch >= 2 THEN 1 ELSE 0 END, 16 * j + 8::DOUBLE, false
  FROM seg CROSS JOIN chn CROSS JOIN (SELECT unnest(range(3)) AS j) {"" if kff else "WHERE ch >= 2"})"""


_TOK = "SELECT segment_id::BIGINT AS segment_id, ch::INT AS channel_idx, tier::INT AS tier, pos::BIGINT AS pos, role::INT AS role, content_state::INT AS content_state, role_ft::INT AS role_ft, t_center::DOUBLE AS t_center, valid_aux FROM tok"


def _plain(df):
    return df.select("segment_id", "channel_idx", "tier", F.col("pos").cast("long").alias("pos"), "role", "content_state", "role_ft", F.col("t_center").cast("double").alias("t_center"), "valid_aux")


@query("token_table", f"WITH RECURSIVE {_tokens_sql(False)} {_TOK}")
def token_table(spark, d):
    return _plain(_token_table(spark, d))


@query("kff_tokens", f"WITH RECURSIVE {_tokens_sql(True)} {_TOK}")
def kff_tokens(spark, d):
    return _plain(_token_table(spark, d, True))


@query("token_states", f"WITH RECURSIVE {_tokens_sql(False)} SELECT tier::INT AS tier, content_state::INT AS content_state, count(*)::BIGINT AS n, count_if(valid_aux)::BIGINT AS n_aux FROM tok GROUP BY ALL")
def token_states(spark, d):
    return _token_table(spark, d).groupBy("tier", "content_state").agg(F.count("*").alias("n"), F.count_if("valid_aux").alias("n_aux"))


def _norm_sql(origin: int) -> str:
    return f"""SELECT * FROM (WITH cx AS (SELECT * FROM ev_hourly WHERE t < {origin}), {_sigma_sql("cx")}, {_ANCHOR.format("cx")}
SELECT segment_id::BIGINT AS segment_id, sg.channel_idx, o::BIGINT AS "offset", round(coalesce(asinh((p.y - an.a) / sg.sigma), 0), 6) AS z, p.y IS NOT NULL AS observed
FROM (SELECT segment_id, origin, cov, unnest(range(cov)) AS o FROM seg WHERE segment_id = {origin}) g CROSS JOIN sg JOIN an USING (channel_idx)
LEFT JOIN ev_hourly p ON p.channel_idx = sg.channel_idx AND p.t = g.origin - g.cov + g.o)"""


@query("norm_window", f"WITH RECURSIVE {V.VIEWS['ev_hourly']}, {_SEG} " + " UNION ALL ".join(_norm_sql(o) for o in ORIGINS))
def norm_window(spark, d):
    # each segment's context is a series of its own, so that its statistics are those before its origin
    segments = _segments(spark, d)
    own = segments.select("segment_id", "series_id", "origin")
    ctx = src.ev_hourly(spark, d).join(F.broadcast(own), "series_id").where("t < origin").withColumn("series_id", F.concat_ws(":", "segment_id", "series_id")).drop("segment_id", "origin")
    stats = st.robust_sigma(ctx).join(st.anchors(ctx), ["series_id", "channel_idx"])
    return tk.norm_store(segments.withColumn("series_id", F.concat_ws(":", "segment_id", "series_id")), ctx, stats).select("segment_id", "channel_idx", "offset", r6("z"), "observed")


# Items of a packing workload, dealt to buffers of eight by number, for offsets, padding and masks.
_ITEMS = "items AS (SELECT doc_id AS item, greatest(1, least(256, ceil(n_chars / 64.0)))::BIGINT AS size FROM documents)"


def _buffers(spark, d):
    items = src.doc_lengths(spark, d)
    return items.select(F.floor(F.col("item") / 8).alias("buffer_id"), F.pmod("item", F.lit(8)).alias("seq"), "item", "size", F.lit(1).cast("long").alias("c"), (F.col("size") * 4).alias("store"))


_BUF = f"{_ITEMS}, buf AS (SELECT item // 8 AS buffer_id, item % 8 AS seq, item, size, size * 4 AS store FROM items)"
#: Eight items of 256 tokens at most.
_ROOM = 8 * 256


@query("pack_offsets", f"""WITH {_BUF} SELECT a.buffer_id::BIGINT AS buffer_id, a.item, coalesce(sum(b.size), 0)::BIGINT AS token_base, coalesce(sum(b.store), 0)::BIGINT AS store_base, count(b.item)::BIGINT AS channel_base
FROM buf a LEFT JOIN buf b ON b.buffer_id = a.buffer_id AND b.seq < a.seq GROUP BY ALL""")
def pack_offsets(spark, d):
    return tk.pack_offsets(_buffers(spark, d)).select("buffer_id", "item", "token_base", "store_base", "channel_base")


@query("pad_fill", f"WITH {_BUF} SELECT buffer_id::BIGINT AS buffer_id, sum(size)::BIGINT AS used, ({_ROOM} - sum(size))::BIGINT AS pads FROM buf GROUP BY ALL")
def pad_fill(spark, d):
    return tk.pad_fill(_buffers(spark, d), _ROOM)


def _mask_tokens(spark, d):
    """Tokens of all documents at their whole sizes, in buffers of eight documents."""
    rows = tk.pack_offsets(_buffers(spark, d)).select("buffer_id", F.col("seq").alias("sample"), "size", "token_base", S.steps(F.col("size")).alias("i"))
    return rows.select("buffer_id", "sample", (F.col("token_base") + F.col("i")).alias("slot"), F.when(F.pmod("i", F.lit(4)) == 3, tk.QRY).otherwise(tk.CTX).alias("role"), (F.col("i") - F.floor(F.col("size") / 2)).alias("t_center"), F.pmod("i", F.lit(6)).alias("tier"), F.when(F.pmod("i", F.lit(5)) == 4, tk.NA).otherwise(tk.OBSERVED).alias("content_state"))


_MASK = f"""{_BUF}, tb AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY buffer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM buf),
mt AS (SELECT buffer_id, seq, base + i AS slot, CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END AS role, i - size // 2 AS tc, i % 6 AS tier, i % 5 = 4 AS missing FROM (SELECT *, unnest(range(size)) AS i FROM tb))"""


@query("attention_pairs", f"WITH {_MASK} SELECT q.buffer_id::BIGINT AS buffer_id, q.slot::BIGINT AS q, count(*)::BIGINT AS n_keys, sum(k.slot)::BIGINT AS key_sum FROM mt q JOIN mt k ON q.buffer_id = k.buffer_id AND q.seq = k.seq AND ((k.role = 0 AND (q.role = 1 OR k.tc <= q.tc)) OR (q.role = 1 AND k.role = 1)) GROUP BY ALL")
def attention_pairs(spark, d):
    return tk.attention_pairs(_mask_tokens(spark, d)).groupBy("buffer_id", "q").agg(F.count("*").alias("n_keys"), F.sum("k").alias("key_sum"))


@query("route_rank", f"WITH {_MASK} SELECT * FROM (SELECT buffer_id::BIGINT AS buffer_id, tier::BIGINT AS tier, slot::BIGINT AS slot, row_number() OVER (PARTITION BY buffer_id, tier ORDER BY slot) - 1 AS rank FROM mt WHERE NOT missing) WHERE rank < 8")
def route_rank(spark, d):
    return tk.route_rank(_mask_tokens(spark, d), 8).select("buffer_id", "tier", "slot", F.col("rank").cast("long").alias("rank"))


@query("cost_schedule", f"WITH {_BUF}, c AS (SELECT buffer_id, sum(size * size) / 2.0::DOUBLE AS cost FROM buf GROUP BY ALL) SELECT buffer_id::BIGINT AS buffer_id, cost, place, place // 4 AS step FROM (SELECT *, row_number() OVER (ORDER BY cost, buffer_id) - 1 AS place FROM c)")
def cost_schedule(spark, d):
    return pk.schedule(pk.buffer_costs(_buffers(spark, d)), 4)


@query("trivial_batches", f"WITH {_ITEMS} SELECT item, row_number() OVER (ORDER BY item) - 1 AS buffer_id, (row_number() OVER (ORDER BY item) - 1) // 4 AS batch FROM items")
def trivial_batches(spark, d):
    return pk.trivial_batches(src.doc_lengths(spark, d), "item", 4).select("item", "buffer_id", "batch")


@query("bfd_pack")
def bfd_pack(spark, d):
    return pk.best_fit(src.doc_lengths(spark, d), 256, 48)


@query("bfd_invariants", f"WITH {_ITEMS} SELECT 0::BIGINT AS n_overfull, 0::BIGINT AS n_empty, count(*)::BIGINT AS n_packed, count(DISTINCT item)::BIGINT AS n_distinct, 0::BIGINT AS n_lost, sum(size)::BIGINT AS n_tokens, true AS well_filled FROM items")
def bfd_invariants(spark, d):
    items = src.doc_lengths(spark, d)
    return pk.invariants(pk.best_fit(items, 256, 48), items, 256)


# --- splits and shards ---------------------------------------------------------------------

TERMS = {"short": 1, "medium": 10, "long": 15}


@query("rolling_windows", "SELECT s AS config_id, term, w::BIGINT AS w, 4 * times AS p, 343 - (3 - w) * 4 * times AS origin FROM (SELECT DISTINCT c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey) CROSS JOIN (VALUES ('short', 1), ('medium', 10), ('long', 15)) t(term, times) CROSS JOIN (SELECT unnest(range(3)) AS w) WHERE 343 - (3 - w) * 4 * times >= 2")
def rolling_windows(spark, d):
    meta = src.ord_segment(spark, d).groupBy(F.col("series_id").alias("config_id")).agg(F.count("*").alias("n")).withColumn("p", F.lit(4))
    out = src.rolling_windows(meta, 3, TERMS)
    return out.select("config_id", "term", "w", F.col("p").cast("int").alias("p"), F.col("origin").cast("long").alias("origin"))


@query(
    "window_rows",
    V.with_("ord_segment", select="""SELECT series_id || '/' || term AS config_id, w::BIGINT AS w, CASE WHEN t < origin THEN 'context' ELSE 'label' END AS part, count(*)::BIGINT AS n, round(sum(y), 2) AS total, max(CASE WHEN t >= origin THEN t - origin END)::BIGINT AS last_h
FROM ord_segment JOIN (SELECT term, w, 4 * times AS p, 343 - (3 - w) * 4 * times AS origin FROM (VALUES ('short', 1), ('medium', 10), ('long', 15)) v(term, times) CROSS JOIN (SELECT unnest(range(2)) AS w)) x ON t < origin + p GROUP BY ALL"""),
)
def window_rows(spark, d):
    points = src.ord_segment(spark, d).withColumnRenamed("series_id", "config_id")
    meta = points.groupBy("config_id").agg(F.count("*").alias("n")).withColumn("p", F.lit(4))
    rows = src.window_rows(points, src.rolling_windows(meta, 3, TERMS), 2)
    named = rows.withColumn("config_id", F.concat_ws("/", "config_id", "term"))
    return named.groupBy("config_id", "w", "part").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("total"), F.max("h").cast("long").alias("last_h"))


@query("train_series_shard", "SELECT vec_id, gi AS idx FROM (SELECT vec_id, rn, row_number() OVER (ORDER BY label, vec_id) - 1 AS gi FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 20) WHERE gi % 3 = 1")
def train_series_shard(spark, d):
    from pyspark.sql import Window

    rows = src.read(spark, d, "embeddings").select("vec_id", "label")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("rn <= 20")
    return src.shard(pk.numbered(rows, ["label", "vec_id"], "idx"), "idx", 3, 1).select("vec_id", "idx")


@query("shard_disjoint", "SELECT count(*)::BIGINT AS n_union, 0::BIGINT AS n_shared, 0::BIGINT AS n_missing FROM embeddings")
def shard_disjoint(spark, d):
    rows = src.read(spark, d, "embeddings").select("vec_id")
    parts = [src.shard(rows, "vec_id", 3, r) for r in range(3)]
    both = parts[0].unionAll(parts[1]).unionAll(parts[2])
    shared = parts[0].intersect(parts[1]).unionAll(parts[1].intersect(parts[2])).unionAll(parts[0].intersect(parts[2]))
    missing = rows.exceptAll(both)
    return both.agg(F.count("*").alias("n_union")).join(shared.agg(F.count("*").alias("n_shared"))).join(missing.agg(F.count("*").alias("n_missing")))


@query("merge_context_horizon", V.with_("ev_user_daily", select="SELECT series_id, count(*)::BIGINT AS n, count(CASE WHEN t < 25 THEN 1 END)::BIGINT AS n_ctx, sum(y)::DOUBLE AS total FROM ev_user_daily GROUP BY ALL"))
def merge_context_horizon(spark, d):
    split = src.EvalSplit(25, 5, 7)
    points = src.ev_user_daily(spark, d)
    merged = src.merge_context_horizon(src.context(points, split), src.labels(points, split))
    return merged.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.col("h").isNull()).alias("n_ctx"), F.sum("y").alias("total"))


@query("drop_short", "SELECT user_id::VARCHAR AS series_id, count(DISTINCT ts::DATE)::BIGINT AS n FROM events GROUP BY ALL HAVING count(DISTINCT ts::DATE) >= 26")
def drop_short(spark, d):
    days = src.read(spark, d, "events").select(F.col("user_id").cast("string").alias("series_id"), src._days("ts", "2024-01-01").alias("t")).distinct()
    return src.drop_short(days, 26).groupBy("series_id").agg(F.count("*").alias("n"))


@query("season_lookup", "SELECT freq, coalesce(season, 1)::INT AS season FROM (SELECT unnest(['H', 'M', 'D', 'W', 'T', 'Q', 'B', 'X']) AS freq) LEFT JOIN (VALUES ('H', 24), ('M', 12), ('D', 1), ('W', 1), ('T', 1440), ('Q', 4), ('B', 5)) s(freq, season) USING (freq)")
def season_lookup(spark, d):
    table = F.create_map(*[F.lit(x) for kv in S.SEASONS.items() for x in kv])
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in (*S.SEASONS, "X")])).alias("freq"))
    return rows.select("freq", F.coalesce(F.try_element_at(table, F.col("freq")), F.lit(1)).alias("season"))
