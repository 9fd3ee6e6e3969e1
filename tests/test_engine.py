"""Hand-computed cases of the time-series operators, and every query's SQL oracle on the smallest tables."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tidegrid import catalog
from tidegrid.functions import scalar as S
from tidegrid.operators import forecast as fc
from tidegrid.operators import packing as pk
from tidegrid.operators import scoring as sc
from tidegrid.operators import stats as st
from tidegrid.operators import telescope as ts
from tidegrid.operators import tokens as tk
from tidegrid.sources import series as src

SF = "/root/testdata/sf0.001"


def points(spark, *series):
    rows = [(f"s{k}", 0, t, None if y is None else float(y)) for k, ys in enumerate(series) for t, y in enumerate(ys)]
    return spark.createDataFrame(rows, "series_id string, channel_idx int, t long, y double")


def by_series(df, value, order="h"):
    out = {}
    for r in df.orderBy("series_id", order).collect():
        out.setdefault(r.series_id, []).append(r[value])
    return out


def test_seasonal_naive_hand_cases(spark):
    df = points(spark, range(6), [0, 1, 2, 3, None, 5])
    assert by_series(fc.seasonal_naive(df, 5, 3), "yhat") == {"s0": [3, 4, 5, 3, 4], "s1": [3, 3, 5, 3, 3]}
    df = points(spark, [None, None, 4], [None, None, None])
    assert by_series(fc.seasonal_naive(df, 3, 3), "yhat") == {"s0": [4, 4, 4], "s1": [0, 0, 0]}
    assert by_series(fc.seasonal_naive(points(spark, [1, 3]), 2, 5), "yhat") == {"s0": [2, 2]}


def test_seasonal_denominator_hand_cases(spark):
    df = points(spark, [1, 2, 4, 7], [1, 2, None, 4, 7], [None, None])
    got = {r.series_id: r.denom for r in fc.seasonal_denominator(df, 1).collect()}
    assert got == {"s0": 2.0, "s1": 2.0, "s2": S.DENOM_FLOOR}


def test_mase_masks_labels_but_not_forecasts(spark):
    labels = points(spark, [1, 2, 3], [1, None, 3], [None, None, None], [1, 2, 3]).withColumn("h", F.col("t"))
    forecast = labels.select("series_id", "channel_idx", "h", F.when((F.col("series_id") == "s3") & (F.col("h") == 1), float("inf")).otherwise(F.col("h") + 1.5).alias("yhat"))
    denom = labels.select("series_id", "channel_idx").distinct().withColumn("denom", F.lit(0.25))
    got = {r.series_id: r.mase for r in sc.mase(forecast, labels, denom).collect()}
    assert got == {"s0": 2.0, "s1": 2.0, "s3": math.inf}


@pytest.mark.parametrize("values, want", [([1.0, 4.0], 2.0), ([2.0, math.inf], math.inf), ([1.0, math.nan], math.nan), ([], math.nan)])
def test_gmean(spark, values, want):
    got = spark.createDataFrame([(v,) for v in values], "x double").agg(S.gmean("x").alias("g")).first().g
    assert got == want or math.isnan(got) and math.isnan(want)


def test_robust_sigma_rungs(spark):
    spikes = [50.0 if t % 40 == 0 else 0.0 for t in range(300)]
    df = points(spark, [7.5] * 200, spikes, [1, None, 5, None, 9], range(10))
    got = {r.series_id: (r.fallback, r.sigma) for r in st.robust_sigma(df).collect()}
    assert got["s0"] == ("unit", 1.0) and got["s1"][0] == "mean_abs" and got["s1"][1] > 0
    assert got["s2"][0] == "iqr" and got["s3"][0] == "mad"


def test_anchor_takes_the_recent_level(spark):
    df = points(spark, [0.0] * 500 + [100.0] * 32, [None] * 40)
    assert {r.series_id: r.a for r in st.anchors(df).collect()} == {"s0": 100.0, "s1": 0.0}


def test_normalisation_round_trip_and_clamp(spark):
    df = spark.createDataFrame([(x,) for x in (-1e9, -3.0, 0.0, 1e-7, 5e8)], "x double").select("x", S.forward("x", F.lit(2.0), F.lit(3.0)).alias("z"))
    for r in df.select("x", S.inverse("z", F.lit(2.0), F.lit(3.0)).alias("b")).collect():
        assert r.b == pytest.approx(r.x, rel=1e-9, abs=1e-6)
    row = spark.range(1).select(S.clamp(F.lit(1000.0)).alias("a"), S.clamp(F.lit(float("nan"))).alias("b"), S.fed_back(F.lit(float("inf"))).alias("c")).first()
    assert row.a == 10 and math.isnan(row.b) and row.c == 0


def test_tier_golden_values(spark):
    df = spark.createDataFrame([(1,), (5,), (44,), (100,)], "n long").select("n", ts.default_counts(F.col("n")).alias("c"))
    assert {r.n: list(r.c) for r in df.collect()} == {1: [1, 0, 0, 0, 0, 0], 5: [1, 1, 1, 1, 1, 0], 44: [8, 8, 8, 8, 8, 4], 100: [19, 18, 18, 18, 18, 9]}
    want = {10: [44, 0, 0, 0, 0, 0], 50: [44, 0, 0, 0, 0, 0], 200: [38, 6, 0, 0, 0, 0], 1232: [18, 8, 8, 8, 2, 0], 5000: [8, 8, 8, 8, 8, 4], 20000: [0, 0, 0, 1, 8, 35], 10**7: [0, 0, 0, 0, 0, 44]}
    df = ts.with_allocation(spark.createDataFrame([(44, t) for t in want], "n long, t long"), "n", "t")
    assert {r.t: list(r.counts) for r in df.collect()} == want
    df = spark.createDataFrame([(t,) for t in (1, 100, 480, 1232, 4832)], "t long").select("t", ts.tokens_for_coverage(F.col("t"), F.lit(512)).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {1: 1, 100: 5, 480: 6, 1232: 14, 4832: 44}
    with pytest.raises(ValueError):
        ts.default_counts(F.lit(3), (1, 2))


def test_attention_grid(spark):
    first = [(0, 0, 0, 0, -3.0), (0, 0, 1, 0, -2.0), (0, 0, 2, 0, -2.0), (0, 0, 3, 0, 1.0), (0, 0, 4, 1, 0.0), (0, 0, 5, 1, 1.0)]
    second = [(1, 1, 0, 0, -1.0), (1, 1, 1, 1, 0.0), (1, 2, 2, 0, -1.0), (1, 2, 3, 1, 0.0), (1, -1, 4, 0, 0.0), (1, -1, 5, 0, 0.0)]
    rows = first + second
    got = {tuple(r) for r in tk.attention_pairs(spark.createDataFrame(rows, "buffer_id int, sample int, slot int, role int, t_center double")).collect()}
    want = set()
    for b, s, i, r, t in rows:
        for b2, s2, j, r2, t2 in rows:
            if b == b2 and (s == s2 >= 0 and (r2 == 0 and (r == 1 or t2 <= t) or r == r2 == 1) or s < 0 and i == j):
                want.add((b, i, j))
    assert got == want


def test_schedule_and_costs(spark):
    costs = spark.createDataFrame(list(enumerate([100.0, 1.0, 50.0, 2.0, 99.0, 3.0, 51.0])), "buffer_id long, cost double")
    rows = pk.schedule(costs, 2).orderBy("place").collect()
    assert [r.cost for r in rows] == sorted(r.cost for r in rows) and [r.step for r in rows] == [0, 0, 1, 1, 2, 2, 3]
    packed = spark.createDataFrame([(0, 4), (0, 6)], "buffer_id long, size long")
    assert pk.buffer_costs(packed).first().cost == 26.0


def test_best_fit_fills_buffers():
    import random

    rng = random.Random(0)
    items = [(i, rng.randrange(4, 40)) for i in range(400)]
    made = list(pk.buffers(iter(items), 256, 48))
    assert sorted(i for b in made for i, _ in b) == list(range(400))
    fill = [sum(s for _, s in b) / 256 for b in made]
    assert max(fill) <= 1 and sum(fill[:-1]) / len(fill[:-1]) > 0.9
    with pytest.raises(ValueError):
        list(pk.buffers(iter([(0, 300)]), 256, 4))


def test_unknown_source():
    with pytest.raises(NotImplementedError):
        src.build_loader("nowhere")


def test_stateful_reservoir_flushes(spark, tmp_path):
    from tidegrid.streaming import hourly as hs

    for part in range(3):
        spark.createDataFrame([(part * 40 + i, 10 + i % 7) for i in range(40)], "item long, size long").coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
    spark.createDataFrame([(10**6, 0)], "item long, size long").coalesce(1).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("item long, size long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    rows = hs.drained(hs.packed(stream, 64, 8, 1), "reservoir").collect()
    assert len({r.item for r in rows}) == len(rows) >= 112
    used = {}
    for r in rows:
        used[r.buffer_id] = used.get(r.buffer_id, 0) + r.size
    assert max(used.values()) <= 64


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_reservoir_returns_every_document_once(spark, tmp_path, parts):
    sf = str(tmp_path) if parts else SF
    if parts:  # a table that is a folder
        src.read(spark, SF, "documents").repartition(parts).write.parquet(f"{sf}/documents.parquet")
    rows = catalog.queries()["stream_reservoir"](spark, sf).collect()
    want = {r.item: r.size for r in src.doc_lengths(spark, SF).collect()}
    assert len(rows) == len(want) and {r.item: r.size for r in rows} == want
    used = {}
    for r in rows:
        assert r.item % 4 == r.shard
        used[r.shard, r.buffer_id] = used.get((r.shard, r.buffer_id), 0) + r.size
    assert max(used.values()) <= 256


def test_stream_sink_replaces_an_epoch(spark, tmp_path):
    from tidegrid.streaming import hourly as hs

    keep = hs.sink(str(tmp_path))
    rows = spark.createDataFrame([(1,), (2,)], "x long")
    for epoch in (0, 1, 1):
        keep(rows, epoch)
    assert spark.read.parquet(str(tmp_path)).count() == 4


def test_stream_resumes_without_loss_or_repeat(spark, tmp_path):
    from tidegrid.streaming import hourly as hs

    schema, at, out = "item long, size long", hs.folder(spark, "at"), hs.folder(spark, "out")
    write = lambda part, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / part))
    stream = lambda: hs.packed(spark.readStream.schema(schema).parquet(str(tmp_path / "*")), 64, 8, 2)
    write("a", [(i, 5 + i % 9) for i in range(60)])
    first = hs.drained(stream(), "reservoir", at, out=out).count()
    assert hs.drained(stream(), "reservoir", at, out=out).count() == first  # nothing new: nothing again
    write("b", [(i, 5 + i % 9) for i in range(60, 110)] + [(10**6, 0), (10**6 + 1, 0)])
    rows = hs.drained(stream(), "reservoir", at, out=out).collect()
    assert sorted(r.item for r in rows) == list(range(110))
    # buffers are those of a run without a stop
    plain = hs.packed(spark.readStream.schema(schema).parquet(str(tmp_path / "*")), 64, 8, 2)
    whole = hs.drained(plain, "reservoir").collect()
    assert sorted(r.item for r in whole) == list(range(110))


def test_stream_hourly_counts_the_latest_update(spark, tmp_path):
    from tidegrid.streaming import hourly as hs

    for part, hours in enumerate(((0, 1), (1, 2))):
        rows = [("a", f"2024-01-01 0{h}:1{part}:00", float(h)) for h in hours]
        spark.createDataFrame(rows, "event_type string, ts string, value double").coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
    stream = spark.readStream.schema("event_type string, ts string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    got = hs.drained(hs.hourly(stream), "hourly", keys=["event_type", "hour"]).collect()
    assert sorted((r.hour.hour, r.n) for r in got) == [(0, 1), (1, 2), (2, 1)]


def test_numbered_is_a_global_row_number(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice([None, 1.0, 1.0, float(rng.randrange(9))]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "cost double, id long").repartition(5)
    got = [(r.cost, r.id) for r in pk.numbered(df, ["cost", "id"], "n").orderBy("n").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert pk.numbered(df.where("false"), ["cost", "id"], "n").count() == 0


def _sql(text):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con.execute(text).fetchall()


def _same(df, columns, want):
    got, want = {tuple(r)[:columns]: tuple(r)[columns:] for r in df.collect()}, {r[:columns]: r[columns:] for r in want}
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(b, abs=2e-6) for k in got for a, b in zip(got[k], want[k]))


def test_fourier_features_and_windows_are_whole(spark):
    hours = catalog.queries()["fourier_features"](spark, SF).agg({"t": "max"}).first()[0]
    assert hours > 700
    assert catalog.queries()["norm_window"](spark, SF).select("segment_id").distinct().count() == 3


def test_mask_queries_cover_every_document(spark):
    buffers = {}
    for r in src.doc_lengths(spark, SF).orderBy("item").collect():
        buffers.setdefault(r.item // 8, []).append(r.size)
    assert sum(map(len, buffers.values())) == src.read(spark, SF, "documents").count() and max(max(b) for b in buffers.values()) > 32
    pairs, routed, slots = {}, set(), set()
    for b, sizes in buffers.items():
        base, tiers = 0, {}
        for size in sizes:
            for i in range(size):
                slots.add((b, base + i))
                if i % 4 == 3:
                    keys = range(size)
                else:
                    keys = [k for k in range(i + 1) if k % 4 != 3]
                pairs[b, base + i] = (len(keys), sum(base + k for k in keys))
                if i % 5 != 4:
                    at = tiers[i % 6] = tiers.get(i % 6, -1) + 1
                    if at < 8:
                        routed.add((b, i % 6, base + i, at))
            base += size
    got = catalog.queries()["attention_pairs"](spark, SF).collect()
    assert len(got) == len(pairs) and {(r.buffer_id, r.q): (r.n_keys, r.key_sum) for r in got} == pairs
    got = catalog.queries()["route_rank"](spark, SF).collect()
    assert len(got) == len(routed) and {tuple(r) for r in got} == routed
    got = catalog.queries()["forward_smoke"](spark, SF).collect()
    assert len(got) == len(slots) and {(r.buffer_id, r.slot) for r in got} == slots and all(math.isfinite(r.pred) for r in got)


_FAST = [n for n in catalog.oracle_sql() if n.startswith(("series_", "snaive", "mase_by", "gmean", "leaderboard_per", "robust", "tier_agg", "normalize_forward", "cost_s", "rolling", "gen_", "season_l", "pack_"))]


@pytest.mark.parametrize("name", _FAST)
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = catalog.queries()[name](spark, SF)
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    show = lambda v: "null" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.4f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(show(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    got = sorted(tuple(show(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want
