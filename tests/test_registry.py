"""Settings, sinks, registries and errors by hand cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidegrid import settings, sinks
from tidegrid.operators import assembly as asm
from tidegrid.operators import cases
from tidegrid.operators import forecasters as fs
from tidegrid.operators import scoring as sc
from tidegrid.sources import registry, series


def test_settings_merge_and_name_what_is_broken(tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"packing": {"window": 64}, "data": {"mixture": {"univariate": 1.0}}}))
    made = settings.load(str(path))
    assert made["packing"]["window"] == 64 and made["packing"]["reservoir"] == 1000 and made["data"]["mixture"] == {"univariate": 1.0}
    assert settings.DEFAULTS["packing"]["window"] == 128
    with pytest.raises(ValueError, match="tolerance.*|query_tokens"):
        settings.checked({"packing": {"tolerance": 1.0, "query_tokens": 0}})
    with pytest.raises(ValueError, match="terms"):
        settings.checked({"data": {"terms": ["never"]}})
    for bad, error in (({"packing": {"windov": 1}}, KeyError), ({"packing": {"window": "8"}}, TypeError), ({"eval": {"items_per_config": 0}}, ValueError), ({"model": {"out_patch": 5}}, ValueError)):
        with pytest.raises(error):
            settings.checked(bad)


def test_yaml_settings(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("eval:\n  items_per_config: -1\n")
    assert settings.load(str(tmp_path / "a.yaml"))["eval"]["items_per_config"] == -1


def test_roots(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# c\nTIDEGRID_ROOT='/from/file'\nOTHER=1\n")
    assert registry.root_of("/given", environment={"TIDEGRID_ROOT": "/env"}, file=str(env)) == "/given"
    assert registry.root_of("", environment={"TIDEGRID_ROOT": "/env"}, file=str(env)) == "/env"
    assert registry.root_of("", environment={}, file=str(env)) == "/from/file"
    assert registry.root_of("~/x", environment={}).endswith("/x") and "~" not in registry.root_of("~/x", environment={})
    with pytest.raises(ValueError):
        registry.root_of("", environment={}, file=str(tmp_path / "none"))


def test_configurations_are_folders_with_a_marker(spark, tmp_path):
    for name in ("b/15T", "a", "b/H", "deep/x/y/z"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / registry.MARKER).write_text("{}")
    (tmp_path / "no").mkdir()
    (tmp_path / "no" / "other.json").write_text("{}")
    (tmp_path / registry.MARKER).write_text("{}")
    assert [r.config_id for r in registry.configurations(spark, str(tmp_path)).collect()] == ["a", "b/15T", "b/H", "deep/x/y/z"]


def test_sources_by_name(spark):
    small = settings.checked({"data": {"series": 4, "length": [64, 80]}, "eval": {"windows": 6}})
    assert registry.build(registry.TRAINING, "corpus")(spark, small).select("idx").distinct().count() == 4
    assert registry.build(registry.TRAINING, "sanity")(spark, small).agg(F.max("t")).first()[0] == 512 - 32 - 1
    shard = registry.build(registry.EVALUATION, "synthetic_eval")(spark, small)
    rows = shard.groupBy("config_id").agg(F.countDistinct("t").alias("n"), F.max("h").alias("h"), F.countDistinct("channel").alias("c")).collect()
    assert len(rows) == 6 and all(64 <= r.n <= 256 and r.h in (15, 31) and 1 <= r.c <= 3 for r in rows)
    for kind in (registry.TRAINING, registry.EVALUATION):
        with pytest.raises(NotImplementedError):
            registry.build(kind, "nowhere")


def test_overfit_stream_drops_short_series_and_refuses_empty_shards(spark):
    rows = [(f"s{i}", 0, t, 1.0) for i in range(6) for t in range(5 if i == 0 else 12)]
    points = spark.createDataFrame(rows, "series_id string, channel_idx int, t long, y double")
    parts = [registry.overfit_stream(points, 10, 2, 1, 0)]
    assert parts[0][1] == 1 and parts[0][0].count() == 2 * 5 * 12
    with pytest.raises(ValueError):
        registry.overfit_stream(points.where("series_id = 's1'"), 10, 1, 50, 7 if spark.sql("select pmod(xxhash64('s1'), 50)").first()[0] != 7 else 8)


def test_sinks(spark, tmp_path):
    made = settings.checked({"run": {"out": str(tmp_path / "run")}, "tracking": {"sink": "table"}})
    sink = sinks.sink_of(spark, made)
    assert type(sinks.sink_of(spark, made, {"TIDEGRID_TRACKING": "disabled"})) is sinks.Nowhere
    sink.settings(made)
    report = spark.createDataFrame([(0.5, 3, float("nan"))], "mase double, n long, skill double")
    for step in (1, 2, 2):
        sink.scalars(sc.scalars(report, "eval"), step)
    rows = sink.read_scalars().collect()
    assert sorted((r.step, r.key, r.value) for r in rows) == [(s, k, v) for s in (1, 2) for k, v in (("eval/mase", 0.5), ("eval/n", 3.0))]
    sink.table("report", report)
    assert spark.read.parquet(str(tmp_path / "run/tables/report")).count() == 1
    (tmp_path / "file").write_text("x")
    sinks.Folder(spark, str(tmp_path / "file")).table("t", report)  # can't be written: told, not raised
    sinks.Nowhere().scalars(report, 1)


def test_overfull_buffers_are_an_error(spark):
    segments = spark.createDataFrame([(0, 0, 1, 5, 1, 3), (0, 1, 2, 6, 2, 4)], "buffer_id long, seq long, item long, size long, c long, store long")
    rows = asm.packed(segments, 12).orderBy("slot").collect()
    assert [r.sample for r in rows] == [0] * 5 + [1] * 6 + [-1] and [r.variate for r in rows] == [0] * 5 + [1] * 3 + [2] * 3 + [None]
    assert [r.store_begin for r in rows[:6]] == [0] * 5 + [3] and rows[-1].content_state == 2
    with pytest.raises(Exception, match="overflow buffer 0"):
        asm.packed(segments, 10).collect()


def test_layout_doesn_t_change_what_a_segment_reads(spark):
    """A segment alone, packed with others or in another order has the same tokens, but for where they lie."""
    rows = [(0, 0, 1, 4, 1, 2), (0, 1, 2, 3, 1, 5), (0, 2, 3, 2, 1, 1)]
    schema = "buffer_id long, seq long, item long, size long, c long, store long"
    own = lambda segments: sorted((r.item, r.slot - r.first, r.content_state) for r in segments.join(segments.groupBy("item").agg(F.min("slot").alias("first")), "item").collect())
    packed = asm.packed(spark.createDataFrame(rows, schema), 16).where("sample >= 0")
    turned = asm.packed(spark.createDataFrame([(0, 2 - s, i, z, c, w) for _, s, i, z, c, w in rows], schema), 16).where("sample >= 0")
    alone = asm.packed(spark.createDataFrame([(i, 0, i, z, c, w) for _, _, i, z, c, w in rows], schema), 16).where("sample >= 0")
    assert own(packed) == own(turned) == own(alone)


def test_scores_skip_what_has_no_season_or_label(spark):
    points = spark.createDataFrame([(s, 0, t, None if s == "gap" and t >= 6 else float(t % 2 + t)) for s in ("a", "gap", "none") for t in range(8)], "series_id string, channel_idx int, t long, y double")
    split = series.EvalSplit(6, 2, 2)
    seasons = points.where("series_id <> 'none'").select("series_id", "channel_idx").distinct().withColumn("season", F.lit(2))
    naive = lambda ctx, p: fs.naive_by_season(ctx, p, seasons)
    scores = fs.score(series.context(points, split), series.labels(points, split), seasons, 2, naive)
    row = fs.report(scores, points).first()
    assert (row.n, row.skipped) == (1, 2) and row.skill == pytest.approx(1) and row.model_mase == pytest.approx(1)
    empty = fs.mean_loss(naive(series.context(points, split), 2), series.labels(points, split).where("false")).first()
    assert math.isnan(empty.loss) and empty.n == 0


def test_a_configuration_without_a_score_stays_out_of_the_outer_mean(spark):
    scores = spark.createDataFrame([("a", "s1", 2.0, 4.0), ("a", "s2", None, None), ("b", "s3", None, None)], "config_id string, series_id string, model double, naive double")
    configs = sc.per_config(scores)
    by = {r.config_id: r for r in configs.collect()}
    assert (by["a"].n_items, by["a"].n_channels, by["b"].n_items, by["b"].n_channels) == (2, 1, 1, 0) and math.isnan(by["b"].model_mase)
    row = sc.board(configs).first()
    assert (row.n_configs, row.n_scored, row.n_items) == (2, 1, 3) and row.model_mase == pytest.approx(2) and row.skill == pytest.approx(0.5)


def test_contract_violations_are_found(spark):
    good = [("a", 0, 0, 1.0), ("a", 0, 1, None)]
    bad = [(None, 0, 0, 1.0), ("a", -1, 0, 1.0), ("a", 0, -2, 1.0), ("a", None, 3, 1.0), ("b", 0, 5, 1.0), ("b", 0, 5, 2.0)]
    schema = "series_id string, channel_idx int, t long, y double"
    assert series.violations(spark.createDataFrame(good, schema)).count() == 0
    assert sorted(r.problem for r in series.violations(spark.createDataFrame(good + bad, schema)).collect()) == ["key"] * 4 + ["repeated"]


def test_spec_violations_are_found(spark):
    from tidegrid.operators import segments as sg

    params = sg.SamplerParams(l_pack=64, p_out=4)
    items = spark.createDataFrame([(f"s{i}", i % 3, 1 + i % 2, 30 + i) for i in range(40)], "series_id string, n_features int, n_targets int, t_raw int")
    specs = sg.sample_spec(items, params)
    assert sg.spec_violations(specs, params).count() == 0
    rows = specs.collect()
    assert {r.n_kff for r in rows} >= {0, 1, 2} and all(r.size <= params.l_pack or r.n_eff == 1 for r in rows)
    for name, value in (("size", F.col("size") + 1), ("q_tok", F.col("q_tok") + 1), ("origin", F.lit(0)), ("n_eff", F.col("n_eff") + 1)):
        assert sg.spec_violations(specs.withColumn(name, value), params).count() == 40


def test_every_case_repeats_by_its_seed(spark):
    one, two = (cases.shared_sines(spark, 3, 24).repartition(k).orderBy("idx", "channel", "t").collect() for k in (1, 5))
    assert one == two
