"""Stages over small tables with nulls, repeated rows and an extra column."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidegrid.llm import ngram_join, packing


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randrange(1, 4)))
    texts = [". ".join(" ".join(word() for _ in range(10)) for _ in range(rng.randrange(3, 9))) + "." for _ in range(30)]
    item = " ".join(word() for _ in range(20))
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0] + " more", "en", "s0", 1), (101, item + " " + texts[1][:60], "en", "s0", 1), (102, texts[2] + " password=0123456789abcdef0", "fr", "s1", 1), (103, None, "en", "s0", None), (104, "", None, None, 0), rows[5]]
    rows += [(200 + i, "\n".join("### $$$ | %%% &&&" for _ in range(12)), "en", "s0", 9) for i in range(10)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(200 + i, 0, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        path = f"{sf}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert not {103, 104, *range(200, 210)} & set(seen["quality_rules"]) and set(range(30)) <= set(seen["quality_rules"])
    assert 100 not in seen["ngram_jaccard_join"] and 0 in seen["ngram_jaccard_join"]
    assert 101 not in seen["benchmark_decontamination"] and set(range(30)) - {2} <= set(seen["benchmark_decontamination"])
    final = seen["secret_scans"]
    assert docs.count() == len(final)  # the repeated row went
    kept = final.get(102) or final.get(2)
    assert "0123456789abcdef0" not in "".join(r.text for r in final.values()) and kept
    packed = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(final) and max(r.offset + r.length for r in packed) <= packing.SIZE


def test_run_covers_all_stages(spark, sf):
    assert cp.run(spark, sf).count() >= 25


def test_near_duplicates_are_told_apart_by_row(spark, sf):
    a = " ".join(f"river{i}" for i in range(30))
    b = " ".join(f"mountain{i}" for i in range(30))
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (None, a, "n"), (None, b + " end", "n"), (7, "", "e"), (7, "", "e"), (9, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.text, r.lang) for r in ngram_join.keep_one(docs.where("text <> ''")).collect())
    assert got == [(1, a, "x"), (5, b, "z")]
    assert ngram_join.keep_one(docs).where("text = '' or text is null").count() == 3
    # rows equal in id and text: one stays, the least by the other columns
    twice = spark.createDataFrame([(3, a, "q"), (3, a, "p"), (4, b, "r")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, ngram_join.keep_one(twice).collect())) == [(3, a, "p"), (4, b, "r")]


def test_columns_with_names_of_the_operators_stay(spark, sf):
    names = ["kept", "n_words", "content_share", "spans", "n_hit", "items", "contaminated", "__text", "low", "text_hash", "__k1", "a.b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 20")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name + " "), F.col("doc_id")))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        assert len(rows) >= 15 and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
    assert cp.STAGES[-1][1](spark, docs, sf).count() >= 20


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3])
def test_stages_over_nothing(spark, sf, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [stage(spark, docs, sf).count() for _, stage in cp.STAGES] == [0, len(rows), len(rows), len(rows), len(rows)]
