"""Every operator over empty tables, null ids, repeated rows, clashing names, odd white space and texts above a chunk's bytes."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import decontamination, lm_score, ngram_join, packing, quality_prior, quality_rules, secret_scan, token_store, toxicity, url_filter
from tidegrid.llm.store import first_by_hash, scratch, spread_join
from tidegrid.llm.tokenizer import Encoder, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"item{k}" for k in range(15))
LONG = "".join(f"long{k % 9973} w{k % 89}é{'.' if k % 17 else '.' + chr(10)} " for k in range(330_000))


def _rows():
    rng = random.Random(6)
    word = lambda: rng.choice(["river", "calm", "Wide", "moor", "fen", "alder"]) + str(rng.randrange(90))
    rows = [(i, " ".join(word() for _ in range(30)) + ".", "en", f"s{i % 2}", 1) for i in range(24)]
    rows += [(None, rows[3][1], "en", "s0", None), (None, None, None, None, None), (7, rows[7][1], "en", "s1", 1), (7, rows[7][1], "en", "s1", 1)]
    rows += [(40, "", "en", "s0", 0), (41, None, "en", "s0", 0), (42, " \t\r\n\x0b\x0c ", "en", "s0", 0), (43, "one", "en", "s0", 0)]
    return rows + [(44, ITEM + " password=abcdef0123456789 idiot!!!!!!!!!! $$$", "en", "s1", 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(44, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (None, "null item id words"), (2, None)], "item_id long, text string")


def _store(docs):
    path = scratch(docs.sparkSession, "edge-store")
    token_store.write(docs, path, public_path())
    return token_store.lookup(docs.sparkSession, path, token_store.keys_of(docs)).withColumnRenamed("key", "doc_id")


def _operators(labels, bench):
    return {
        "quality_prior": lambda d: quality_prior.score(d, quality_prior.fit(d, labels)),
        "token_store": _store,
        "packing": lambda d: packing.pack(d, public_path()),
        "quality_rules": lambda d: quality_rules.score(d, quality_rules.fit(d, labels), keep=["doc_id"]),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels), keep=["doc_id"]),
        "lm_score": lm_score.score,
        "decontamination": lambda d: decontamination.mark(d, bench, keep=["doc_id"]),
        "secret_scan": lambda d: secret_scan.scan(d, secret_scan.fit(d), keep=["doc_id"]),
        "ngram_join": ngram_join.near_duplicates,
    }


NAMES = ["quality_prior", "token_store", "packing", "quality_rules", "toxicity", "lm_score", "decontamination", "secret_scan", "ngram_join"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, bench, name):
    assert _operators(labels, bench)[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nulls_and_repeats(spark, labels, bench, name):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = _operators(labels, bench)[name](docs).collect()
    assert len(got) == len(rows)
    assert sum(r.doc_id is None for r in got) == 2
    same = [r.asDict() for r in got if r.doc_id == 7]
    place = ("number", "start", "sequence_id", "offset")
    assert len(same) == 3 and all({k: v for k, v in s.items() if k not in place} == {k: v for k, v in same[0].items() if k not in place} for s in same)
    by = {r.doc_id: r for r in got}
    if name == "decontamination":
        assert by[44].contaminated and by[44]["items"] == ["1"] and not any(by[i].n_words for i in (40, 41, 42))
    if name == "secret_scan":
        assert [s.kind for s in by[44].spans][:1] == ["assign"] and by[41].spans == []
    if name == "ngram_join":
        assert by[44].component_id == 44 and by[43].n_shingles == 1 and [r.component_id for r in got if r.doc_id is None and r.n_shingles] == [3]
    if name == "quality_rules":
        assert by[42].n_words == 0 and by[42].base_failed and not by[41].kept


def test_a_text_above_a_chunk(spark, labels, bench):
    """4 MB and more in one text: whole results, equal to those of plain Python where that is quick."""
    assert len(LONG.encode()) > 4 << 20
    text = LONG + ITEM + " token=Zbcdefgh0123456789"
    docs = spark.createDataFrame([(0, text, "en", "s0", 1), (1, "short " + text[:300], "en", "s0", 1), (2, text + " end", "en", "s0", 1)], SCHEMA)
    words = text.split()
    ops = _operators(labels, bench)
    got = {n: {r.doc_id: r for r in ops[n](docs).collect()} for n in NAMES if n != "packing"}
    assert got["quality_rules"][0].n_words == len(words) and got["lm_score"][0].n_tokens == len(words) + 1
    assert got["decontamination"][0].n_hit == 15 and got["decontamination"][0].n_words > len(words)
    assert [(s.kind, text[s.start : s.stop]) for s in got["secret_scan"][0].spans if s.kind != "crf"] == [("assign", "token=Zbcdefgh0123456789")]
    assert got["ngram_join"][0].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and got["ngram_join"][2].component_id == 0
    ids = [*Encoder(public_path()).tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert (got["token_store"][0].n_tokens, got["token_store"][0].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    pieces = [r for r in packing.pack(docs, public_path()).collect() if r.doc_id == 0]
    assert len(pieces) == -(-len(ids) // 4096) and sum(r.length for r in pieces) == len(ids)


def test_urls(spark):
    schema = "page_id long, url string, host string, rule string"
    assert url_filter.judge(spark.createDataFrame([], schema), "page_id", "url", url_filter.RULES).count() == 0
    rows = [(None, None, "h", "r"), (None, "http://a.org/x", "h", "r"), (1, "http://a.org/" + "p" * 50_000, "h", "r"), (2, "http://casino-win.org/", "h", "r"), (2, "http://casino-win.org/", "h", "r"), (3, "", "h", "r")]
    got = url_filter.judge(spark.createDataFrame(rows, schema), "page_id", "url", url_filter.RULES).collect()
    assert len(got) == 6 and all(r.verdict in ("allow", "block") and r.rule != "r" and r.host != "h" for r in got)
    assert len({tuple(r) for r in got if r.page_id == 2}) == 1 and next(len(r.path) for r in got if r.page_id == 1) == 50_001


def test_url_seeds_are_whole_words_and_rates_leave_the_own_host_out(spark):
    urls = [f"http://{'casino' if i % 3 == 0 else 'alphabet'}-{chr(97 + i % 20)}{i}.site{i % 4}.org/{i}" for i in range(300)] + [f"http://essex{i}.org/" for i in range(60)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id", "url", []).collect()
    right = sum((r.verdict == "block") == ("casino" in r.host) for r in got)
    assert right >= 0.9 * len(got) and not any(r.verdict == "block" for r in got if "essex" in r.host)
    # out of fold: of two hosts alone in their suffix, neither sees its own label
    sums = spark.createDataFrame([("org", "a.org", k, 1 if k else 0, 1) for k in range(2)], "suffix string, site_suffix string, fold int, s long, n long")
    rows = spark.createDataFrame([("org", "a.org", k) for k in range(2)], "suffix string, site_suffix string, fold int")
    others = sums.withColumn("other", F.explode(F.array(F.lit(0), F.lit(1)))).where("other <> fold").drop("fold").withColumnRenamed("other", "fold")
    rates = {r.fold: r.site_suffix_rate for r in url_filter._with_suffix_rates(rows, others, 0.5, ["fold"]).collect()}
    assert rates[0] > 0.5 > rates[1]


def test_toxicity_without_labels_among_the_rows(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    other = spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, other)).where("toxic").count() == 0


def test_outer_marks_of_any_number():
    import pyarrow as pa

    plain = toxicity.buckets_of(pa.array(["idiot"]))[1]
    for text in ("idiot!!!!!!!!!!", "((((((((idiot", '"idiot,"', "IDIOT?!?!?!?!?!"):
        assert toxicity.buckets_of(pa.array([text]))[1].tolist() == plain.tolist()
    assert len(toxicity.buckets_of(pa.array(["!!!! ... é!"]))[1]) == 3


def test_toxicity_chain_like_numpy():
    """Out-of-fold probabilities, links in order, and equal rows in one fold unless they are very common."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (400, 7)).astype(float)
    x[:150] = 0
    labels = np.stack([(x[:, 0] > 0) & (x[:, 1] > 0), x[:, 2] + x[:, 0] > 1], 1).astype(float)
    chain = toxicity.fit_chain(x, labels, np.arange(7))
    fold = toxicity.folds_of(x, toxicity.FOLDS)
    seen = {}
    for row, f in zip(map(tuple, x), fold):
        seen.setdefault(row, set()).add(int(f))
    assert all(len(f) == 1 for row, f in seen.items() if any(row)) and seen[(0.0,) * 7] == set(range(toxicity.FOLDS))
    before = np.zeros((len(x), 0))
    for k in range(2):
        rows = np.c_[x, before, np.ones(len(x))]
        assert np.allclose(chain.models[k], toxicity._logistic(rows, labels[:, k]))
        out = np.zeros(len(x))
        for f in range(toxicity.FOLDS):
            out[fold == f] = 1 / (1 + np.exp(-rows[fold == f] @ toxicity._logistic(rows[fold != f], labels[fold != f, k])))
        before = np.c_[before, out]
    p = chain.probabilities(x)
    first = 1 / (1 + np.exp(-np.c_[x, np.ones(len(x))] @ chain.models[0]))
    assert np.allclose(p[:, 0], first) and np.allclose(p[:, 1], 1 / (1 + np.exp(-np.c_[x, first, np.ones(len(x))] @ chain.models[1])))


def test_first_by_hash_is_exact(spark):
    rows = spark.range(60_000).withColumnRenamed("id", "k")
    for df in (rows, rows.unionAll(spark.range(50_000).select(F.lit(5).cast("long").alias("k")))):
        want = [r.k for r in df.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(700).collect()]
        assert [r.k for r in first_by_hash(df, ["k"], 700).orderBy(F.xxhash64("k"), "k").collect()] == want
    assert first_by_hash(rows.where("false"), ["k"], 5).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, monkeypatch, how):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 900).alias("k"), "id")
    table = rows.where("k < 800").groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("v"))
    want = sorted(map(str, rows.join(table.drop("n"), "k", how).select("k", "id", "v").collect()))
    for limit in (500_000, 10):
        monkeypatch.setattr("tidegrid.llm.store.BROADCAST_ROWS", limit)
        monkeypatch.setattr("tidegrid.llm.store.HOT_ROWS", 100)
        assert sorted(map(str, spread_join(rows, table, ["k"], "n", how).select("k", "id", "v").collect())) == want


def test_quality_rules_content_share_like_enumeration():
    """The decoded share of a short document is that of the best of all label sequences."""
    import itertools

    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = ["\n".join(" ".join(f"w{rng.integers(5)}" if rng.random() < 0.5 else "|$|" for _ in range(rng.integers(1, 6))) for _ in range(rng.integers(1, 7))) for _ in range(40)]
    crf = quality_rules.LinearChainCRF(rng.normal(size=(quality_rules.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lines = quality_rules.Lines(pa.array(texts))
    e = lines.features(lines.words.hashes()) @ crf.emit
    share = quality_rules._judge(pa.array(texts), crf)[7].to_pylist()
    for i in range(len(texts)):
        a, b = lines.bounds[i], lines.bounds[i + 1]
        value = lambda s: crf.first[s[0]] + sum(e[a + k, y] for k, y in enumerate(s)) + sum(crf.step[p, q] for p, q in zip(s, s[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=int(b - a)), key=value)
        words = lines.n_words[a:b]
        assert share[i] == pytest.approx(sum(w for w, y in zip(words, best) if y == 0) / words.sum())
