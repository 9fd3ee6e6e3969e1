"""What a worker holds: at most so many bytes a shingle, a signature and a cached word."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import ngram_join, tokenizer, words


def _peak(run):
    """Most bytes that were held above those at the start, and what run returns."""
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def _sets(n: int, size: int):
    rng = np.random.default_rng(3)
    return [(i + 1, np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))) for i in range(n)]


def test_counting_shingles_takes_few_bytes_each():
    sets = _sets(200, 2_000)
    total = sum(len(s) for _, s in sets)
    peak, rows = _peak(lambda: sum(1 for _ in ngram_join._count_rows(sets, 64)))
    assert rows == 64 and peak < 60 * total


def test_signatures_take_few_bytes_each():
    sids = [i for i, _ in _sets(400, 300)]
    blobs = [ngram_join._short(s) for _, s in _sets(400, 300)]
    batch = pa.record_batch([pa.array(sids), pa.array(sids), pa.array(blobs, pa.binary())], names=["sid", "comp", "items"])
    count = sum(len(np.unique(ngram_join.signatures(words.mix(ngram_join._long(b))))) for b in blobs)
    peak, sent = _peak(lambda: sum(len(b) for out in ngram_join._signature_rows(16, False, 0, False)([batch]) for b in out.column("blob").to_pylist()))
    assert sent >= 6 * count and peak < 65 * count


@pytest.mark.parametrize("buckets", [1, 7, 64, 70_000])
def test_items_go_to_the_bucket_of_their_top_bits(buckets):
    rng = np.random.default_rng(5)
    items = np.sort(np.r_[rng.integers(0, 2**63, 2_000).astype(np.uint64) * np.uint64(2), np.uint64(0), np.uint64(2**64 - 1)])
    owner = rng.integers(0, 9, len(items))
    sids = np.arange(10, 19).astype(np.uint64)
    want = sorted((((int(x) >> 48) * buckets) >> 16, int(o) + 10, int(x) & (2**48 - 1)) for x, o in zip(items, owner))
    got = []
    for k, blob in ngram_join._send(items, owner, sids, np.zeros((9, 0), np.uint8), buckets):
        own, counts, _, low = ngram_join._unpack(blob, 0)
        got += [(k, int(s), int(x)) for s, x in zip(np.repeat(own, counts), low)]
    assert sorted(got) == want


def test_cached_words_take_few_bytes_each():
    encoder = tokenizer.Encoder(tokenizer.public_path())
    encoder.encode(pa.array(["warm up"]))
    n = 30_000
    text = " ".join(f"w{i:x}q" for i in range(n))

    def run():
        encoder.encode(pa.array([text]))
        return tracemalloc.get_traced_memory()[0]

    assert _peak(run)[1] < 120 * n


def test_encoding_by_a_cache_that_fills_and_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenizer, "CACHE", 50)
    monkeypatch.setattr(tokenizer, "AT_ONCE", 7)
    texts = ["one two three. one!", None, "", *[" ".join(f"w{j * k}" for j in range(30)) for k in range(9)], "<|x|> a one"]
    small = tokenizer.Encoder(tokenizer.public_path())
    for k in range(0, len(texts), 2):
        some = texts[k : k + 2]
        ids, off = small.encode(pa.array(some, pa.string()))
        plain = [small.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [ids[a:z].tolist() for a, z in zip(off[:-1], off[1:])] == plain


def test_a_task_trims_at_its_end(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "trim", lambda: calls.append(1))
    assert list(words.lean(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4] and calls == [1]
