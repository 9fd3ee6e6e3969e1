"""Quality rules: a linear-chain CRF labels each line content or boilerplate.

Viterbi decoding runs over the lines of a document; the share of its words that
lie in content lines decides whether it stays. Plain counts (words, symbols,
repeated lines and windows) form a base rule that rejects on its own.

Labels name whole documents, not lines. The fit starts from lines that have the label
of their document, one by one, and then takes turns: lines are decoded under the model
so far, in their order in the document, where a document's label must stay true of the
larger part of its words (else all its lines have the label); and emissions and
transitions are fitted on these lines in their order.

Defined results: null or empty text has no words, lines or counts and fails the
base rule; each row is judged on its own, so repeated rows get equal results; for the
fit an id counts once, with the text whose hash is lowest. A column of docs with the
name of an added one is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import LinearChainCRF
from .store import first_by_hash, prepare
from .words import Words, chunks, lean, mix, rolling, span_hashes, sums_between

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CONTENT_SHARE = 0.5
#: At most so many labelled documents of either class are used to fit, none over so many characters.
TRAIN_DOCS, TRAIN_CHARS = 800, 200_000
#: Turns of decoding and fitting.
TURNS = 2
N_FEATURES = 16
FIT_SCHEMA = "quality int, n_words binary, features binary"


def _is(buf: np.ndarray, chars: bytes) -> np.ndarray:
    hit = buf == chars[0]
    for c in chars[1:]:
        hit = hit | (buf == c)
    return hit


class Lines:
    """Lines that hold a word, with their features, for a batch of texts."""

    def __init__(self, texts: pa.Array):
        w = self.words = Words(texts)
        buf, n = w.buf, len(w.buf)
        cuts = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, w.offsets]))
        starts, ends = cuts[:-1], cuts[1:]
        if n:
            ends = ends - (buf[ends - 1] == 10)
        first = np.searchsorted(w.starts, starts)
        last = np.searchsorted(w.starts, ends)
        full = last > first
        self.starts, self.ends, self.first, self.n_words = starts[full], ends[full], first[full], (last - first)[full]
        self.doc = np.searchsorted(w.offsets, self.starts, side="right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(w.docs + 1))
        key = mix(span_hashes(buf, self.starts, self.ends) ^ mix(self.doc.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        self.repeated = np.zeros(len(key), bool)
        self.repeated[order[1:]] = key[order[1:]] == key[order[:-1]]

    def features(self, hashes: np.ndarray) -> np.ndarray:
        buf, s, e = self.words.buf, self.starts, self.ends
        x = np.zeros((len(s), N_FEATURES), np.float32)
        if not len(s):
            return x
        size = np.maximum(e - s, 1)
        share = lambda flags: sums_between(flags, s, e) / size
        tail = buf[self.words.ends[self.first + self.n_words - 1] - 1]
        head = buf[self.words.starts[self.first]]
        # words equal to the word before them or two before, as far as in the line
        same = np.zeros(len(hashes), bool)
        same[1:] |= hashes[1:] == hashes[:-1]
        same[2:] |= hashes[2:] == hashes[:-2]
        x[:, 0] = 1
        x[:, 1] = np.log1p(self.n_words) / 4
        x[:, 2] = self.n_words < 3
        x[:, 3] = _is(tail, b".!?:;\"'")
        x[:, 4] = np.minimum(1, 4 * share(_is(buf, SYMBOLS)))
        upper = share((buf >= 65) & (buf <= 90))
        x[:, 5] = np.minimum(1, 2 * upper)
        x[:, 6] = np.minimum(1, 3 * share((buf >= 48) & (buf <= 57)))
        x[:, 7] = np.minimum(1, 8 * share(buf == 124))
        x[:, 8] = np.minimum(1, 8 * share(buf == 33))
        x[:, 9] = np.minimum(1, 10 * share(_is(buf, b"<>{}[]\\=_/@")))
        x[:, 10] = np.minimum(2, size / self.n_words / 10)
        x[:, 11] = sums_between(same, self.first, self.first + self.n_words) / self.n_words
        x[:, 12] = self.repeated
        x[:, 13] = (head >= 97) & (head <= 122)
        x[:, 14] = np.minimum(1, 10 * share(_is(buf, b".,;")))
        x[:, 15] = upper > 0.4
        return x


def _repeat_words(w: Words, hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Words of each text inside a window of ``size`` words that the text holds twice or more."""
    owner, n = w.owner(), len(hashes)
    roll = rolling(hashes, size)
    if not len(roll):
        return np.zeros(w.docs, np.int64)
    begin = np.flatnonzero(owner[: len(roll)] == owner[size - 1 :])
    key = mix(roll[begin] ^ mix(owner[begin].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    edge = np.zeros(n + 1, np.int64)
    edge[begin[twice]] += 1
    edge[begin[twice] + size] -= 1
    return np.bincount(owner, weights=np.cumsum(edge[:n]) > 0, minlength=w.docs).astype(np.int64)


def _learn_batches(batches):
    for b in chunks(batches, "text"):
        lines = Lines(b.column("text"))
        x = lines.features(lines.words.hashes())
        at = lines.bounds
        cut = lambda a: [a[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)]
        yield pa.record_batch([b.column("quality"), pa.array(cut(lines.n_words.astype("<i8")), pa.binary()), pa.array(cut(x), pa.binary())], names=["quality", "n_words", "features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", train_docs: int = TRAIN_DOCS) -> LinearChainCRF | None:
    """Fit on at most ``train_docs`` labelled documents of either class, the first by a hash of their id.

    None when no document is labelled: then each line counts as content.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("quality")).where("id is not null and quality in (0, 1)")
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    of = lambda c: first_by_hash(known.where(F.col("quality") == c), ["id"], train_docs).withColumn("quality", F.lit(c))
    few = of(0).unionAll(of(1))
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text").between(1, TRAIN_CHARS))
    # the broadcast side has 2 * train_docs rows at most, and an id gives one row
    one = text.join(F.broadcast(few), "id").groupBy("id").agg(F.first("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("quality", "text").mapInArrow(lean(_learn_batches), FIT_SCHEMA).collect()
    rows.sort(key=lambda r: (r["quality"], bytes(r["features"])))
    rows = [r for r in rows if r["features"]]
    if not rows:
        return None
    xs = [np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    bounds = np.cumsum([0] + [len(x) for x in xs])
    words = np.concatenate([np.frombuffer(r["n_words"], "<i8") for r in rows])
    return fit_lines(np.concatenate(xs).astype(float), words, np.array([r["quality"] == 0 for r in rows]), bounds)


def fit_lines(x: np.ndarray, words: np.ndarray, bad: np.ndarray, bounds: np.ndarray, turns: int = TURNS) -> LinearChainCRF:
    """A chain from the lines of labelled documents: features and words of lines, bad of documents."""
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)
    label = bad[doc].astype(int)
    crf = LinearChainCRF.fit(x, label, np.arange(len(x) + 1), 2)  # each line for itself
    at = np.arange(len(x) + 1)
    for _ in range(turns):
        tags = crf.decode(x @ crf.emit, at)
        agree = np.bincount(doc, weights=words * (tags == label), minlength=len(size))
        broken = 2 * agree < np.bincount(doc, weights=words, minlength=len(size))
        tags = np.where(broken[doc], label, tags)
        crf, at = LinearChainCRF.fit(x, tags, bounds, 2), bounds
    return crf


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_words long, content_share double, base_failed boolean, kept boolean"


def _judge(text: pa.Array, crf: LinearChainCRF | None) -> list[pa.Array]:
    lines = Lines(text)
    w = lines.words
    h = w.hashes()
    n = w.counts
    point = (w.buf & 0xC0) != 0x80
    blank = (w.buf == 0x20) | ((w.buf - np.uint8(9)) < 5)
    chars = w.per_doc(point & ~blank)
    symbols = w.per_doc(_is(w.buf, SYMBOLS))
    dup = np.bincount(lines.doc, weights=lines.repeated, minlength=w.docs).astype(np.int64)
    repeat = _repeat_words(w, h)
    if crf is None:
        content = np.ones(len(lines.doc), bool)
    else:
        content = crf.decode(lines.features(h) @ crf.emit, lines.bounds) == 0
    good = np.bincount(lines.doc, weights=content * lines.n_words, minlength=w.docs).astype(np.int64)
    share = np.where(n > 0, good / np.maximum(n, 1), 0.0)
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    kept = ~failed & (share >= MIN_CONTENT_SHARE)
    return [pa.array(a) for a in (n.astype(np.int64), chars, symbols, dup, repeat, np.diff(lines.bounds).astype(np.int64), good, share, failed, kept)]


def score(docs: DataFrame, crf: LinearChainCRF | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but those this adds) of every row and the counts, share and verdict."""
    prepare(docs.sparkSession)
    added = [c.split()[0] for c in SCORED.split(", ")]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    carried = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[: len(keep)]), SCORED])

    def run(batches):
        for b in chunks(batches, "__text"):
            yield pa.record_batch([*b.columns[: len(keep)], *_judge(b.column("__text"), crf)], names=[*keep, *added])

    return carried.mapInArrow(lean(run), schema)
