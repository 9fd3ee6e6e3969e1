"""Toxicity by classifier chains.

Categories are predicted one after another; each linear model sees the word
features and the probabilities of the categories before it. For training, those
probabilities are out of fold: each comes from a model that hasn't seen the
document, nor another with the same features unless these are very common, so
later links learn from what they will meet.

The labelled data name only toxic or not. The categories before the last are
weak ones: toxic documents with a word of a seed list; the last is the label. Their
models thus predict a function of features they see; only the last has a label of
its own.

Features are words of whole texts, lower-cased (A-Z), without outer points, hashed
to DIM buckets, each counted once a document. Which buckets matter is found over
all labelled documents by counts of toxic and other documents, a table of DIM rows
at most; the models are fitted on a bounded sample.

Defined results: null or empty text has no words and gets the models' bias;
repeated rows get equal results, and for the fit an id counts once, with the text
whose hash is lowest; where both classes aren't labelled among the rows, nothing is
toxic. A column of docs with the name of an added one is replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, first_by_hash, prepare
from .words import U64, Words, chunks, span_hashes

DIM = 1 << 18
SELECTED = 256
#: How far a bucket's log ratio, times the root of its toxic documents, must stand out.
MIN_Z = 3.0
#: Labelled documents of either class, first by a hash of their id, that the fit sees at most.
TRAIN_DOCS = 6_000
FOLDS = 4
THRESHOLD = 0.5
#: Seed words of the weak categories.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb"),
    "contempt": ("pathetic", "worthless", "disgusting", "trash", "scum", "garbage"),
}
CATEGORIES = (*SEEDS, "toxic")


def _mark(b: np.ndarray) -> np.ndarray:
    """ASCII, but neither letter nor digit."""
    return (b < 128) & ((b - np.uint8(48)) > 9) & ((b - np.uint8(97)) > 25) & ((b - np.uint8(65)) > 25)


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every distinct word bucket of each text, in order."""
    w = Words(texts, lower=True)
    s, e = w.starts, w.ends
    # outer ASCII marks go, however many; a word of marks alone stays as it is
    solid = np.flatnonzero(~_mark(w.buf))
    low, high = np.searchsorted(solid, s), np.searchsorted(solid, e)
    some = high > low
    if some.any():
        s, e = np.where(some, solid[np.minimum(low, len(solid) - 1)], s), np.where(some, solid[high - 1] + 1, e)
    code = np.unique(w.owner() * DIM + (span_hashes(w.buf, s, e) >> U64(40)).astype(np.int64) % DIM)
    return code // DIM, code % DIM


def seed_buckets(words) -> list[int]:
    return sorted({int(buckets_of(pa.array([x]))[1][0]) for x in words})


@dataclass
class Chain:
    """Linear models over the selected buckets and the categories before."""

    selected: np.ndarray  # ascending buckets
    models: list[np.ndarray] = field(default_factory=list)  # weights, earlier categories, bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.models:
            out = np.c_[out, _sigmoid(np.c_[x, out, np.ones(len(x))] @ w)]
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        text, bucket = buckets_of(texts)
        x = np.zeros((len(texts), len(self.selected)), np.float64)
        at = np.minimum(np.searchsorted(self.selected, bucket), max(0, len(self.selected) - 1))
        hit = self.selected[at] == bucket if len(self.selected) else np.zeros(len(bucket), bool)
        x[text[hit], at[hit]] = 1
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Newton steps; the last column is the bias and isn't shrunk."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def folds_of(x: np.ndarray, folds: int) -> np.ndarray:
    """A fold for each row, the same for equal rows, by a hash of them; rows that alone would fill half a fold are
    dealt out in turn, as a model without any of them (such as: no feature at all) would not know the usual case."""
    _, first, same, size = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    same = same.ravel()
    fold = np.array([zlib.crc32(np.asarray(x[i], float).tobytes()) % folds for i in first], int)[same]
    large = (2 * folds * size > len(x))[same]
    fold[large] = np.arange(int(large.sum())) % folds
    return fold


def fit_chain(x: np.ndarray, labels: np.ndarray, selected: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: rows x categories, in the order of the chain."""
    chain, before = Chain(selected), np.zeros((len(x), 0))
    fold = folds_of(x, folds)
    for k in range(labels.shape[1]):
        rows, y = np.c_[x, before, np.ones(len(x))], labels[:, k]
        out = np.zeros(len(x))
        for f in range(folds):
            held = fold == f
            out[held] = _sigmoid(rows[held] @ _logistic(rows[~held], y[~held]))
        chain.models.append(_logistic(rows, y))
        before = np.c_[before, out]
    return chain


def _counted(batches):
    """Labelled documents by bucket, added up over a task's batches."""
    count = np.zeros((2, DIM), np.int64)
    for b in chunks(batches, "text"):
        text, bucket = buckets_of(b.column("text"))
        toxic = np.asarray(b.column("toxic"))
        for c in (0, 1):
            count[c] += np.bincount(bucket[toxic[text] == c], minlength=DIM)
    some = np.flatnonzero(count.sum(0) > 0)
    yield pa.record_batch([pa.array(some), pa.array(count[0, some]), pa.array(count[1, some])], names=["bucket", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Chain | None:
    """None unless both classes are labelled."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return None
    small = F.broadcast(known) if sum(total.values()) <= BROADCAST_ROWS else known
    counts = text.join(small, "id").select("toxic", "text").mapInArrow(_counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # how far the share of toxic documents with a bucket stands out; SELECTED rows reach the driver
    p1, p0 = (F.col("n1") + 0.5) / (total[1] + 1), (F.col("n0") + 0.5) / (total[0] + 1)
    z = F.log(p1 / p0) * F.sqrt(F.col("n1") + 1)
    seeds = {c: seed_buckets(w) for c, w in SEEDS.items()}
    top = [r[0] for r in counts.where("n1 >= 3").where(z >= MIN_Z).orderBy(z.desc(), "bucket").limit(SELECTED).collect()]
    selected = np.array(sorted({*top, *(b for s in seeds.values() for b in s)}), np.int64)
    of = lambda c: first_by_hash(known.where(F.col("toxic") == c), ["id"], train_docs).withColumn("toxic", F.lit(c))
    few = of(1).unionAll(of(0))
    empty = Chain(selected)

    def rows(batches):
        for b in chunks(batches, "text"):
            x = empty.features(b.column("text")).astype(bool)
            yield pa.record_batch([b.column("toxic"), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], names=["toxic", "x"])

    # the broadcast side has 2 * train_docs rows at most; an id gives one row of a few dozen bytes
    one = text.join(F.broadcast(few), "id").groupBy("id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    got = one.select("toxic", "text").mapInArrow(rows, "toxic int, x binary").collect()
    if not got:
        return None
    got = sorted((bytes(r["x"]), r["toxic"]) for r in got)
    x = np.unpackbits(np.frombuffer(b"".join(g[0] for g in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(selected)].astype(float)
    toxic = np.array([g[1] for g in got], float)
    if not 0 < toxic.sum() < len(toxic):
        return None
    weak = [((x[:, np.searchsorted(selected, s)].sum(1) > 0) & (toxic > 0)).astype(float) for s in seeds.values()]
    return fit_chain(x, np.stack([*weak, toxic], 1), selected)


def score(docs: DataFrame, chain: Chain | None, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, a probability p_<category> each, and toxic."""
    prepare(docs.sparkSession)
    added = [*(f"p_{c}" for c in CATEGORIES), "toxic"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    carried = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[: len(keep)]), *(f"{c} double" for c in added[:-1]), "toxic boolean"])

    def run(batches):
        for b in chunks(batches, "__text"):
            text = b.column("__text")
            p = np.zeros((len(text), len(CATEGORIES))) if chain is None else chain.probabilities(chain.features(text))
            yield pa.record_batch([*b.columns[: len(keep)], *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= threshold)], names=[*keep, *added])

    return carried.mapInArrow(run, schema)
