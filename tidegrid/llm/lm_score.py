"""Language-model scoring by a weighted backoff automaton.

The model holds n-grams of 1 to ORDER words with Dirichlet smoothing:
p(v) = (c(v) + 1) / (N + V + 1), which also serves unseen words, and for a context h
p(v | h) = (c(h v) + MU p(v | h')) / (c(h) + MU), h' being h without its first word.
Its automaton has a state for each context that training has (the root: none; the
longest: ORDER - 1 words; one more for the beginning of a text). A state's arcs are the
n-grams seen after it, with log10 p(v | h); an arc leads to the longest state that ends
with its words. A state's failure arc weighs log10(MU / (c(h) + MU)) and leads to the
state of h'; the root has an arc for every word. One traversal from left to right
carries the state and adds the weights. Probabilities of a state sum to 1.

Counts cover all training tokens, without a cut-off, and never meet in one place:

1. Tasks cut the corpus into chunks: ids of tokens in a list of the chunk's distinct
   words, written to the shared folder.
2. For each order in turn, a chunk sends its distinct n-grams, as 64-bit hashes, with
   their training counts to buckets by hash; a frequent one is one item a chunk,
   whatever its count. An n-gram whose first or last n - 1 words stand in no other chunk
   stands in none either: the chunk's own count is the total, and it isn't sent.
3. A bucket adds the counts up and answers every chunk in the order of its items, with
   whether another chunk has the item too; answers are gathered to one file a chunk.
4. A chunk's task builds from its answers the part of the automaton that its own
   documents can visit, and traverses its documents.

Defined results: null or empty text is the end token alone; rows are scored one by
one, repeated rows get equal results (and each counts in training); a null id counts
as the empty string for the fold. Without training tokens every p(v) is 1. Two n-grams
of one order whose 64-bit hashes are equal would share their counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, prepare, scratch
from .token_store import _fs, _read, _write
from .words import U64, Words, chunks, mix, numbered

#: Weight of the shorter context for each order from 2 on, and the words of the longest n-grams.
MU = (300.0, 30.0)
ORDER = len(MU) + 1
END = U64(0x1F83D9ABFB41BD6B)
BEGIN = U64(0x5BE0CD19137E2179)
#: Tokens of a chunk, and items aimed at in a bucket.
CHUNK, BUCKET = 800_000, 800_000
#: Tokens that one reader of a long text takes.
SPAN = 512


def default_held_out(doc_id: str) -> bool:
    """Remainder 2 of crc32(doc_id as text) by 7."""
    return zlib.crc32(doc_id.encode()) % 7 == 2


def _squeeze(x: np.ndarray) -> bytes:
    """zstd over the byte planes of an array."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


# --- chunks --------------------------------------------------------------------------------


def _chunked(held_out: Callable[[str], bool], kind: pa.DataType, limit: int):
    def flush(number, ids, lens, hashes):
        tokens = np.concatenate(hashes)
        words, back = np.unique(tokens, return_inverse=True)
        held = np.array([held_out("" if i is None else str(i)) for i in ids], bool)
        return pa.record_batch(
            [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(kind)),
                pa.array([np.concatenate(lens).astype("<i8").tobytes()], pa.binary()),
                pa.array([held.tobytes()], pa.binary()),
                pa.array([_squeeze(back.astype("<u4"))], pa.binary()),
                pa.array([words.astype("<u8").tobytes()], pa.binary()),
                pa.array([len(tokens)], pa.int64()),
                pa.array([int(np.concatenate(lens)[~held].sum())], pa.int64()),
                pa.array([int((~held).sum())], pa.int64()),
            ],
            names=["chunk", "ids", "lens", "held", "tokens", "words", "n", "n_train", "docs_train"],
        )

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        ids, lens, hashes, size = [], [], [], 0
        for b in chunks(batches, "text", 1 << 20):
            w = Words(b.column("text"), lower=True)
            h = np.insert(w.hashes(), w.bounds[1:], END)
            ids += b.column("id").to_pylist()
            lens.append(w.counts + 1)
            hashes.append(h)
            size += len(h)
            if size > limit:
                yield flush(number, ids, lens, hashes)
                number, ids, lens, hashes, size = number + 1, [], [], [], 0
        if ids:
            yield flush(number, ids, lens, hashes)

    return run


@dataclass
class Grams:
    """The distinct n-grams of one order in a chunk."""

    at: np.ndarray  # n-gram that ends at each token; -1 where a text has begun too late for one
    prefix: np.ndarray  # all but the last word: number among those one shorter (for 2: of the word; len(words): the beginning)
    word: np.ndarray
    suffix: np.ndarray  # all but the first word: number among those one shorter
    keys: np.ndarray  # 64-bit hashes


@dataclass
class Chunk:
    """Token sequence of a chunk and its n-grams."""

    number: int
    lens: np.ndarray
    held: np.ndarray
    tokens: np.ndarray  # places in words
    words: np.ndarray  # ascending hashes

    @classmethod
    def of(cls, row: dict) -> "Chunk":
        return cls(row["chunk"], np.frombuffer(row["lens"], "<i8"), np.frombuffer(row["held"], bool), _unsqueeze(row["tokens"], "<u4").astype(np.int64), np.frombuffer(row["words"], "<u8"))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lens) - self.lens

    def grams(self, order: int) -> list[Grams]:
        """n-grams of 1 to ``order`` words."""
        n, width = len(self.words), len(self.words) + 1
        none = np.zeros(0, np.int64)
        made = [Grams(self.tokens, none, np.arange(n), none, self.words)]
        for k in range(2, order + 1):
            before = np.r_[-1, made[-1].at[:-1]]
            before[self.starts] = n if k == 2 else -1
            whole = np.flatnonzero(before >= 0)
            found, first, back = numbered(before[whole] * width + self.tokens[whole])
            at = np.full(len(self.tokens), -1, np.int64)
            at[whole] = back
            prefix, word = found // width, found % width
            shorter = np.r_[self.words, BEGIN] if k == 2 else made[-1].keys
            made.append(Grams(at, prefix, word, made[-1].at[whole[first]], mix(shorter[prefix] * U64(0x9E3779B97F4A7C15) + self.words[word])))
        return made

    def own_counts(self, gram: Grams) -> np.ndarray:
        """Training tokens by n-gram."""
        at = gram.at[np.repeat(~self.held, self.lens)]
        return np.bincount(at[at >= 0], minlength=len(gram.keys))

    def asked(self, gram: Grams, shared: np.ndarray | None) -> np.ndarray:
        """n-grams that another chunk may have, in order of their hashes; shared: whether one has those one shorter."""
        some = np.arange(len(gram.keys))
        if shared is not None:
            # the last place is for the beginning of a text, which every chunk has
            some = some[np.r_[shared, True][gram.prefix] & shared[gram.suffix]]
        return some[np.argsort(gram.keys[some])]

    def totals(self, path: str, grams: list[Grams]) -> tuple[list[np.ndarray], np.ndarray | None]:
        """Training counts in all chunks of these n-grams, and whether another chunk has those of the last order."""
        found, shared = [], None
        for k, gram in enumerate(grams, 1):
            asked, total = self.asked(gram, shared), self.own_counts(gram)
            shared = np.zeros(len(total), bool)
            if len(asked):
                answer = _answers(f"{path}/{k}/{self.number}", len(asked))
                total[asked], shared[asked] = answer >> 1, answer & 1
            found.append(total)
        return found, shared


CHUNKS = "chunk long, ids array<{}>, lens binary, held binary, tokens binary, words binary, n long, n_train long, docs_train long"


def _rows(batches):
    for b in batches:
        yield from b.to_pylist()


# --- counts --------------------------------------------------------------------------------


def _slices(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending keys (their top bits choose it)."""
    return np.searchsorted(((sorted_keys >> U64(32)) * U64(buckets)) >> U64(32), np.arange(buckets + 1, dtype=U64))


def _sent(order: int, buckets: int, path: str):
    """A chunk's items of an order, by bucket: ascending hashes and training counts."""

    def run(batches):
        for row in _rows(batches):
            c = Chunk.of(row)
            grams = c.grams(order)
            shared = c.totals(path, grams[:-1])[1]
            asked = c.asked(grams[-1], shared)
            keys, counts = grams[-1].keys[asked], c.own_counts(grams[-1])[asked].astype("<u4")
            at, own, blobs = _slices(keys, buckets), [], []
            for k in np.flatnonzero(np.diff(at)).tolist():
                steps = _squeeze(np.diff(keys[at[k] : at[k + 1]], prepend=U64(0)))
                own.append(k)
                blobs.append(np.int64(len(steps)).tobytes() + steps + _squeeze(counts[at[k] : at[k + 1]]))
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array([c.number] * len(own), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    return run


def _totals(batches):
    """Answers each chunk of a bucket, in the order of the items it sent: 2 * training count in all chunks, and 1 if another chunk has the item."""

    def groups():
        now, held = None, []
        for row in _rows(batches):
            if row["bucket"] != now and held:
                yield now, held
                held = []
            now = row["bucket"]
            held.append((row["chunk"], row["blob"]))
        if held:
            yield now, held

    for bucket, held in groups():
        keys, counts = [], []
        for _, blob in held:
            n = 8 + int(np.frombuffer(blob, "<i8", 1)[0])
            keys.append(np.cumsum(_unsqueeze(blob[8:n], "<u8"), dtype=U64))
            counts.append(_unsqueeze(blob[n:], "<u4"))
        found, _, back = numbered(np.concatenate(keys))
        holders = np.bincount(back)
        total = np.bincount(back, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
        value = (2 * total + (holders > 1)).astype("<u8")
        at = np.cumsum([0, *map(len, keys)])
        for i, (chunk, _) in enumerate(held):
            yield pa.record_batch(
                [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_squeeze(value[back[at[i] : at[i + 1]]])], pa.binary()), pa.array([int((total > 0).sum()) if i == 0 else 0], pa.int64())],
                names=["chunk", "bucket", "answer", "seen"],
            )


def _filed(path: str):
    """Writes the answers to a chunk to one file; rows come by chunk and bucket."""

    def run(batches):
        now, parts, seen = None, [], 0

        def close():
            whole = np.concatenate(parts)
            _write(f"{path}/{now}", zstandard.ZstdCompressor(level=1).compress(whole.astype("<u4" if whole.max() < 2**32 else "<u8").tobytes()))

        for row in _rows(batches):
            if row["chunk"] != now:
                if now is not None:
                    close()
                now, parts = row["chunk"], []
            parts.append(_unsqueeze(row["answer"], "<u8"))
            seen += row["seen"]
        if now is not None:
            close()
        yield pa.record_batch([pa.array([seen], pa.int64())], names=["seen"])

    return run


def _answers(path: str, total: int) -> np.ndarray:
    body = zstandard.ZstdDecompressor().decompress(_read(path), max_output_size=1 << 31)
    return np.frombuffer(body, "<u4" if len(body) == 4 * total else "<u8").astype(np.int64)


# --- the automaton -------------------------------------------------------------------------


@dataclass
class Model:
    """What all chunks share: size of the training data, smoothing, and where the answers lie."""

    n: int
    v: int
    docs: int
    mu: tuple[float, ...]
    path: str

    @property
    def order(self) -> int:
        return len(self.mu) + 1


class Automaton:
    """The part of the automaton that a chunk's documents can visit.

    A state is a length and a number: the chunk's n-gram of that many words (0: the root; of
    length 1, len(words): the beginning of a text). The arc from a state of k words over a token
    is the (k + 1)-gram that ends there, so arcs are found by number.
    """

    def __init__(self, model: Model, c: Chunk, grams: list[Grams], totals: list[np.ndarray]):
        self.grams, self.order, self.begin = grams, model.order, len(c.words)
        p = (totals[0] + 1) / (model.n + model.v + 1)
        self.arc, self.seen = [np.log10(p)], [totals[0] > 0]
        self.fail, self.fail_to = [np.zeros(1)], [np.zeros(1, np.int64)]  # the root has none
        context = np.r_[totals[0], model.docs].astype(float)
        for k, mu in enumerate(model.mu, 2):
            g, total = grams[k - 1], totals[k - 1]
            p = (total + mu * p[g.suffix]) / (context[g.prefix] + mu)
            self.arc.append(np.log10(p))
            self.seen.append(total > 0)
            self.fail.append(np.log10(mu / (context + mu)))
            self.fail_to.append(np.zeros(len(context), np.int64) if k == 2 else grams[k - 2].suffix)
            context = total.astype(float)

    def traverse(self, c: Chunk) -> np.ndarray:
        """Log10 probability of each token.

        All texts are read side by side, from left to right. A long one is entered at several places, at
        the root and ORDER - 1 tokens early: what these leave is the state that a reader from the
        beginning would have, as no state looks further back.
        """
        out, early = np.zeros(len(c.tokens)), self.order - 1
        pieces = -(-c.lens // SPAN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(c.starts, pieces) + nth * SPAN
        stop = np.minimum(first + SPAN, np.repeat(c.starts + c.lens, pieces))
        start = np.where(nth > 0, first - early, first)
        order = np.argsort(start - stop, kind="stable")
        start, stop, first = start[order], stop[order], first[order]
        at_begin = nth[order] == 0
        length = np.where(at_begin & (early > 0), 1, 0)
        state = np.where(length == 1, self.begin, 0)
        size = stop - start
        for t in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -t, side="left"))  # readers that have a token left
            at = start[:n] + t
            k_now, now = length[:n].copy(), state[:n].copy()
            weight = np.zeros(n)
            for k in range(self.order - 1, -1, -1):
                here = np.flatnonzero(k_now == k)
                arc = self.grams[k].at[at[here]]
                hit = self.seen[k][arc]
                take = hit if k else np.ones(len(here), bool)
                go, by = here[take], arc[take]
                weight[go] += self.arc[k][by]
                # to the state that ends with the arc's words: the root after an unseen word
                if k + 1 < self.order:
                    length[go], state[go] = np.where(hit[take], k + 1, 0), np.where(hit[take], by, 0)
                else:
                    length[go], state[go] = k, self.grams[k].suffix[by] if k else 0
                lost = here[~take]
                weight[lost] += self.fail[k][now[lost]]
                now[lost], k_now[lost] = self.fail_to[k][now[lost]], k - 1
            own = at >= first[:n]
            out[at[own]] = weight[own]
        return out


def _scored(model: Model, kind: pa.DataType):
    def run(batches):
        for row in _rows(batches):
            c = Chunk.of(row)
            grams = c.grams(model.order)
            totals, _ = c.totals(model.path, grams)
            own = Automaton(model, c, grams, totals)
            del totals
            for g in grams:  # the traversal needs places and suffixes only
                g.keys = g.prefix = g.word = None
            known = np.add.reduceat(own.seen[0][c.tokens].astype(np.int64), c.starts)
            base = np.add.reduceat(own.arc[0][c.tokens], c.starts)
            score = np.add.reduceat(own.traverse(c), c.starts)
            n = len(c.lens)
            for i in range(0, n, 4096):
                z = slice(i, min(n, i + 4096))
                size = z.stop - z.start
                yield pa.record_batch(
                    [pa.array(row["ids"][z], kind), pa.array(c.held[z]), pa.array(c.lens[z]), pa.array(known[z]), pa.array(np.full(size, model.n)), pa.array(base[z]), pa.array(score[z])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Callable[[str], bool] = default_held_out, mu: tuple[float, ...] = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; len(mu) + 1 is the order."""
    spark = docs.sparkSession
    prepare(spark)
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    arrow = keyed.select("id").limit(0).toArrow().schema.field(0).type
    made = cut(keyed.mapInArrow(_chunked(held_out, arrow, CHUNK), CHUNKS.format(kind)), "chunks")
    size = made.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_train", "docs_train")]).first()
    buckets = max(64, math.ceil(size["n"] / BUCKET))
    path = scratch(spark, "answers")
    seen = []
    for order in range(1, len(mu) + 2):
        fs, at = _fs(f"{path}/{order}")
        fs.create_dir(at, recursive=True)
        items = made.mapInArrow(_sent(order, buckets, path), "bucket int, chunk long, blob binary").repartition("bucket").sortWithinPartitions("bucket")
        answers = items.mapInArrow(_totals, "chunk long, bucket int, answer binary, seen long")
        filed = answers.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_filed(f"{path}/{order}"), "seen long")
        seen.append(filed.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0])
    model = Model(size["n_train"], seen[0], size["docs_train"], tuple(mu), path)
    return made.mapInArrow(_scored(model, arrow), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
