"""N-gram Jaccard join by PartEnum signatures, and its connected components.

Two sets of distinct word shingles link when their Jaccard similarity reaches
3/4, that is when their Hamming distance is at most a seventh of their summed
sizes. PartEnum turns that bound into equality: the shingle domain is cut into
N1 parts and each part into N2 sub-parts; with N1 * (K2 + 1) above the bound,
at least one part of two linked sets differs in at most K2 sub-parts, so the
two share the signature of one choice of N2 - K2 sub-parts. Sets are compared
within size bands; a set takes part in its own band and in the one below.

Steps, none of which gathers rows of one key without bound:

1. Sets: equal sets are one class; its smallest doc_id stands for it.
2. Pruning: a set of n shingles with a link shares all but n // 4 of them with
   that partner. Shingles seen in one class only are counted (first over a
   fixed hash share of all shingles, then over all shingles of what is left);
   a class with too many of them can't link and drops out. Exact, no cap.
3. PartEnum signatures of the classes left. A task sends each distinct signature
   once for each component, so a hot signature is a row a task or so.
4. Star rounds: within a signature, classes are compared with the one that comes
   first in an order that changes by round; what links is merged, and classes that
   share no signature with another component are done. Then every pair of classes
   that shares a signature, is not yet merged and passes exact bounds (sizes, and
   the distance of part histograms) is compared, so no link is lost.
5. Components of the verified links by alternating large and small stars.

Defined results: null, empty or blank text has an empty set, n_shingles 0, and
links with nothing; a text of fewer words than a shingle is one shingle; repeated
rows are equal sets and so one class, each row gets a result; a null id takes
part, and component_id is the smallest id that is not null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, cut, prepare, release, spread_join
from .words import U64, Words, chunks, lean, mix, rolling, trim

SIZE = 5
#: Share of shingles, by hash, that the first pruning looks at.
SHARE = 0.5
N2, K2, SLACK = 3, 1, 1.2
HIST, PARITY = 64, 2048
#: Star rounds go on while a round links at least this share of the pairs it compares, ROUNDS at most.
GAIN, ROUNDS = 0.02, 4
#: Shingles or signatures a task holds at once, and aimed at in a bucket.
HELD = 2_000_000
CHOICES = list(combinations(range(N2), N2 - K2))


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    roll = rolling(h, size)
    out = []
    for i in range(w.docs):
        a, b = w.bounds[i], w.bounds[i + 1]
        if b - a >= size:
            out.append(np.unique(roll[a : b - size + 1]))
        elif b > a:
            out.append(mix(rolling(h[a:b], int(b - a)) ^ U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that two different sets do not share in practice."""
    a = int(mix(s * U64(0x9FB21C651E98DF25) + U64(len(s))).sum(dtype=U64))
    b = int(np.bitwise_xor.reduce(mix(s ^ U64(0xA24BAED4963EE407)))) if len(s) else 0
    return a, b


def _sid(s: np.ndarray) -> int:
    a, b = _identity(s)
    return (a ^ ((b << 17 | b >> 47) & (2**64 - 1))) or 1


def _sampled(s: np.ndarray, share: float) -> np.ndarray:
    return s if share >= 1 else s[(s & U64(0xFFFF)) < U64(int(share * 65536))]


def _short(s: np.ndarray) -> bytes:
    """A set as 48-bit values, 6 bytes each, ascending."""
    low = np.unique(s >> U64(16)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw) -> np.ndarray:
    """Ascending values of a set stored by _short."""
    low = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :6] = low
    return full.view("<u8")[:, 0]


def _signed(x) -> np.ndarray:
    return np.asarray(x, U64).view(np.int64)


def _describe(share: float, size: int):
    def run(batches):
        for b in chunks(batches, "text"):
            sets = shingle_sets(b.column("text"), size)
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([len(_sampled(s, share)) for s in sets], pa.int64()),
                    pa.array(_signed([_sid(s) for s in sets])),
                    pa.array(_signed([_identity(s)[1] for s in sets])),
                    b.column("text_hash"),
                ],
                names=["doc_id", "n", "m", "sid", "check", "text_hash"],
            )

    return run


# --- blobs: what a task sends to a bucket, items grouped by their owner ---------------------


def _pack(sids: np.ndarray, extra: bytes, counts: np.ndarray, items: np.ndarray) -> bytes:
    low = items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.int64(len(sids)).tobytes() + sids.astype("<u8").tobytes() + counts.astype("<u4").tobytes() + extra + low.tobytes()


def _unpack(blob: bytes, width: int):
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sids = np.frombuffer(blob, "<u8", n, 8)
    counts = np.frombuffer(blob, "<u4", n, 8 + 8 * n)
    extra = np.frombuffer(blob, np.uint8, width * n, 8 + 12 * n).reshape(n, width)
    low = np.frombuffer(blob, np.uint8, offset=8 + (12 + width) * n).reshape(-1, 6)
    items = np.zeros((len(low), 8), np.uint8)
    items[:, :6] = low
    return sids, counts, extra, items.view("<u8")[:, 0]


def _send(items, owner, sids, extra, buckets):
    """Rows (bucket, blob) of ascending items, whose top bits choose the bucket: top * buckets >> 16."""
    least = -(-(np.arange(buckets + 1) << 16) // buckets)
    cut_at = np.searchsorted(items >> U64(48), least.astype(U64))
    for k in np.flatnonzero(np.diff(cut_at)):
        o, x = owner[cut_at[k] : cut_at[k + 1]], items[cut_at[k] : cut_at[k + 1]]
        order = np.argsort(o, kind="stable")
        o, x = o[order], x[order]
        start = _runs(o)
        own = o[start]
        yield int(k), _pack(sids[own], extra[own].tobytes(), np.diff(np.r_[start, len(o)]), x)


def _blob_batches(rows):
    """Record batches of (bucket, kind, blob) of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > 8 << 20:
            yield _blob_batch(held)
            held, size = [], 0
    if held:
        yield _blob_batch(held)


def _blob_batch(rows):
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


BLOBS = "bucket int, kind int, blob binary"


def _by_bucket(batches):
    """(bucket, [(kind, blob)]) from rows sorted by bucket."""
    now, held = None, []
    for b in batches:
        for k, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if k != now and held:
                yield held
                held = []
            now = k
            held.append((kind, blob))
    if held:
        yield held


def _bucketed(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where each run of rows that are equal in all columns starts."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


# --- pruning by shingles that one class alone has ------------------------------------------


def _count_rows(sets, buckets: int):
    """Of one task's distinct sets: counts of shingles shared here, and blobs of all its shingles. Empties ``sets``."""
    sids = np.array([s for s, _ in sets], U64)
    items = np.concatenate([x for _, x in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for _, x in sets])
    sets.clear()
    order = np.argsort(items)
    items, owner = items[order], owner[order]
    del order
    start = _runs(items)
    length = np.diff(np.r_[start, len(items)])
    several = np.repeat(length > 1, length)
    local = np.bincount(owner[several], minlength=len(sids))
    some = np.flatnonzero(local)
    if len(some):
        yield int(sids[0] % U64(buckets)), 1, _pack(sids[some], b"", local[some], np.zeros(0, U64))
    # owner 0 stands for several
    owner = np.where(length > 1, np.int32(0), owner[start] + np.int32(1))
    items = items[start]
    del start, length, several
    for k, blob in _send(items, owner, np.r_[U64(0), sids], np.zeros((len(sids) + 1, 0), np.uint8), buckets):
        yield k, 0, blob


def _shared_rows(source, buckets: int):
    """source yields (sid, shingles); equal sets count once in a task."""

    def rows(pairs):
        seen, held, size = set(), [], 0
        for sid, s in pairs:
            if len(s) and sid not in seen:
                seen.add(sid)
                held.append((sid, s))
                size += len(s)
            if size > HELD:
                yield from _count_rows(held, buckets)
                seen, held, size = set(), [], 0
                trim()
        if held:
            yield from _count_rows(held, buckets)

    return lambda batches: _blob_batches(rows(source(batches)))


def _shared_counts(batches):
    """(sid, shared): how many of its shingles another class has too."""
    for blobs in _by_bucket(batches):
        got_sid, got = [], []
        items, sids = [], []
        for kind, blob in blobs:
            own, counts, _, low = _unpack(blob, 0)
            if kind == 1:
                got_sid.append(own)
                got.append(counts.astype(np.int64))
            else:
                items.append(low)
                sids.append(np.repeat(own, counts))
        blobs.clear()
        if items:
            items, sids = np.concatenate(items), np.concatenate(sids)
            order = np.argsort(items)
            items, sids = items[order], sids[order]
            del order
            start = _runs(items)
            lo, hi = np.minimum.reduceat(sids, start), np.maximum.reduceat(sids, start)
            shared = np.repeat((lo != hi) | (lo == 0), np.diff(np.r_[start, len(items)])) & (sids != 0)
            own, counts = np.unique(sids[shared], return_counts=True)
            got_sid.append(own)
            got.append(counts)
        if got_sid:
            yield pa.record_batch([pa.array(_signed(np.concatenate(got_sid))), pa.array(np.concatenate(got).astype(np.int64))], names=["sid", "shared"])


def _may_link(counts: DataFrame, classes: DataFrame, m: str) -> DataFrame:
    found = counts.mapInArrow(lean(_shared_counts), "sid long, shared long").groupBy("sid").agg(F.sum("shared").alias("shared"))
    return classes.join(found, "sid", "left").where(F.coalesce("shared", F.lit(0)) >= F.col(m) - F.floor(F.col("n") / 4)).drop("shared")


# --- PartEnum ------------------------------------------------------------------------------


def _bands() -> np.ndarray:
    """First sizes of the bands: 4/3 of a size in band b lies in band b or b + 1."""
    out = [1]
    while out[-1] < 2**40:
        out.append(out[-1] * 4 // 3 + 1)
    return np.array(out)


BANDS = _bands()


def distance_bound(a: int, b: int) -> int:
    """Greatest Hamming distance of linked sets of these sizes."""
    return (a + b) // 7


def signatures(s: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set, of its own band and the one below."""
    band = int(np.searchsorted(BANDS, len(s), side="right")) - 1
    out = []
    for b in (band, band - 1):
        if b < 0:
            continue
        top = int(BANDS[b + 1]) - 1
        k = distance_bound(top, top * 4 // 3)
        n1 = int(np.ceil(SLACK * (k + 1) / (K2 + 1)))
        part = ((s * U64(0x8CB92BA72F3D8DD7)) >> U64(32)) % U64(n1)
        sub = ((s * U64(0xC2B2AE3D27D4EB4F)) >> U64(37)) % U64(N2)
        cell = (part * U64(N2) + sub).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cells, start = np.unique(cell[order], return_index=True)
        sums = np.zeros(n1 * N2, U64)
        sums[cells] = np.add.reduceat(mix(s[order]), start)
        full = np.zeros(n1 * N2, bool)
        full[cells] = True
        sums, full = sums.reshape(n1, N2), full.reshape(n1, N2)
        sig = np.empty((n1, len(CHOICES)), U64)
        has = np.empty((n1, len(CHOICES)), bool)
        place = mix(np.arange(n1, dtype=U64) + U64((b + 1) << 40))
        for c, pick in enumerate(CHOICES):
            sig[:, c] = mix(sums[:, pick].sum(1, dtype=U64) + place + U64(c))
            has[:, c] = full[:, pick].any(1)
        # parts within the bound outnumber those with an empty choice: then a choice that isn't empty is shared
        safe = n1 - k // (K2 + 1) > int((~has.all(1)).sum())
        out.append(sig[has] if safe else sig.ravel())
    return np.concatenate(out)


def _histogram(s: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount(((s * U64(0xFF51AFD7ED558CCD)) >> U64(58)).astype(np.int64), minlength=HIST), 65535).astype("<u2")


#: Bytes of a class beside its signatures: component and size; where pairs are judged, its sketches too.
BRIEF, FULL = 16, 16 + 2 * HIST + PARITY // 8


def _meta(comp: int, s: np.ndarray, sketched: bool) -> bytes:
    brief = np.uint64(comp).tobytes() + np.int64(len(s)).tobytes()
    return brief + _histogram(s).tobytes() + _parity(s).tobytes() if sketched else brief


def _parity(s: np.ndarray) -> np.ndarray:
    """Bits: whether an odd number of shingles falls to a place. Two sets differ in no more bits than elements."""
    return np.packbits(np.bincount(((s * U64(0xE7037ED1A0B428DB)) >> U64(53)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1)


def _priority(sids: np.ndarray, turn: int) -> np.ndarray:
    """Rank of classes in a round: another order each time, the same in every task."""
    return np.argsort(np.argsort(mix(sids + U64(turn)), kind="stable"), kind="stable")


def _signature_rows(buckets: int, whole: bool, turn: int, sketched: bool):
    """whole: send each class of a signature, else only the first of each component in this round's order.
    sketched: with the sketches that pairs are judged by."""

    def flush(held):
        sids = np.array([h[0] for h in held], U64)
        comp = np.array([h[1] for h in held], U64)
        if not whole:  # by component, then by this round's order; the sort below keeps it
            by = np.lexsort((_priority(sids, turn), comp))
            held[:] = [held[i] for i in by.tolist()]
            sids, comp = sids[by], comp[by]
        extra = np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(len(held), FULL if sketched else BRIEF)
        items = np.concatenate([h[3] for h in held])
        owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(h[3]) for h in held])
        held.clear()
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        del order
        if not whole:
            c = np.cumsum(np.r_[False, comp[1:] != comp[:-1]], dtype=np.int32)[owner]
            first = np.r_[True, (items[1:] != items[:-1]) | (c[1:] != c[:-1])]
            items, owner = items[first], owner[first]
            del c, first
        for k, blob in _send(items, owner, sids, extra, buckets):
            yield k, 0, blob

    def rows(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            for sid, comp, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if sid in seen:
                    continue
                seen.add(sid)
                s = mix(_long(blob.as_buffer()))
                sig = np.unique(signatures(s))
                held.append((sid & (2**64 - 1), comp & (2**64 - 1), _meta(comp & (2**64 - 1), s, sketched), sig))
                size += len(sig)
                if size > HELD:
                    yield from flush(held)
                    held, size, seen = [], 0, set()
                    trim()
        if held:
            yield from flush(held)

    return lambda batches: _blob_batches(rows(batches))


def _plausible(na, nb, a, b) -> np.ndarray:
    """Exact bounds that linked sets keep: sizes, and distances of sketches, which never exceed the sets' own."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    ok = 4 * small >= 3 * large
    if not a.shape[1]:
        return ok
    bound = (na + nb) // 7
    cut_at = 2 * HIST
    ok &= np.bitwise_count(np.ascontiguousarray(a[:, cut_at:] ^ b[:, cut_at:]).view(np.uint64)).sum(1, dtype=np.int64) <= bound
    ha, hb = (np.ascontiguousarray(x[:, :cut_at]).view("<u2") for x in (a, b))
    full = (ha == 65535).any(1) | (hb == 65535).any(1)
    return ok & (full | (np.abs(ha.astype(np.int32) - hb.astype(np.int32)).sum(1) <= bound))


def _pairs(whole: bool, turn: int, sketched: bool):
    """(a, b, hits): pairs of classes of different components that share signatures.

    Not whole: for each class b the class a that comes first in this round's order in
    most of their signatures; and (component, null, 0) of each component that shares a signature
    with another. whole: every pair.
    """

    def run(batches):
        for blobs in _by_bucket(batches):
            parts = [_unpack(blob, FULL if sketched else BRIEF) for _, blob in blobs]
            sids = np.concatenate([p[0] for p in parts])
            sid, at, back = np.unique(sids, return_index=True, return_inverse=True)
            meta = np.concatenate([p[2] for p in parts])[at]
            comp = np.ascontiguousarray(meta[:, :8]).view("<u8")[:, 0]
            size = np.ascontiguousarray(meta[:, 8:16]).view("<i8")[:, 0]
            sketch = np.ascontiguousarray(meta[:, 16:])
            owner = np.repeat(back, np.concatenate([p[1] for p in parts]))
            items = np.concatenate([p[3] for p in parts])
            rank = _priority(sid, turn)
            order = np.lexsort((rank[owner], comp[owner], items) if whole else (rank[owner], items))
            items, owner = items[order], owner[order]
            keep = np.r_[True, (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])]
            items, owner = items[keep], owner[keep]
            start = _runs(items)
            length = np.diff(np.r_[start, len(items)])
            found = _Pairs(sid, comp, size, sketch)
            if not whole:
                head = np.repeat(owner[start], length)
                mixed = comp[head] != comp[owner]
                active = np.unique(np.r_[comp[head[mixed]], comp[owner[mixed]]])
                found.add(head, owner)
                a, b, hits = found.best()
                yield _pair_batch(sid[a], sid[b], hits)
                if len(active):
                    yield pa.record_batch([pa.array(_signed(active)), pa.nulls(len(active), pa.int64()), pa.array(np.zeros(len(active), np.int64))], names=["a", "b", "hits"])
                continue
            # within a run rows lie by component: each is paired with those after its component's, so that
            # what the rounds have merged costs nothing
            of = comp[owner]
            inner = _runs_of(items, of)
            after = np.repeat(np.r_[inner[1:], len(items)], np.diff(np.r_[inner, len(items)]))
            reps = np.repeat(start + length, length) - after
            some = np.flatnonzero(reps)
            done = np.cumsum(reps[some])
            k = 0
            while k < len(some):
                z = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + HELD, side="right")))
                one, n = some[k:z], reps[some[k:z]]
                other = np.repeat(after[one] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                found.add(np.repeat(owner[one], n), owner[other])
                k = z
            n = len(sid)
            yield _pair_batch(sid[found.code // n], sid[found.code % n], found.hits)

    return run


def _pair_batch(a: np.ndarray, b: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(_signed(a)), pa.array(_signed(b)), pa.array(hits)], names=["a", "b", "hits"])


class _Pairs:
    """Distinct plausible pairs (first, second) of different components, and how often each was met."""

    def __init__(self, sid, comp, size, sketch):
        self.n, self.comp, self.size, self.sketch = len(sid), comp, size, sketch
        self.code, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = a[self.comp[a] != self.comp[b]], b[self.comp[a] != self.comp[b]]
        code, count = np.unique(a * self.n + b, return_counts=True)
        a, b = code // self.n, code % self.n
        ok = np.zeros(len(code), bool)
        for k in range(0, len(code), 20_000):
            p, q = a[k : k + 20_000], b[k : k + 20_000]
            ok[k : k + 20_000] = _plausible(self.size[p], self.size[q], self.sketch[p], self.sketch[q])
        self.code, at = np.unique(np.concatenate([self.code, code[ok]]), return_inverse=True)
        self.hits = np.bincount(at, weights=np.concatenate([self.hits, count[ok]]), minlength=len(self.code)).astype(np.int64)

    def best(self):
        """Of each second class, the first one it was met with most."""
        a, b = self.code // self.n, self.code % self.n
        order = np.lexsort((a, -self.hits, b))
        a, b, hits = a[order], b[order], self.hits[order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        return a[first], b[first], hits[first]


def _verify(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets link. Hot a: its set is dealt out in as many copies as its pairs need."""
    top, bottom = threshold
    per = 2_000
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / per).cast("int").alias("copies"))
    left = load.join(sets.select(F.col("sid").alias("a"), F.col("items").alias("x")), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("a", "salt", "x")
    right = (
        pairs.join(load, "a")
        .withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies").cast("long")).cast("int"))
        .select("a", "b", "salt")
        .join(sets.select(F.col("sid").alias("b"), F.col("items").alias("y")), "b")
    )

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = _long(x.as_buffer()), _long(y.as_buffer())
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(bottom * both >= top * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return left.join(right, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


# --- components ----------------------------------------------------------------------------


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of edges (a, b) that isn't a root: root is the smallest node of its component.

    Alternates large stars (all greater neighbours of a node move to its smallest)
    and small stars (all smaller neighbours) until nothing changes; a hot node's
    neighbours are only ever aggregated to a minimum and joined, not collected.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = cut(small, label)
        new = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- the operator --------------------------------------------------------------------------


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc_id, n, sid and text_hash (Spark's xxhash64) of every row (sid: its class of
    equal sets); links are verified edges (a, b) between classes that join up all linked classes."""
    spark = docs.sparkSession
    prepare(spark)
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    hashed = text.withColumn("text_hash", F.xxhash64("text"))
    members = cut(hashed.mapInArrow(lean(_describe(SHARE, size)), f"doc_id {kind}, n long, m long, sid long, `check` long, text_hash long"), "sets")
    classes = members.where("n > 0").groupBy("sid", "check").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("m").alias("m"))
    total = members.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]

    def first(batches):
        for b in chunks(batches, "text"):
            for s in shingle_sets(b.column("text"), size):
                yield _sid(s), _sampled(s, SHARE)

    buckets = max(64, -(-total // HELD))
    blobs = text.select("text").mapInArrow(lean(_shared_rows(first, buckets)), BLOBS)
    left = cut(_may_link(_bucketed(blobs), classes, "m"), "may-link")
    release(spark)
    n_left = left.count()

    def whole(batches):
        for b in chunks(batches, "text"):
            want = b.column("sid").to_pylist()
            ids, sets = [], []
            for sid, s in zip(want, shingle_sets(b.column("text"), size)):
                if int(_signed([_sid(s)])[0]) == sid:
                    ids.append(sid)
                    sets.append(_short(s))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "items"])

    small = left.select(F.col("doc_id").alias("rep"), "sid")
    small = F.broadcast(small) if n_left <= BROADCAST_ROWS else small
    sets = cut(text.join(small, text["doc_id"].eqNullSafe(F.col("rep"))).select("sid", "text").mapInArrow(lean(whole), "sid long, items binary"), "sets-left")
    # a class may be met in several rows; one of them serves
    total = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def again(batches):
        for b in batches:
            for sid, blob in zip(b.column(0).to_pylist(), b.column(1)):
                yield sid & (2**64 - 1), mix(_long(blob.as_buffer()))

    buckets = max(64, -(-total // HELD))
    left = _may_link(_bucketed(sets.mapInArrow(lean(_shared_rows(again, buckets)), BLOBS)), left, "n").select("sid")
    sets = cut(sets.join(left, "sid", "left_semi").groupBy("sid").agg(F.first("items").alias("items")), "sets-near")
    sized = sets.agg(F.coalesce(F.sum(F.length("items")), F.lit(0)), F.count("*")).first()
    links = spark.createDataFrame([], "a long, b long")
    if sized[1] < 2:
        return members, links
    release(spark)
    buckets = max(16, -(-(sized[0] // 6 * 2) // HELD))
    tried, roots, alive, turn, cross = links, None, None, 0, False
    while True:
        # alive: sid and component of the classes that may still have links to other components
        own = sets.withColumn("comp", F.col("sid")) if alive is None else sets.join(F.broadcast(alive) if n_alive <= BROADCAST_ROWS else alive, "sid")
        blobs = own.select("sid", "comp", "items").mapInArrow(lean(_signature_rows(buckets, cross, turn, turn > 0)), BLOBS)
        met = _bucketed(blobs).mapInArrow(lean(_pairs(cross, turn, turn > 0)), "a long, b long, hits long").groupBy("a", "b").agg(F.sum("hits").alias("hits"))
        met = cut(met, "met")
        pairs = met.where("b is not null")
        if not cross:  # a class may have been met with other first classes elsewhere: the one met most
            pairs = pairs.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        n_pairs = pairs.count()
        if n_pairs:
            new = cut(_verify(pairs, sets, (3, 4)), "links")
            n_new = new.count()
            if n_new:
                links = links.unionByName(new)
                # the components so far stand for the links that made them
                roots = components(new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        else:
            n_new = 0
        release(spark)
        if cross:
            break
        tried = tried.unionByName(pairs)
        labels = own.select("sid", "comp").join(met.where("b is null").select(F.col("a").alias("comp")), "comp", "left_semi").select("sid")
        labels = labels.withColumn("comp", F.col("sid")) if roots is None else labels.join(roots, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("comp"))
        alive = cut(labels, "alive")
        n_alive = alive.count()
        if not n_alive:
            break
        turn += 1
        cross = turn >= ROUNDS or n_new < GAIN * max(1, n_pairs)
    return members, links


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (of the row's set), component and low of every row.

    component names the group of linked classes (null for an empty set), low is the smallest
    doc_id in it (that of the row itself for an empty set).
    """
    members, links = link_classes(docs, id_col, text_col, size)
    full = members.where("n > 0")
    classes = cut(full.groupBy("sid", "check").agg(F.min("doc_id").alias("low"), F.count("*").alias("k")), "classes")
    roots = components(links)
    roots = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    # classes without a link are by themselves; of the others, the least id of a root's classes
    linked = classes.join(roots, F.col("sid") == F.col("node")).select("sid", "check", "low", "k", "root")
    lows = linked.groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("n_classes"))
    linked = spread_join(linked, cut(lows, "lows"), ["root"], "n_classes").select("sid", "check", F.col("root").alias("component"), F.col("least").alias("low"), "k")
    alone = classes.join(roots, F.col("sid") == F.col("node"), "left_anti").select("sid", "check", F.col("sid").alias("component"), "low", "k")
    named = spread_join(full, cut(alone.unionByName(linked), "named"), ["sid", "check"], "k")
    named = named.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("sid").alias("class"), "component", "low")
    none = F.lit(None).cast("long")
    return named.unionByName(members.where("n = 0").select("doc_id", "text_hash", F.lit(0).cast("long").alias("n_shingles"), none.alias("class"), none.alias("component"), F.col("doc_id").alias("low")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row."""
    return groups(docs, id_col, text_col, size).select("doc_id", "n_shingles", F.col("low").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of docs without near duplicates: of each group of linked rows one stays, that with the smallest id.

    Rows are told apart by id and text, never by id alone: of several with the smallest id, the one whose text
    hashes lowest stays; of rows equal in both, the least by the other columns. Ids that are null come last. Rows
    without words link with nothing and all stay.
    """
    found = cut(groups(docs, id_col, text_col, size).where("component is not null").select("doc_id", "text_hash", "component", "low"), "groups")
    first = found.where("doc_id <=> low").groupBy("component").agg(F.min("text_hash").alias("text_hash"))
    stays = found.where("doc_id <=> low").join(first, ["component", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    stays = cut(stays.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n"), "stays")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    dropped = cut(found.join(stays, same, "left_anti").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "dropped")
    again = stays.where("n > 1").select("__id", "__hash")

    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    row = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__hash"))
    kept = docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, row, "left_anti").select(*columns)
    if again.isEmpty():
        return kept
    equal = kept.join(again, row).groupBy("__id", "__hash").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*rest)) if rest else F.lit(0)).alias("row"))
    return kept.join(again, row, "left_anti").select(*columns).unionByName(equal.select("row.*"))
