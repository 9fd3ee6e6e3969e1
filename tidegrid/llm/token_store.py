"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Layout of a store folder:

- ``NNNNN.ids``: the payload of a shard, ids of its documents on end, in ascending
  key order, little-endian unsigned, 2 or 4 bytes each; no separators.
- ``NNNNN.idx``: the shard's index: a minimal perfect hash over its keys (a
  cascade of bit arrays; a key's slot is the rank of its bit), and by slot a
  stored 64-bit fingerprint, the offset of the document in the payload and its
  length, both in ids.
- ``manifest.json``: id width, and for each shard its first key, how many rows of that key
  lie in earlier shards, its documents, its ids and those before it.

A lookup takes the shard by its first key, the slot by at most LEVELS probes, and
compares the fingerprint, so a key that isn't there is told as missing.

Files are written under a name of their own and then renamed, so a task that runs
again, or twice, leaves the same files. There is a shard for each SHARD_BYTES of text, so
shards and indexes stay as large as they are however many documents there are. Documents
are dealt to shards by ranges of (key, hash of the text) taken from a sample of SAMPLE rows
a shard; the hash parts rows that repeat a key, which may fill several shards (rows equal in
key and text lie in one). Ids, not texts, are shuffled.

Defined results: null or empty text has the end id alone; a null key sorts first;
rows that repeat a key are all kept, told apart by their number among equals
(by a hash of their texts); an empty table gives a store without shards. A vocabulary
above what 2 bytes hold takes 4.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import prepare
from .tokenizer import END, encoder
from .words import U64, chunks, mix, span_hashes

LEVELS = 32
#: Bytes of text aimed at in a shard, rows sampled for each shard's bounds, and the bytes read from a payload at once.
SHARD_BYTES, SAMPLE, READ = 256 << 20, 20, 8 << 20
#: Numbers of a repeated key that are made in one row's sequence at most.
NUMBERS = 10_000


# --- minimal perfect hash ------------------------------------------------------------------


class PerfectHash:
    """Keys (distinct 64-bit) to 0..n-1 by a cascade of collision-free bit arrays."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        counts = np.cumsum([0] + [int(b.sum()) for b in bits])
        self.base = counts[:-1]
        self.size = int(counts[-1]) + len(rest)
        self.rank = [np.cumsum(b) - b for b in bits]

    @staticmethod
    def _at(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(keys ^ mix(np.full(1, level + 1, U64))) % U64(m)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        keys, bits = np.asarray(keys, U64), []
        while len(keys) and len(bits) < LEVELS:
            m = max(8, 2 * len(keys))
            at = cls._at(keys, len(bits), m)
            hits = np.bincount(at, minlength=m)
            bits.append(hits == 1)
            keys = keys[hits[at] > 1]
        return cls(bits, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that aren't in the set, others get any slot."""
        keys = np.asarray(keys, U64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, b in enumerate(self.bits):
            at = self._at(keys[left], k, len(b))
            hit = b[at]
            out[left[hit]] = self.base[k] + self.rank[k][at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.searchsorted(self.rest, keys[left])
            ok = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[left])
            out[left[ok]] = self.size - len(self.rest) + at[ok]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.bits), len(self.rest), *[len(b) for b in self.bits]], "<i8")
        return head.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.bits) + self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, raw: memoryview) -> tuple["PerfectHash", int]:
        n, rest = np.frombuffer(raw, "<i8", 2).tolist()
        sizes = np.frombuffer(raw, "<i8", n, 16).tolist()
        at, bits = 16 + 8 * n, []
        for m in sizes:
            k = (m + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, k, at), count=m).astype(bool))
            at += k
        return cls(bits, np.frombuffer(raw, "<u8", rest, at)), at + 8 * rest


def key_hashes(keys: pa.Array, number: np.ndarray) -> np.ndarray:
    """64-bit hash of each key and its number among equal keys."""
    null = np.asarray(keys.is_null())
    if pa.types.is_integer(keys.type):
        h = mix(keys.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(U64))
    else:
        from .words import buffer_of

        buf, off = buffer_of(keys.cast(pa.string()))
        h = span_hashes(buf, off[:-1], off[1:])
    h = np.where(null, U64(0x5851F42D4C957F2D), h)
    return mix(h + np.asarray(number, U64) * U64(0xDA942042E4DD58B5))


def index_bytes(hashes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    ph = PerfectHash.build(hashes)
    slot = ph.slots(hashes)
    table = np.zeros(len(hashes), [("print", "<u8"), ("offset", "<u8"), ("length", "<u8")])
    table["print"][slot], table["offset"][slot], table["length"][slot] = mix(~hashes), offsets, lengths
    return ph.dump() + table.tobytes()


class Index:
    def __init__(self, raw: bytes):
        self.hash, at = PerfectHash.load(memoryview(raw))
        self.table = np.frombuffer(raw, [("print", "<u8"), ("offset", "<u8"), ("length", "<u8")], self.hash.size, at)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key."""
        slot = self.hash.slots(hashes)
        if not self.hash.size:
            return np.zeros(len(hashes), bool), slot, slot
        row = self.table[np.maximum(slot, 0)]
        found = (slot >= 0) & (row["print"] == mix(~np.asarray(hashes, U64)))
        return found, row["offset"].astype(np.int64), row["length"].astype(np.int64)


# --- files ---------------------------------------------------------------------------------


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _read(path: str) -> bytes:
    fs, at = _fs(path)
    with fs.open_input_file(at) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    fs, at = _fs(path)
    own = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, at)


class _Shard:
    """Writes one shard as its rows come, in key order."""

    def __init__(self, path: str, k: int, width: int):
        self.k, self.width, self.name = k, width, f"{path}/{k:05d}"
        self.fs, at = _fs(self.name + ".ids")
        self.at, self.own = at, f"{at}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.hashes, self.lengths, self.last, self.number, self.first = [], [], None, -1, None

    def add(self, keys: pa.Array, ids: list[bytes]) -> None:
        numbers, listed = [], keys.to_pylist()
        if not self.hashes:
            self.first = self.last = listed[0]
        for key in listed:
            self.number = self.number + 1 if key == self.last else 0
            self.last = key
            numbers.append(self.number)
        self.hashes.append(key_hashes(keys, np.array(numbers, np.int64)))
        self.lengths.append(np.array([len(b) // self.width for b in ids], np.int64))
        self.out.write(b"".join(ids))

    def close(self) -> dict:
        """first and last: keys; tail: how many rows have the last one."""
        self.out.close()
        self.fs.move(self.own, self.at)
        lengths = np.concatenate(self.lengths)
        _write(self.name + ".idx", index_bytes(np.concatenate(self.hashes), np.cumsum(lengths) - lengths, lengths))
        return {"shard": self.k, "first": self.first, "last": self.last, "tail": self.number + 1, "docs": len(lengths), "ids": int(lengths.sum())}


def _ranked(key) -> tuple:
    """A key's place: null before all others."""
    return (key is not None, key if key is not None else 0)


def _bounds(rows: DataFrame, shards: int) -> list[tuple]:
    """Ascending (*_ranked(key), hash) that part about equal numbers of rows; about SAMPLE * shards sampled rows reach the driver."""
    share = SAMPLE * shards / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("key", "hash"), F.lit(1 << 40)) < int(share * (1 << 40)))
    # rows equal in key and hash lie in one shard whatever the bounds
    found = sorted({(*_ranked(k), h) for k, h in rows.distinct().limit(4 * SAMPLE * shards).collect()})
    return sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else []


class Deal:
    """The shard of a key and its number among equals, from each shard's first key and the rows of that key before it."""

    def __init__(self, shards: list[dict]):
        self.shard = [s["shard"] for s in shards]
        self.begin = [(_ranked(s["first"]), s["before"]) for s in shards]

    def __call__(self, keys: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, number within the shard) of each key; a shard all the same where there is no such key."""
        at = np.zeros(len(keys), np.int32)
        own = np.asarray(numbers, np.int64).copy()
        for i, (key, number) in enumerate(zip(keys.to_pylist(), own.tolist())):
            whole = _ranked(key)
            k = max(0, bisect_right(self.begin, (whole, number)) - 1)
            if self.begin[k][0] == whole:
                own[i] -= self.begin[k][1]
            at[i] = self.shard[k]
        return at, own


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, width: int | None = None) -> dict:
    """Encode every text, append the end id, and write the store; returns its manifest."""
    spark = docs.sparkSession
    prepare(spark)
    least = encoder(tokenizer).width
    width = width or least
    if width < least:
        raise ValueError(f"ids of this vocabulary take {least} bytes")
    keyed = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    kind = keyed.schema["key"].dataType.simpleString()
    key_type = keyed.select("key").limit(0).toArrow().schema.field(0).type
    if shards is None:
        size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    bounds = _bounds(keyed.select("key", "hash"), shards)
    fs, at = _fs(path)
    fs.create_dir(at, recursive=True)

    def encode(batches):
        own = encoder(tokenizer)
        for b in chunks(batches, "text"):
            ids, off = own.encode_ended(b.column("text"))
            raw = ids.astype(f"<u{width}").tobytes()
            cuts = [raw[width * off[i] : width * off[i + 1]] for i in range(b.num_rows)]
            shard = [bisect_right(bounds, (*_ranked(k), h)) for k, h in zip(b.column("key").to_pylist(), b.column("hash").to_pylist())]
            yield pa.record_batch([pa.array(shard, pa.int32()), b.column("key"), b.column("hash"), pa.array(cuts, pa.binary())], names=["shard", "key", "hash", "ids"])

    def store(batches):
        now, done = None, []
        for b in batches:
            shard = np.asarray(b.column(0))
            cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)] if len(shard) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if now is None or now.k != shard[i]:
                    if now:
                        done.append(now.close())
                    now = _Shard(path, int(shard[i]), width)
                now.add(b.column(1).slice(i, j - i), b.column(2).slice(i, j - i).to_pylist())
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("first", key_type), ("last", key_type), ("tail", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ids = keyed.mapInArrow(encode, f"shard int, key {kind}, hash long, ids binary")
    dealt = ids.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("key"), "hash", "ids").select("shard", "key", "ids")
    rows = sorted((r.asDict() for r in dealt.mapInArrow(store, f"shard int, first {kind}, last {kind}, tail long, docs long, ids long").collect()), key=lambda r: r["shard"])
    start, before, last = 0, 0, None
    for k, r in enumerate(rows):
        r["start"], r["before"] = start, before if k and r["first"] == last else 0
        before = r["tail"] + (r["before"] if r["first"] == r["last"] else 0)
        start, last = start + r["ids"], r.pop("last")
        r.pop("tail")
    manifest = {"width": width, "end": END, "shards": rows}
    _write(f"{path}/manifest.json", json.dumps(manifest).encode())
    return manifest


def open_store(path: str) -> dict:
    return json.loads(_read(f"{path}/manifest.json"))


def _payloads(path: str, k: int, width: int, offset: np.ndarray, length: np.ndarray):
    """The bytes of each document, read in runs of near places."""
    fs, at = _fs(f"{path}/{k:05d}.ids")
    out: list[bytes] = [b""] * len(offset)
    order = np.argsort(offset, kind="stable")
    with fs.open_input_file(at) as f:
        i = 0
        while i < len(order):
            j = i + 1
            lo = int(offset[order[i]])
            hi = lo + int(length[order[i]])
            while j < len(order) and offset[order[j]] - hi < 4096 and (offset[order[j]] + length[order[j]] - lo) * width <= READ:
                hi = max(hi, int(offset[order[j]] + length[order[j]]))
                j += 1
            block = f.read_at(width * (hi - lo), width * lo)
            for d in order[i:j]:
                a = width * (int(offset[d]) - lo)
                out[d] = block[a : a + width * int(length[d])]
            i = j
    return out


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys (key, number): key, number, found, start (ids of all documents before it), n_tokens, ids_crc32 (of
    unsigned 32-bit ids) and ids (the payload as written) of each, by the index."""
    prepare(spark)
    manifest = open_store(path)
    width, starts = manifest["width"], {s["shard"]: s["start"] for s in manifest["shards"]}
    kind = keys.schema["key"].dataType.simpleString()
    deal_of = Deal(manifest["shards"])

    def deal(batches):
        for b in batches:
            if starts:
                shard, own = deal_of(b.column(0), np.asarray(b.column(1)))
                yield pa.record_batch([pa.array(shard), b.column(0), b.column(1), pa.array(own)], names=["shard", "key", "number", "own"])

    def read(batches):
        index, now = None, None
        for b in batches:
            shard = np.asarray(b.column(0))
            for k in np.unique(shard).tolist():
                part = b.filter(pa.array(shard == k))
                if k != now:
                    index, now = Index(_read(f"{path}/{k:05d}.idx")), k
                found, offset, length = index.find(key_hashes(part.column(1), np.asarray(part.column(3))))
                offset, length = np.where(found, offset, 0), np.where(found, length, 0)
                ids = _payloads(path, k, width, offset, length)
                crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in ids]
                yield pa.record_batch(
                    [part.column(1), part.column(2), pa.array(found), pa.array(offset + starts[k]), pa.array(length), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                    names=["key", "number", "found", "start", "n_tokens", "ids_crc32", "ids"],
                )

    dealt = keys.select("key", F.col("number").cast("long")).mapInArrow(deal, f"shard int, key {kind}, number long, own long")
    dealt = dealt.repartitionById(max([0, *starts]) + 1, F.col("shard"))
    return dealt.mapInArrow(read, f"key {kind}, number long, found boolean, start long, n_tokens long, ids_crc32 long, ids binary")


def keys_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, number) of every row: repeated keys are numbered from 0."""
    counts = docs.groupBy(F.col(f"`{id_col}`").alias("key")).agg(F.count("*").alias("n"))
    blocks = counts.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / NUMBERS))).alias("block"))
    first = F.col("block") * NUMBERS
    return blocks.select("key", F.explode(F.sequence(first, F.least(first + NUMBERS, F.col("n")) - 1)).alias("number"))
