"""Best-fit packing by minimum bin slack.

Texts are encoded and cut into pieces of at most ``size`` ids; pieces are packed
into sequences of that size. Only lengths matter for packing, and there are at
most ``size`` of them: the driver gets one count a length, whatever the input's
size. Per bin, a bitset subset-sum dynamic program over the lengths still
available finds the fullest combination that holds the longest of them; that
combination is removed as often as its counts allow, so the work on the driver is
bounded by the number of lengths, not of pieces.

Pieces are numbered within their length without gathering a length in one task: a
length of n pieces has cells for CELL pieces each, or for a fourth of the root of n if
that is more; pieces are dealt to its cells by a hash (of their place in the table of
pieces too, so that copies part), cells are counted, and a piece's number is its place in its cell after all earlier cells. Numbers are looked
up in the plan by binary search; the plan has one row for each length of each
combination, so it doesn't grow with the input.

Defined results: null or empty text is one piece, the end id; a null doc_id is a
key like another; rows that repeat a doc_id are pieces of their own; an empty
table packs into nothing. Texts are taken whole and only longer ones are cut.
"""

from __future__ import annotations

import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, prepare
from .tokenizer import encoder
from .words import chunks, lean

SIZE = 4096
#: Pieces of a cell at least; of very many, a fourth of the root, so that neither cells nor their number grow much.
CELL = 50


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how often) of a combination of the counted lengths that fills ``room`` best.

    Longer lengths are tried first; the program ends as soon as ``room`` can be met.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, take = counts[length], 1
        if length > room:
            continue
        left = min(left, room // length)
        while left > 0:
            n = min(take, left)
            new = (reach | reach << (n * length)) & mask
            if new != reach:
                steps.append((reach, length, n))
                reach = new
            left -= n
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    found: dict[int, int] = {}
    for before, length, n in reversed(steps):
        if not before >> at & 1:
            at -= n * length
            found[length] = found.get(length, 0) + n
    return sorted(found.items(), reverse=True)


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, their combination) until all counted lengths are used."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while left:
        top = max(left)
        left[top] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, size - top)
        left[top] += 1
        combination: dict[int, int] = {top: 1}
        for length, n in rest:
            combination[length] = combination.get(length, 0) + n
        times = min(left[k] // n for k, n in combination.items())
        for k, n in combination.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        plan.append((times, sorted(combination.items(), reverse=True)))
    return plan


def plan_rows(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, stop, a bin, bin, offset): pieces first..stop of a length lie ``a bin`` to a bin from ``bin`` on, from ``offset``."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, combination in plan:
        offset = 0
        for length, n in combination:
            first = used.get(length, 0)
            rows.append((length, first, first + times * n, n, base, offset))
            used[length] = first + times * n
            offset += n * length
        base += times
    return rows


PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id and its pieces: number, ids before it, length and checksum of its ids, cell."""
    prepare(docs.sparkSession)
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = encoder(tokenizer)
        for b in chunks(batches, "text"):
            ids, off = own.encode_ended(b.column("text"))
            raw, row, out = ids.tobytes(), [], []
            for d, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                for k, a in enumerate(range(lo, hi, size)):
                    z = min(hi, a + size)
                    row.append(d)
                    out.append((k, a - lo, z - a, zlib.crc32(raw[4 * a : 4 * z])))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.record_batch(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return keyed.mapInArrow(lean(run), f"doc_id {kind}, {PIECE}")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Every piece with its sequence_id and offset there; offsets of a sequence have no gap."""
    spread = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    found = cut(pieces(docs, tokenizer, id_col, text_col, size).withColumn("spread", spread), "pieces")
    total = {r[0]: r[1] for r in found.groupBy("length").agg(F.count("*")).collect()}  # at most ``size`` rows
    rows = plan_rows(plan_bins(total, size))
    cells = docs.sparkSession.createDataFrame([(k, -(-n // max(CELL, isqrt(n) // 4))) for k, n in total.items()], "length long, cells long")
    dealt = found.join(F.broadcast(cells), "length").withColumn("cell", F.pmod("spread", "cells")).drop("spread", "cells")
    counts = dealt.groupBy("length", "cell").agg(F.count("*").alias("n"))
    # one row a cell, so a window over a length's cells is small beside its pieces
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).select("length", "cell", "before")
    numbered = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    numbered = numbered.join(before, ["length", "cell"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("before")).alias("k"))
    return numbered.mapInArrow(_placed(rows), f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {PIECE}, sequence_id long, offset long")


def _placed(rows):
    """Looks a piece's number up in its length's part of the plan."""
    length, first, _, each, base, place = np.array(sorted(rows), np.int64).reshape(-1, 6).T
    edge = np.searchsorted(length, np.arange(int(length.max(initial=0)) + 2))

    def run(batches):
        for b in batches:
            size, k = np.asarray(b.column("length")), np.asarray(b.column("k"))
            at = np.zeros(len(k), np.int64)
            for n in np.unique(size).tolist():
                own = size == n
                at[own] = edge[n] + np.searchsorted(first[edge[n] : edge[n + 1]], k[own], side="right") - 1
            nth = k - first[at]
            yield pa.record_batch([*b.columns[:5], pa.array(base[at] + nth // each[at]), pa.array(place[at] + nth % each[at] * size)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run
