"""Secret scans: patterns, and a linear-chain CRF that tags tokens begin, inside or outside of a secret.

The patterns (assignments, access keys, long hexadecimal runs) always count. The
CRF is fitted on their spans in a bounded sample and tags tokens by shape,
neighbouring tokens and file features, decoded by Viterbi; spans it finds beside
those of the patterns are added as kind ``crf``. Tokens without the shape of a
secret (8 or more characters with a digit or inner capitals) are outside by
definition, but for a point or colon that goes on a secret; inside never follows
outside. The chain thus falls into parts between tokens that are outside, and is
decoded on the parts about shaped tokens only, each with the whole tokens its
features look at and beginning with an outside token (or the text): the tags are
those of Viterbi over all tokens of the text.

Defined results: null or empty text has no spans; rows are judged one by one, so
repeated rows get equal results; for the fit an id counts once, with the text whose
hash is lowest. Offsets count code points, the end is exclusive. A column of docs
named ``spans`` is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import LinearChainCRF
from .store import first_by_hash, prepare
from .words import buffer_of, chunks, lean

# The patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+|[^\sA-Za-z0-9+/_=-]")
NEAR_WORD = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer", re.I)
#: Tokens before a token that its features look at.
BACK = 4
MIN_CRF = 12
#: Documents, first by a hash of their id, that the fit sees at most, none over so many characters.
TRAIN_DOCS, TRAIN_CHARS = 6_000, 200_000
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
N_FEATURES = 28


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def _runs_at_least(mask: np.ndarray, least: int) -> np.ndarray:
    """(start, end) rows of runs of True of at least that length."""
    stop = np.flatnonzero(~np.r_[False, mask, False])
    start, end = stop[:-1] + 1, stop[1:]
    long = end - start >= least
    return np.stack([start[long] - 1, end[long] - 1], 1)


def _candidates(texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
    """By text: whether it has a long hexadecimal run; places of its shaped tokens, ascending, in code points."""
    buf, off = buffer_of(texts)
    # a byte that no pattern takes ends each text, so that no run joins two
    buf, off = np.insert(buf, off[1:], 10), off + np.arange(len(off))
    digit = (buf - np.uint8(48)) < 10
    upper = (buf - np.uint8(65)) < 26
    lower = (buf - np.uint8(97)) < 26
    n = len(off) - 1
    hexes = np.zeros(n, bool)
    runs = _runs_at_least(digit | ((buf - np.uint8(97)) < 6), MIN_HEX)
    hexes[np.searchsorted(off, runs[:, 0], side="right") - 1] = True
    word = digit | upper | lower | (buf == 43) | (buf == 47) | (buf == 95) | (buf == 61) | (buf == 45)
    tokens = _runs_at_least(word, 8)
    places: list[list[int]] = [[] for _ in range(n)]
    if len(tokens):
        total = np.zeros((2, len(buf) + 1), np.int64)
        np.cumsum(digit, out=total[0, 1:])
        inner = upper[1:] & lower[:-1]  # a capital after a small letter
        np.cumsum(np.r_[False, inner][: len(buf)], out=total[1, 1:])
        s, e = tokens[:, 0], tokens[:, 1]
        shaped = (total[0, e] > total[0, s]) | (total[1, e] > total[1, np.minimum(s + 1, e)])
        s = s[shaped]
        owner = np.searchsorted(off, s, side="right") - 1
        points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
        for d, at in zip(owner.tolist(), (points[s] - points[off[owner]]).tolist()):
            places[d].append(at)
    return hexes, places


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s)))


def _shaped(t: str) -> bool:
    return len(t) >= 8 and (any("0" <= c <= "9" for c in t) or any("A" <= b <= "Z" and "a" <= a <= "z" for a, b in zip(t, t[1:])))


def _features(tokens: list[tuple[int, int, str]], text: str, file: tuple[float, float, float]) -> np.ndarray:
    x = np.zeros((len(tokens), N_FEATURES), np.float32)
    words = [t for _, _, t in tokens]
    for i, t in enumerate(words):
        n = len(t)
        digits = sum("0" <= c <= "9" for c in t)
        uppers = sum("A" <= c <= "Z" for c in t)
        lowers = sum("a" <= c <= "z" for c in t)
        row = x[i]
        row[0] = 1
        row[1], row[2], row[3], row[4], row[5] = n >= 8, n >= 12, n >= 16, n >= 20, n >= 32
        row[6], row[7] = digits > 0, digits == n
        row[8], row[9] = uppers > 0 and lowers > 0, uppers > 0 and digits > 0
        row[10] = digits > 0 and all(c in "0123456789abcdef" for c in t)
        row[11] = lowers == n
        row[12] = digits / n
        row[13] = sum(c in "+/_=-" for c in t) / n
        if n >= 8:
            e = _entropy(t)
            row[14], row[15], row[16] = e > 2.5, e > 3.2, e > 3.8
            kind = ["d" if "0" <= c <= "9" else "u" if "A" <= c <= "Z" else "l" for c in t]
            row[17] = sum(a != b for a, b in zip(kind, kind[1:])) / n
        back = words[max(0, i - BACK) : i]
        row[18] = bool(back) and back[-1] in (":", "=")
        row[19] = any(NEAR_WORD.search(b) for b in back)
        row[20] = bool(back) and back[-1] in ('"', "'")
        row[21] = i + 1 < len(words) and words[i + 1] in ('"', "'")
        row[22] = bool(back) and back[-1] == "."
        row[23] = i > 0 and tokens[i - 1][1] == tokens[i][0]
        row[24] = row[19] * (row[18] or row[20])
        row[25:28] = file
    return x


def _file(text: str) -> tuple[float, float, float]:
    """File features: assignments, braces and quotes in a text, by its length."""
    n = len(text) + 1
    return min(1.0, 200 * text.count("=") / n), min(1.0, 200 * (text.count("{") + text.count("}")) / n), min(1.0, 100 * text.count('"') / n)


def _goes_on(t: str) -> bool:
    """Whether a token may be inside of a secret."""
    return t in (".", ":") or _shaped(t)


def _lead(text: str, place: int, least: int) -> int:
    """Where to begin so that BACK tokens or more come before ``place``, the first of them outside; ``least`` if there aren't so many."""
    reach = 64
    while True:
        lo = max(least, place - reach)
        # tokens backward; the farthest may be cut, so it counts only at ``least``
        found = [(place - m.end(), m[0][::-1]) for m in TOKEN.finditer(text[lo:place][::-1])]
        if lo > least:
            found = found[:-1]
        for k in range(BACK - 1, len(found)):
            if not _goes_on(found[k][1]):
                return found[k][0]
        if lo == least:
            return least
        reach *= 4


def _sequences(text: str, places: list[int]):
    """Token lists (start, end, token) about the given places of shaped tokens."""
    k, at = 0, 0
    while k < len(places):
        tokens: list[tuple[int, int, str]] = []
        last = places[k]
        for m in TOKEN.finditer(text, _lead(text, places[k], at)):
            tokens.append((m.start(), m.end(), m[0]))
            at = m.end()
            if k < len(places) and places[k] < at:
                k, last = k + 1, at
            elif not _goes_on(m[0]) and m.start() >= last and (k == len(places) or _lead(text, places[k], last) >= at):
                break  # outside, and what the next shaped token looks back to comes later
        yield tokens


def _labels(tokens, spans) -> np.ndarray:
    y = np.zeros(len(tokens), np.int8)
    for a, kind, b in spans:
        begun = False
        for i, (s, e, t) in enumerate(tokens):
            if s < b and e > a and len(t) >= 8 and _shaped(t):
                y[i] = INSIDE if begun else BEGIN
                begun = True
            elif begun and a <= s < b:
                y[i] = INSIDE
    return y


def _learn(batches):
    for b in chunks(batches, "text"):
        _, places = _candidates(b.column("text"))
        xs, ys = [], []
        for text, at in zip(b.column("text").to_pylist(), places):
            if not text or not at:
                continue
            spans = base_spans(text)
            file = _file(text)
            for tokens in _sequences(text, at):
                xs.append(_features(tokens, text, file).tobytes())
                ys.append(_labels(tokens, spans).tobytes())
        yield pa.record_batch([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> LinearChainCRF | None:
    """Fit on the patterns' spans in at most ``train_docs`` documents, the first by a hash of their id.

    None when the sample has no span: then the patterns stand alone.
    """
    prepare(docs.sparkSession)
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    ids = first_by_hash(text, ["id"], train_docs)
    # the broadcast side has train_docs rows at most, and an id gives one text
    one = text.where(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(ids), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("text").mapInArrow(lean(_learn), "x binary, y binary").collect()
    rows = sorted((bytes(r["y"]), bytes(r["x"])) for r in rows)
    ys = [np.frombuffer(y, np.int8) for y, _ in rows]
    if not any(y.any() for y in ys):
        return None
    x = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, x in rows]).astype(float)
    bounds = np.concatenate([[0], np.cumsum([len(y) for y in ys])])
    return LinearChainCRF.fit(x, np.concatenate(ys).astype(int), bounds, 3)


def _emissions(crf: LinearChainCRF, x: np.ndarray, tokens: list[str]) -> np.ndarray:
    """Emissions, without the tags that a token can't have."""
    e = x.astype(float) @ crf.emit
    shaped = np.array([_shaped(t) for t in tokens], bool)
    e[~shaped, BEGIN] = -1e9
    e[~(shaped | np.array([t in (".", ":") for t in tokens], bool)), INSIDE] = -1e9
    return e


def _bound(crf: LinearChainCRF) -> LinearChainCRF:
    """The chain with inside only after begin or inside."""
    step, first = crf.step.copy(), crf.first.copy()
    step[OUTSIDE, INSIDE] = first[INSIDE] = -1e9
    return LinearChainCRF(crf.emit, step, first)


def find(texts: pa.Array, crf: LinearChainCRF | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text."""
    hexes, places = _candidates(texts)
    out, pending = [], []
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            out.append([])
            continue
        out.append(base_spans(text, bool(hexes[i])))
        if crf is not None and places[i]:
            file = _file(text)
            pending += [(i, tokens, _features(tokens, text, file)) for tokens in _sequences(text, places[i])]
    if pending:
        bounds = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in pending])])
        e = _emissions(crf, np.concatenate([x for _, _, x in pending]), [t[2] for _, tokens, _ in pending for t in tokens])
        tags = _bound(crf).decode(e, bounds)
        more: dict[int, list[tuple[int, int]]] = {}
        for k, (i, tokens, _) in enumerate(pending):
            more.setdefault(i, []).extend(_tagged(tokens, tags[bounds[k] : bounds[k + 1]]))
        for i, spans in more.items():
            starts = [a for a, _, _ in out[i]]
            ends = np.maximum.accumulate([b for _, _, b in out[i]]).tolist()
            for a, b in spans:
                n = bisect_left(starts, b)  # patterns' spans that begin before b
                if n == 0 or ends[n - 1] <= a:
                    out[i].append((a, 3, b))
    return [sorted(spans) for spans in out]


def _tagged(tokens: list[tuple[int, int, str]], tag: np.ndarray):
    """(start, end) of tagged runs of adjoining tokens of MIN_CRF characters or more."""
    j = 0
    while j < len(tokens):
        if tag[j] == OUTSIDE:
            j += 1
            continue
        last = j
        while last + 1 < len(tokens) and tag[last + 1] == INSIDE and tokens[last + 1][0] == tokens[last][1]:
            last += 1
        if tokens[last][1] - tokens[j][0] >= MIN_CRF:
            yield tokens[j][0], tokens[last][1]
        j = last + 1


SPANS = "array<struct<kind:string,start:long,stop:long>>"


def scan(docs: DataFrame, crf: LinearChainCRF | None, text_col: str = "text", keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row and ``spans``; with ``redact``, the text column has that string for each secret."""
    prepare(docs.sparkSession)
    keep = [c for c in (keep if keep is not None else docs.columns) if c != "spans"]
    carried = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[: len(keep)]), f"spans {SPANS}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for b in chunks(batches, "__text"):
            text = b.column("__text")
            found = find(text, crf)
            spans = pa.array([[{"kind": KINDS[k], "start": a, "stop": e} for a, k, e in s] for s in found], kind)
            columns = list(b.columns[: len(keep)])
            if redact is not None and text_col in keep and any(found):
                columns[keep.index(text_col)] = pa.array([_redacted(t, s, redact) if s else t for t, s in zip(text.to_pylist(), found)], text.type)
            yield pa.record_batch([*columns, spans], names=[*keep, "spans"])

    return carried.mapInArrow(lean(run), schema)


def _redacted(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
