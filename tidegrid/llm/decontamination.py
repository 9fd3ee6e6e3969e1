"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

A window is 13 consecutive words of an item (all of them, if it has fewer). A
document contains a window only if it contains the window's rarest shingle, here
the word with the lowest count over all documents; containment is whole, so a
prefix of one token is the necessary one. Words of documents are joined with
these prefix tokens; what joins must have room for the window around the token
(length and positional bounds), and then equal it word by word.

Documents are read once to count the benchmark's words and once to match, whatever the
benchmark's size. Up to BROADCAST_WINDOWS windows are broadcast. Of a larger benchmark
only the distinct prefix tokens are; a word that is one of them goes, with the words
around it that its windows can span, to a shuffled join by token, where a frequent token
is dealt out in as many parts as its occurrences need. (Prefix tokens above
BROADCAST_ROWS are taken in blocks, as are words to be counted.) No document leaves the
JVM and no whole text is shuffled.

Defined results: a null or empty text has no words, no hits, and is not
contaminated; an item without words has no window; each row is judged on its own
text, so repeated rows get equal results; a benchmark without rows marks nothing.
Texts are taken whole, whatever their length. Item ids count as strings. A column of
docs with the name of an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, cut

WINDOW = 13
#: Windows that are broadcast at most.
BROADCAST_WINDOWS = 100_000
#: Occurrences of a token in one part of the shuffled join.
PART = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before lower-casing: all but ASCII characters that are neither letters nor digits. Written by what is in it:
#: the regex engine looks such a class up, where it tries the ranges of a complement one by one.
WORD = r"[\p{Alnum}\x{80}-\x{10FFFF}]+"


def _lower(word: Column) -> Column:
    """A-Z only; a word that is all ASCII takes the quick way."""
    word = F.coalesce(word, F.lit(""))  # never null: no filter is derived that would lower each word twice
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def item_windows(bench: DataFrame, item_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(item, words, n): the distinct windows of every item."""
    items = bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), _words(F.translate(text_col, UPPER, LOWER)).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.lit(size), F.size("ws"))
    return items.select("item", n.alias("n"), "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("s")).select("item", F.slice("ws", F.col("s"), F.col("n")).alias("words"), "n").distinct()


def find_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(k1, k2, n_words, spans, windows) of each document text with a match.

    k1, k2: hashes of the row's id and text; n_words: its words; spans: distinct (start, end)
    in words; windows: hashes of the windows met.
    """
    text = F.col(f"`{text_col}`")
    windows = cut(item_windows(bench, item_col, bench_text_col, size).select("words", "n").distinct().withColumn("window", F.xxhash64("words")), "windows")
    vocabulary = windows.select(F.explode("words").alias("w")).distinct()
    seen = docs.select(F.explode_outer(_words(text)).alias("raw")).select(_lower(F.col("raw")).alias("w"))
    if vocabulary.count() <= BROADCAST_ROWS:
        counts = F.broadcast(seen.join(F.broadcast(vocabulary), "w").groupBy("w").agg(F.count("*").alias("c")))
    else:
        counts = seen.groupBy("w").agg(F.count("*").alias("c")).join(vocabulary, "w")
    ranked = windows.select("window", "n", "words", F.posexplode("words").alias("off", "w")).join(counts, "w")
    # windows with a word that no document has can't occur
    whole = ranked.groupBy("window", "n", "words").agg(F.count("*").alias("found"), F.min(F.struct("c", "w", "off")).alias("rare"))
    prefix = whole.where("found = n").select(
        F.col("rare.w").alias("token"), "window", F.col("n").alias("wn"), F.array_join("words", " ").alias("whole"), F.col("rare.off").alias("off"), F.col("rare.c").alias("c")
    )
    prefix = cut(prefix, "prefix")
    ws = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("k1"), F.hash(text, F.lit(1)).alias("k2"), _words(text).alias("ws"))
    # outer, as else a filter is derived that splits each text twice; expressions below are all compiled
    # into the stage of the join, so that a text's array is copied for rows that match only
    at = ws.select("k1", "k2", "ws", F.posexplode_outer("ws").alias("pos", "raw")).withColumn("token", _lower(F.col("raw")))
    begin = F.col("pos") - F.col("off")

    def met(words: Column, base: Column, n_words: Column) -> tuple[Column, Column]:
        """Room for the window in the text, and equality; ``words`` are those from ``base`` on."""
        room = (begin >= 0) & (begin + F.col("wn") <= n_words)
        return room, _lower(F.array_join(F.slice(words, F.greatest(begin - base + 1, F.lit(1)), F.col("wn")), " ")) == F.col("whole")

    out = ["k1", "k2", "window", "n_words", begin.alias("start"), (begin + F.col("wn")).alias("stop")]
    if prefix.count() <= BROADCAST_WINDOWS:
        room, same = met(F.col("ws"), F.lit(0), F.size("ws"))
        hits = at.join(F.broadcast(prefix), "token").where(room).where(same).withColumn("n_words", F.size("ws")).select(*out)
    else:
        dealt = prefix.withColumn("parts", F.ceil(F.col("c") / PART).cast("int"))
        tokens = dealt.select("token", "parts").distinct()
        blocks = -(-tokens.count() // BROADCAST_ROWS)
        base = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        near = [base.alias("base"), F.slice("ws", base + 1, F.lit(2 * size - 1)).alias("near"), F.size("ws").alias("n_words"), F.pmod(F.xxhash64("k1", "pos"), "parts").cast("int").alias("part")]
        found = [at.join(F.broadcast(tokens.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == k)), "token").select("k1", "k2", "pos", "token", *near) for k in range(blocks)]
        candidates = found[0]
        for f in found[1:]:
            candidates = candidates.unionByName(f)
        copies = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        room, same = met(F.col("near"), F.col("base"), F.col("n_words"))
        hits = candidates.join(copies, ["token", "part"]).where(room).where(same).select(*out)
    return hits.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.collect_set("window").alias("windows"))


def _covered(spans: Column) -> Column:
    """Positions inside any of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def add(acc, s):
        return F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["to"], s["start"])).cast("long")).alias("n"), F.greatest(acc["to"], s["stop"]).alias("to"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated: as by ``mark``, but words are counted for rows with a hit only."""
    hits = find_hits(docs, bench, id_col, text_col, item_col, bench_text_col, size)
    bad = cut(hits.where(20 * _covered(F.col("spans")) >= F.col("n_words")).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    text = F.col(f"`{text_col}`")
    same = (F.xxhash64(F.col(f"`{id_col}`"), text) == F.col("__k1")) & (F.hash(text, F.lit(1)) == F.col("__k2"))
    return docs.join(bad, same, "left_anti")


def mark(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", size: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, with n_words, n_hit, items (sorted ids as strings) and contaminated."""
    text = F.col(f"`{text_col}`")
    hits = find_hits(docs, bench, id_col, text_col, item_col, bench_text_col, size)
    hits = cut(hits.drop("n_words"), "hits")
    named = item_windows(bench, item_col, bench_text_col, size).select(F.xxhash64("words").alias("window"), "item").distinct()
    items = hits.select("k1", "k2", F.explode("windows").alias("window")).join(named, "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = hits.select("k1", "k2", _covered(F.col("spans")).alias("n_hit")).join(items, ["k1", "k2"], "left")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_words", "n_hit", "items", "contaminated")]
    base = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("__k1"),
        F.hash(text, F.lit(1)).alias("__k2"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("n_words"),
    )
    out = base.join(found, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )
