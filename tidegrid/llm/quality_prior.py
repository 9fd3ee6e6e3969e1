"""Quality by hierarchical empirical Bayes.

A linear classifier gives each document its evidence. Hosts and the paths below
them (here: a document's source and its language there) get posterior means of
that evidence: a path is shrunk toward its host, a host toward the global mean, by
strengths estimated from the corpus itself (the variance of documents within a path
over that of paths within a host, and over that of hosts; by the method of moments of
the unbalanced nested design). A site with few documents thus keeps close to what lies
above it. The result adds the site's posterior, as log-odds against the global
prior, to the document's own log-odds; for this a document's own evidence is left out
of its path and host, so that it counts once.

Site statistics are grouped sums over all documents (partial sums first, so a hot
site costs one row a task); they are joined back by site, which Spark may broadcast
only below its own size limit and splits where a site is hot.

Defined results: a null or empty text has the features of an empty text; a null
source or language is a site of its own; repeated rows get equal results and each
counts for its site; for the fit an id counts once; without labels of both classes
every document is kept at 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, first_by_hash, spread_join

#: Labelled documents of either class, first by a hash of their id, that the fit sees at most.
TRAIN_DOCS = 5_000
#: Strengths (documents that what lies above a site counts for) lie between these.
LEAST, MOST = 1.0, 1e6


def features(text: Column) -> list[Column]:
    """Lexical measures of a whole text, all built in."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t) + 1
    parts = F.split(t, r"\s+")  # by space and 0x09-0x0D: the words, and an empty part before or after them
    edge = lambda k: (F.element_at(parts, k) == "").cast("int")
    words = F.greatest(F.lit(0), F.size(parts) - edge(1) - edge(-1)) + 1
    lines = n - F.length(F.translate(t, "\n", "")) + 1
    share = lambda chars: (n - 1 - F.length(F.translate(t, chars, ""))) / n
    return [
        F.log(words.cast("double")) / 4,
        n / words / 8,
        F.least(F.lit(3.0), words / lines / 20),
        F.least(F.lit(1.0), share("#*$%&<>") * 8),
        F.least(F.lit(1.0), share("|") * 15),
        F.least(F.lit(1.0), share("!") * 15),
        F.least(F.lit(1.0), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 2),
        F.least(F.lit(1.0), share("0123456789") * 5),
        F.least(F.lit(1.0), share(".,") * 15),
        # distinct among the words: texts that say the same again and again are low
        F.size(F.array_distinct(parts)) / words,
    ]


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", train_docs: int = TRAIN_DOCS) -> np.ndarray | None:
    """Weights of the features and the bias, from a bounded sample; None unless both classes are labelled."""
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    of = lambda c: first_by_hash(known.where(F.col("y") == c), ["id"], train_docs).withColumn("y", F.lit(c))
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # the broadcast side has 2 * train_docs rows at most; an id gives one row, that of the least features
    rows = text.join(F.broadcast(of(0).unionAll(of(1))), "id").select("id", "y", F.array(*[f.cast("double") for f in features(F.col("text"))]).alias("x"))
    rows = rows.groupBy("id", "y").agg(F.min("x").alias("x")).select("y", "x").collect()
    rows = sorted((r["y"], r["x"]) for r in rows)
    y = np.array([r[0] for r in rows], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    return _logistic(np.c_[np.array([r[1] for r in rows]), np.ones(len(y))], y)


def score(docs: DataFrame, weights: np.ndarray | None, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path, evidence, host_mean, path_mean, quality (probability) and kept of every row."""
    if weights is None:
        logit = F.lit(0.0)
    else:
        logit = F.lit(float(weights[-1]))
        for w, f in zip(weights, features(F.col(f"`{text_col}`"))):
            logit = logit + F.lit(float(w)) * f
        logit = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), logit))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{host_col}`"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"), logit.alias("logit"))
    rows = cut(rows.withColumn("evidence", 1 / (1 + F.exp(-F.col("logit")))), "evidence")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q"))
    paths = cut(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("a"), F.sum(F.col("n") * F.col("n")).alias("pp"))
    mean, host_strength, path_strength = strengths(paths, hosts)
    site = paths.join(hosts.select("host", "hn", "hs"), "host").select("host", "path", "n", "s", "hn", "hs")
    out = spread_join(rows, site.withColumn("k", F.col("n")), ["host", "path"], "k")

    def posterior(own: float) -> tuple[Column, Column]:
        """(host, path) means, without the row's own evidence for ``own`` of 1."""
        host = (F.col("hs") - own * F.col("evidence") + host_strength * mean) / (F.col("hn") - own + host_strength)
        return host, (F.col("s") - own * F.col("evidence") + path_strength * host) / (F.col("n") - own + path_strength)

    inside = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    odds = lambda p: F.log(inside(p) / (1 - inside(p)))
    host_mean, path_mean = posterior(0)
    shift = odds(posterior(1)[1]) - odds(F.lit(mean))
    out = out.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean).withColumn("quality", 1 / (1 + F.exp(-(F.col("logit") + shift))))
    return out.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", "quality", (F.col("quality") >= 0.5).alias("kept"))


def strengths(paths: DataFrame, hosts: DataFrame) -> tuple[float, float, float]:
    """(mean, strength of a host's prior, strength of a path's prior), by moments of the nested design."""
    h = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("between"),
        F.sum(F.col("hq") - F.col("hs") * F.col("hs") / F.col("hn")).alias("within"), F.sum("a").alias("a"), F.sum("pp").alias("pp"), F.sum(F.col("hn") * F.col("hn")).alias("hh"),
    ).first()
    p = paths.agg(F.count("*").alias("k"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within")).first()
    n = h["n"] or 0
    if not n:
        return 0.5, LEAST, LEAST
    mean = h["s"] / n
    noise = max(p["within"], 0.0) / max(1, n - p["k"])
    of_path = of_host = 0.0
    if p["k"] > h["k"] and n > h["a"]:
        of_path = max(0.0, (h["within"] - p["within"] - (p["k"] - h["k"]) * noise) / (n - h["a"]))
    if h["k"] > 1 and n * n > h["hh"]:
        of_host = max(0.0, (h["between"] - n * mean * mean - (h["k"] - 1) * noise - (h["a"] - h["pp"] / n) * of_path) / (n - h["hh"] / n))
    ratio = lambda v: float(min(MOST, max(LEAST, noise / v))) if v > 0 else MOST
    return float(mean), ratio(of_host), ratio(of_path)
