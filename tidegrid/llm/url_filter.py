"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

DataFrame operations only. A rule names a host and a path; it fits that host and
its subdomains where the url's path begins with the rule's, and the longest rule
wins. Urls without a rule are judged by boosted trees over lengths, depth, digit
ratios, entropy, parameter counts and suffix statistics. The trees are trained on
labelled urls: by default those with a seed word between the dots, hyphens and digits
of their host (labelled block)
against those that a rule allows or no rule fits (labelled allow; rules that block
whole sites are policy and label nothing); a labelled table can be given instead.
The fit takes a bounded sample of features to the driver; scoring is a projection
of nested CASEs.

Suffix statistics (share of blocked urls among labelled ones, by the host's last
label and by its last two) cover all labelled urls, summed in groups and joined
back by suffix; a suffix without labels takes the share of what lies above it. For
training they are out of fold: hosts are dealt to FOLDS folds, and a url gets the
statistics of the others, so that none holds its own label or one of its host.

Defined results: a null url, or one without ``://``, has empty host and path and no
rule, and is judged by the trees as such; repeated rows get equal results; without
labels of both classes the method allows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, first_by_hash, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query, and seed words that label a host.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SEED_WORDS = ["adult", "bet", "casino", "cheap", "escort", "loan", "pills", "poker", "porn", "replica", "sex", "spam", "viagra", "xxx"]
#: Labelled urls, first by a hash, that the fit sees at most; folds of their suffix statistics.
TRAIN_URLS, FOLDS = 20_000, 5
TREES, DEPTH, RATE, BINS = 20, 3, 0.3, 24
SMOOTH = 20.0
FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio",
    "entropy", "parameters", "fragment", "secure", "longest_label", "suffix_rate", "site_suffix_rate",
]


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what follows the path)."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    behind = F.substring(rest, F.length(raw) + 1, F.length(rest))
    path = F.regexp_extract(behind, r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path, F.substring(behind, F.length(path) + 1, F.length(behind))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones the first by text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        at = r.index("/")
        fits = ((host == r[:at]) | host.endswith("." + r[:at])) & path.startswith(r[at:])
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _lexical(df: DataFrame) -> DataFrame:
    """Adds all features but the suffix rates; needs url, host, path and tail."""
    url, host, path, tail = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path"), F.col("tail")
    digits = "0123456789"
    shares = F.transform(F.array_distinct(F.split(host, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(host) - F.length(F.replace(host, c, F.lit("")))) / (F.length(host) + 0.0)))
    made = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(tail),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "labels": _count(host, "."),
        "hyphens": _count(host, "-"),
        "digit_ratio": _count(url, digits) / (F.length(url) + 1),
        "host_digit_ratio": _count(host, digits) / (F.length(host) + 1),
        "entropy": F.when(host == "", 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))),
        "parameters": F.when(tail.startswith("?"), _count(tail, "&") + 1).otherwise(0),
        "fragment": F.contains(tail, F.lit("#")).cast("int"),
        "secure": url.startswith("https://").cast("int"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)),
    }
    labels = F.split(host, r"\.")
    keys = {"suffix": F.element_at(labels, -1), "site_suffix": F.array_join(F.slice(F.reverse(labels), 1, 2), ".")}
    return df.withColumns({k: v.cast("double") for k, v in made.items()} | keys)


def _with_suffix_rates(df: DataFrame, sums: DataFrame, prior: float, by: list[str]) -> DataFrame:
    """sums: ``by``, suffix, site_suffix, s (blocked) and n of labelled urls; df has ``by`` and the suffixes too."""
    one = sums.groupBy(*by, "suffix").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    one = one.select(*by, "suffix", "n", ((F.col("s") + SMOOTH * prior) / (F.col("n") + SMOOTH)).alias("suffix_rate"))
    two = sums.groupBy(*by, "site_suffix", "suffix").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(one.drop("n"), [*by, "suffix"])
    two = two.select(*by, "site_suffix", "n", ((F.col("s") + SMOOTH * F.col("suffix_rate")) / (F.col("n") + SMOOTH)).alias("site_suffix_rate"))
    out = spread_join(spread_join(df, one, [*by, "suffix"], "n", "left"), two, [*by, "site_suffix"], "n", "left")
    return out.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(prior))).withColumn("site_suffix_rate", F.coalesce("site_suffix_rate", "suffix_rate"))


# --- boosted trees -------------------------------------------------------------------------


@dataclass
class Trees:
    prior: float
    trees: list  # a leaf's value, or (feature, threshold, at most, above)

    def expression(self, features: list[str]) -> Column:
        """Log-odds as nested CASEs."""

        def text(node) -> str:
            if not isinstance(node, tuple):
                return f"{float(node)!r}D"
            k, cut, low, high = node
            return f"CASE WHEN {features[k]} <= {float(cut)!r}D THEN {text(low)} ELSE {text(high)} END"

        return F.expr(" + ".join([f"{self.prior!r}D", *(f"({text(t)})" for t in self.trees)]))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)

        def add(node, rows):
            if not isinstance(node, tuple):
                out[rows] += node
                return
            k, cut, low, high = node
            left = x[rows, k] <= cut
            add(low, rows[left])
            add(high, rows[~left])

        for t in self.trees:
            add(t, np.arange(len(x)))
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))), [])
    margin = np.full(len(y), model.prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)

        def grow(rows, level):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 20:
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, k], weights=g[rows], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, k], weights=h[rows], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (k, j))
            if best[1] is None:
                value = rate * gs / (hs + l2)
                margin[rows] += value
                return float(value)
            k, j = best[1]
            left = code[rows, k] <= j
            return k, float(cuts[k][j]), grow(rows[left], level + 1), grow(rows[~left], level + 1)

        model.trees.append(grow(np.arange(len(y)), 0))
    return model


# --- the operator --------------------------------------------------------------------------


def judge(pages: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str]], labelled: DataFrame | None = None, train_urls: int = TRAIN_URLS) -> DataFrame:
    """The id, host, path, rule, verdict and block_score (the method's probability) of every row.

    labelled: url, label (1: block, 0: allow); default: seed words and rules label the pages themselves.
    """

    def prepared(df: DataFrame) -> DataFrame:
        host, path, tail = split_url(F.col("url"))
        df = df.withColumns({"host": host, "path": path, "tail": tail})
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return _lexical(df.withColumns({"rule": rule, "ruled": verdict}))

    rows = prepared(pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("url")))
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold")
    if labelled is None:
        seed = F.col("host").rlike(rf"(^|[.\-0-9])({'|'.join(SEED_WORDS)})s?([.\-0-9]|$)")
        label = F.when(seed, 1).when(F.coalesce(F.col("ruled"), F.lit("allow")) == "allow", 0)
        known = rows.withColumn("label", label).where("label is not null")
        few = prepared(first_by_hash(known, ["url"], train_urls)).withColumn("label", label)
    else:
        urls = labelled.select("url", F.col("label").cast("int").alias("label")).where("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").alias("label"))
        known = prepared(urls)
        few = prepared(first_by_hash(urls, ["url"], train_urls).join(urls, "url"))
    # one row for each suffix and fold
    sums = cut(known.groupBy("suffix", "site_suffix", fold).agg(F.sum("label").alias("s"), F.count("*").alias("n")), "suffixes")
    whole = sums.agg(F.sum("s") / F.sum("n")).first()[0]
    prior = 0.5 if whole is None else float(whole)
    others = sums.withColumn("other", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).where("other <> fold").drop("fold").withColumnRenamed("other", "fold")
    sample = _with_suffix_rates(few.withColumn("fold", fold), others, prior, ["fold"]).select("label", F.array(*FEATURES).alias("x")).collect()
    got = sorted((r["label"], r["x"]) for r in sample)
    y = np.array([r[0] for r in got], float)
    if len(y) and 0 < y.sum() < len(y):
        odds = boost(np.array([r[1] for r in got]), y).expression(FEATURES)
        rows = _with_suffix_rates(rows, sums, prior, []).withColumn("block_score", 1 / (1 + F.exp(-odds)))
    else:
        rows = rows.withColumn("block_score", F.lit(0.0))
    method = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return rows.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "block_score")
