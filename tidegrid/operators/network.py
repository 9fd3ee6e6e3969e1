"""The forecasting network in numpy, with seeded weights: encoders by tier, identities, embedding, masked blocks, heads.

A buffer is one group of rows, whose size is fixed by packing; each group is an Arrow batch in one task.
Columns of a token: slot, sample (-1: padding), variate, role, role_ft, tier, content_state, t_center, a, sigma,
z and observed (arrays over the token's patch, empty where nothing is read).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import PATCH, inverse

from .model import orthonormal_basis
from .tokens import CTX, MASK, NA, OBSERVED, QRY

VALUE_BANDS, TIME_BANDS = (0.25, 64.0, 16), (1e-3, 1.0, 32)


def waves(x: np.ndarray, low: float, high: float, n: int) -> np.ndarray:
    """sin and cos of x at n frequencies spaced evenly in their logarithm."""
    angle = np.asarray(x, float)[..., None] * np.geomspace(low, high, n)
    return np.concatenate([np.sin(angle), np.cos(angle)], -1)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x**3)))


def normed(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-6)


def may_attend(sample: np.ndarray, role: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Query by key: one sample; context keys not later than a context query, all for a query token, and query tokens among themselves."""
    same = (sample[:, None] == sample[None]) & (sample[:, None] >= 0)
    ok = ((role[None] == CTX) & ((role[:, None] == QRY) | (t[None] <= t[:, None]))) | ((role[:, None] == QRY) & (role[None] == QRY))
    return same & ok | np.eye(len(sample), dtype=bool) & (sample[:, None] < 0)


class Network:
    def __init__(self, d: int = 32, heads: int = 4, layers: int = 2, p_out: int = 16, cap: int | None = None, seed: int = 0):
        self.d, self.heads, self.p_out, self.cap, self.seed = d, heads, p_out, cap, seed
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
        width = 2 * VALUE_BANDS[2] + 1
        self.encoders = [(w(p * width, d), np.zeros(d), w(d, d), np.zeros(d)) for p in PATCH]
        self.mask, self.missing = 0.02 * rng.normal(size=d), 0.02 * rng.normal(size=d)
        self.receipt = (w(2, d), np.zeros(d), w(d, d), np.zeros(d))
        self.time, self.span, self.kind = w(2 * TIME_BANDS[2], d), w(len(PATCH), d), w(2, d)
        self.blocks = [(w(d, 3 * d), w(d, d), w(d, 4 * d), w(4 * d, d)) for _ in range(layers)]
        self.horizon, self.aux = w(d, p_out), [w(d, p) for p in PATCH]

    def parameters(self) -> int:
        held = [*(x for e in self.encoders for x in e), self.mask, self.missing, *self.receipt, self.time, self.span, self.kind, *(x for b in self.blocks for x in b), self.horizon, *self.aux]
        return sum(x.size for x in held)

    @staticmethod
    def _two(layers, x):
        a, p, b, q = layers
        return gelu(x @ a + p) @ b + q

    def content(self, tier: np.ndarray, state: np.ndarray, z: list, observed: list) -> np.ndarray:
        """Encoded patches of observed tokens (the first ``cap`` of a tier; 0 beyond), the mask and the missing vector elsewhere."""
        out = np.zeros((len(tier), self.d))
        for k, p in enumerate(PATCH):
            at = np.flatnonzero((state == OBSERVED) & (tier == k))[: self.cap]
            if len(at):
                values = np.stack([np.asarray(z[i], float)[:p] for i in at])
                seen = np.stack([np.asarray(observed[i], float)[:p] for i in at])
                read = np.concatenate([waves(values, *VALUE_BANDS), seen[..., None]], -1)
                out[at] = self._two(self.encoders[k], read.reshape(len(at), -1))
        out[state == MASK], out[state == NA] = self.mask, self.missing
        return out

    def embed(self, rows: dict, basis: np.ndarray | None = None) -> np.ndarray:
        """Content, identity with scale, time, span and kind of each token, added up."""
        variate = np.maximum(np.asarray(rows["variate"]), 0).astype(int)
        basis = orthonormal_basis(int(variate.max(initial=0)) + 1, self.d, self.seed) if basis is None else basis
        scale = self._two(self.receipt, np.c_[rows["a"], rows["sigma"]].astype(float))
        tier, kind = np.asarray(rows["tier"]).astype(int), np.minimum(np.asarray(rows["role_ft"]).astype(int), 1)
        content = self.content(tier, np.asarray(rows["content_state"]), rows["z"], rows["observed"])
        return content + basis[variate] + scale + waves(rows["t_center"], *TIME_BANDS) @ self.time + self.span[tier] + self.kind[kind]

    def block(self, x: np.ndarray, mask: np.ndarray, weights) -> np.ndarray:
        qkv, out, up, down = weights
        split = lambda a: a.reshape(len(a), self.heads, -1).transpose(1, 0, 2)
        q, k, v = (split(a) for a in np.split(normed(x) @ qkv, 3, -1))
        score = np.where(mask[None], q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[-1]), -np.inf)
        score = np.exp(score - score.max(-1, keepdims=True))
        x = x + ((score / score.sum(-1, keepdims=True)) @ v).transpose(1, 0, 2).reshape(x.shape) @ out
        return x + gelu(normed(x) @ up) @ down

    def __call__(self, rows: dict, basis: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(horizon, a prediction of the next patch for each tier) of every token."""
        x = self.embed(rows, basis)
        mask = may_attend(np.asarray(rows["sample"]), np.asarray(rows["role"]), np.asarray(rows["t_center"], float))
        for weights in self.blocks:
            x = self.block(x, mask, weights)
        x = normed(x)
        return x @ self.horizon, [x @ w for w in self.aux]


def outputs(tokens: DataFrame, network: Network, group: str = "buffer_id") -> DataFrame:
    """group, slot, horizon of query tokens, aux (that of the token's tier) of context tokens."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot").reset_index(drop=True)
        horizon, aux = network({c: rows[c].tolist() if c in ("z", "observed") else rows[c].to_numpy() for c in rows.columns})
        query = (rows["role"] == QRY) & (rows["sample"] >= 0)
        context = (rows["role"] == CTX) & (rows["sample"] >= 0)
        rows["horizon"] = [h.tolist() if q else None for h, q in zip(horizon, query)]
        rows["aux"] = [aux[t][i].tolist() if c else None for i, (t, c) in enumerate(zip(rows["tier"].astype(int), context))]
        return rows[[group, "slot", "horizon", "aux"]]

    return tokens.groupBy(group).applyInPandas(run, f"{group} long, slot long, horizon array<double>, aux array<double>")


def segment_tokens(tokens: DataFrame, patches: DataFrame, stats: DataFrame) -> DataFrame:
    """Tokens of segments, one segment to a buffer, with what they read and the scale of their channel."""
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    rows = tokens.join(patches, ["segment_id", "channel_idx", "pos"], "left").join(stats, ["segment_id", "channel_idx"])
    # what a revealed future reads isn't in the store of the context: such a token counts as missing
    state = F.when((F.col("content_state") == OBSERVED) & F.col("z").isNull(), NA).otherwise(F.col("content_state"))
    return rows.select(
        "segment_id", F.col("pos").cast("long").alias("slot"), F.lit(0).alias("sample"), F.col("channel_idx").alias("variate"), "role", "role_ft", "tier", state.alias("content_state"),
        F.col("t_center").cast("double").alias("t_center"), "a", "sigma", empty(F.col("z"), "array<double>").alias("z"), empty(F.col("observed"), "array<boolean>").alias("observed"),
    )


def forecast(tokens: DataFrame, network: Network) -> DataFrame:
    """segment_id, channel_idx, j, values: one pass over each segment; horizons in the units of their channel."""
    made = outputs(tokens, network, "segment_id").where("horizon is not null").drop("aux")
    rows = made.join(tokens.select("segment_id", "slot", F.col("variate").alias("channel_idx"), "t_center", "a", "sigma"), ["segment_id", "slot"])
    values = F.transform("horizon", lambda z: inverse(z, F.col("a"), F.col("sigma")))
    return rows.select("segment_id", "channel_idx", F.floor(F.col("t_center") / network.p_out).alias("j"), values.alias("values"))
