"""Dense parts in numpy, over Arrow groups: iterative rollout, identity bases, and a masked-attention forward pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .forecast import KEYS


def naive_chunk(context: np.ndarray, steps: int, season: int) -> np.ndarray:
    """Seasonal naive of an array without gaps."""
    if not len(context):
        return np.zeros(steps)
    if len(context) < season:
        return np.full(steps, context.mean())
    return context[len(context) - season + np.arange(steps) % season]


def rollout(context: DataFrame, p: int, chunk: int, season: int, forecaster: Callable[[np.ndarray, int, int], np.ndarray] = naive_chunk) -> DataFrame:
    """(series, channel, h, yhat, pass): ceil(p / chunk) passes, each fed what was predicted before it.

    context: filled without gaps. Truth after the context never enters; what isn't finite is fed back as 0.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        known, out = rows["filled"].to_numpy(float), []
        for k in range(-(-p // chunk)):
            steps = min(chunk, p - k * chunk)
            made = np.asarray(forecaster(known, steps, season), float)
            out += [(rows["series_id"].iloc[0], int(rows["channel_idx"].iloc[0]), k * chunk + i, float(y), k) for i, y in enumerate(made)]
            known = np.concatenate([known, np.where(np.isfinite(made), made, 0.0)])
        return pd.DataFrame(out, columns=[*KEYS, "h", "yhat", "pass"])

    return context.select(*KEYS, "t", "filled").groupBy(*KEYS).applyInPandas(run, "series_id string, channel_idx int, h long, yhat double, pass int")


def orthonormal_basis(n: int, d: int, seed: int) -> np.ndarray:
    """n identity vectors of d: orthonormal by QR, or normalised where there are more than d."""
    x = np.random.default_rng(seed).normal(size=(n, d))
    if n > d:
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    q, r = np.linalg.qr(x.T)
    return (q * np.sign(np.diag(r))).T


class Forward:
    """A pre-norm transformer with seeded weights: embeds (value, time, role), attends under a mask, reads out one number."""

    def __init__(self, d: int = 16, heads: int = 2, layers: int = 2, seed: int = 0):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
        self.heads, self.d = heads, d
        self.embed, self.read = w(3 + d, d), w(d, 1)
        self.layers = [(w(d, 3 * d), w(d, d), w(d, 4 * d), w(4 * d, d)) for _ in range(layers)]

    @staticmethod
    def _norm(x):
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-6)

    def __call__(self, values, times, roles, ids, mask) -> np.ndarray:
        x = np.c_[values, times, roles, ids] @ self.embed
        for qkv, out, up, down in self.layers:
            q, k, v = np.split(self._norm(x) @ qkv, 3, -1)
            split = lambda a: a.reshape(len(a), self.heads, -1).transpose(1, 0, 2)
            score = split(q) @ split(k).transpose(0, 2, 1) / np.sqrt(self.d // self.heads)
            score = np.where(mask[None], score, -np.inf)
            score = np.exp(score - score.max(-1, keepdims=True))
            x = x + ((score / score.sum(-1, keepdims=True)) @ split(v)).transpose(1, 0, 2).reshape(x.shape) @ out
            h = self._norm(x) @ up
            x = x + (0.5 * h * (1 + np.tanh(0.7978845608 * (h + 0.044715 * h**3)))) @ down
        return (x @ self.read)[:, 0]


def forward_rows(tokens: DataFrame, seed: int = 0) -> DataFrame:
    """tokens: buffer_id, slot, sample, role, t_center, value. Adds pred; one group is one buffer, whose size is fixed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot").reset_index(drop=True)
        sample, role, t = (rows[c].to_numpy() for c in ("sample", "role", "t_center"))
        same = (sample[:, None] == sample[None]) & (sample[:, None] >= 0)
        ok = ((role[None] == 0) & ((role[:, None] == 1) | (t[None] <= t[:, None]))) | ((role[:, None] == 1) & (role[None] == 1))
        mask = same & ok | np.eye(len(rows), dtype=bool) & (sample[:, None] < 0)
        model = Forward(seed=seed)
        ids = orthonormal_basis(int(sample.max()) + 1, model.d, seed)[np.maximum(sample, 0)]
        rows["pred"] = model(rows["value"].to_numpy(float), t / 32.0, role.astype(float), ids, mask)
        return rows[["buffer_id", "slot", "pred"]]

    return tokens.groupBy("buffer_id").applyInPandas(run, "buffer_id long, slot long, pred double")
