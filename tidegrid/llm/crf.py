"""A small linear-chain conditional random field: maximum likelihood by Adam, Viterbi decoding.

Sequences lie on end in one matrix; ``bounds`` holds where each begins (and the
end of the last). All steps run over every sequence at once, position by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LinearChainCRF:
    emit: np.ndarray  # features x labels
    step: np.ndarray  # labels x labels, from previous to next
    first: np.ndarray  # labels

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, labels: int, rounds: int = 120, l2: float = 1e-3, rate: float = 0.15) -> "LinearChainCRF":
        """x: rows x features; y: label of each row."""
        model = cls(np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), np.zeros(labels))
        if not len(y):
            return model
        truth = np.eye(labels)[y]
        params = [model.emit, model.step, model.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        inner = np.ones(len(y), bool)
        starts = bounds[:-1][np.diff(bounds) > 0]
        inner[starts] = False
        seen = np.zeros((labels, labels))
        nxt = np.flatnonzero(inner)
        np.add.at(seen, (y[nxt - 1], y[nxt]), 1)
        for k in range(1, rounds + 1):
            node, edge = model._marginals(x @ model.emit, bounds)
            grads = [x.T @ (node - truth), edge - seen, (node[starts] - truth[starts]).sum(0)]
            for i, (p, g) in enumerate(zip(params, grads)):
                g = g / len(y) + l2 * p
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p -= rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
        return model

    def _layout(self, bounds: np.ndarray):
        """Sequences by falling length, and how many are longer than t."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        size = size[order]
        top = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(top), side="left")
        return bounds[:-1][order], size, alive, top

    def _marginals(self, e: np.ndarray, bounds: np.ndarray):
        at, size, alive, top = self._layout(bounds)
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        for t in range(top):
            row = at[: alive[t]] + t
            if t == 0:
                fwd[row] = e[row] + self.first
            else:
                fwd[row] = e[row] + _lse(fwd[row - 1][:, :, None] + self.step[None], 1)
        edge = np.zeros_like(self.step)
        z = np.empty(len(at))
        last = at + size - 1
        z[:] = _lse(fwd[last], 1)
        for t in range(top - 1, 0, -1):
            n = alive[t]
            row = at[:n] + t
            out = self.step[None] + (e[row] + bwd[row])[:, None, :]
            edge += np.exp(fwd[row - 1][:, :, None] + out - z[:n, None, None]).sum(0)
            bwd[row - 1] = _lse(out, 2)
        node = fwd + bwd
        node = np.exp(node - _lse(node, 1)[:, None])
        return node, edge

    def decode(self, e: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best label of each row given emissions e (rows x labels); ties go to the lower label."""
        at, size, alive, top = self._layout(bounds)
        back = np.zeros(e.shape, np.int8)
        best = np.empty_like(e)
        for t in range(top):
            row = at[: alive[t]] + t
            if t == 0:
                best[row] = e[row] + self.first
            else:
                x = best[row - 1][:, :, None] + self.step[None]
                k = x.argmax(1)
                back[row] = k
                best[row] = e[row] + np.take_along_axis(x, k[:, None], 1)[:, 0]
        out = np.zeros(len(e), np.int8)
        last = at + size - 1
        out[last] = best[last].argmax(1)
        for t in range(top - 1, 0, -1):
            row = at[: alive[t]] + t
            out[row - 1] = back[row, out[row]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))
