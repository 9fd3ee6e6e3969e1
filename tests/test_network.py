"""The network's parts: identities, routing, masks, layout."""

import numpy as np
import pytest

from tidegrid.functions.scalar import PATCH
from tidegrid.operators import model, network
from tidegrid.operators.tokens import CTX, MASK, NA, OBSERVED, QRY


def _segment(seed, n=6, q=2, variates=2):
    rng = np.random.default_rng(seed)
    tier = rng.integers(0, 3, n + q)
    state = np.r_[rng.choice([OBSERVED, OBSERVED, NA], n), [MASK] * q]
    t = np.r_[np.sort(-rng.uniform(1, 90, n)), 8 + 16.0 * np.arange(q)]
    rows = {"sample": np.zeros(n + q, int), "variate": rng.integers(0, variates, n + q), "role": np.r_[[CTX] * n, [QRY] * q], "role_ft": np.r_[rng.integers(0, 2, n), [1] * q], "tier": tier, "content_state": state, "t_center": t}
    rows |= {"a": rng.normal(size=n + q), "sigma": rng.uniform(0.5, 2, n + q)}
    return rows | {"z": [rng.normal(size=PATCH[k]) for k in tier], "observed": [rng.random(PATCH[k]) < 0.8 for k in tier]}


def _joined(parts, order=None):
    out = {}
    for c in parts[0]:
        listed = [x for p in parts for x in p[c]]
        out[c] = [listed[i] for i in order] if order is not None else listed
        if c not in ("z", "observed"):
            out[c] = np.array(out[c])
    return out


@pytest.mark.parametrize("n,d", [(1, 8), (5, 8), (8, 8), (20, 8)])
def test_identities(n, d):
    basis = model.orthonormal_basis(n, d, 3)
    gram = basis @ basis.T
    assert basis.shape == (n, d) and np.allclose(np.diag(gram), 1)
    if n <= d:
        assert np.allclose(gram, np.eye(n))
    assert not np.allclose(basis, model.orthonormal_basis(n, d, 4))


def test_content_is_routed():
    net, rows = network.Network(d=16, heads=2), _segment(1)
    content = net.content(rows["tier"], rows["content_state"], rows["z"], rows["observed"])
    assert (content[rows["content_state"] == MASK] == net.mask).all() and (content[rows["content_state"] == NA] == net.missing).all()
    # hidden values aren't read
    other = [z + 1 if s != OBSERVED else z for z, s in zip(rows["z"], rows["content_state"])]
    assert np.array_equal(net.content(rows["tier"], rows["content_state"], other, rows["observed"]), content)
    capped = network.Network(d=16, heads=2, cap=1)
    content = capped.content(np.zeros(3, int), np.full(3, OBSERVED), [np.ones(4)] * 3, [np.ones(4, bool)] * 3)
    assert content[0].any() and not content[1:].any()
    # each tier has an encoder of its own, and a missing step isn't a zero
    one = net.content(np.array([0]), np.array([OBSERVED]), [np.zeros(4)], [np.ones(4, bool)])
    assert not np.allclose(one, net.content(np.array([0]), np.array([OBSERVED]), [np.zeros(4)], [np.zeros(4, bool)]))


def test_layout_doesn_t_matter():
    """A segment's outputs are the same alone, beside others, with padding, and in another order."""
    net = network.Network(d=16, heads=2)
    one, two = _segment(1), _segment(2, 4, 1)
    basis = model.orthonormal_basis(4, 16, 0)
    alone = net(one, basis)[0]
    moved = dict(two, sample=two["sample"] + 1, variate=two["variate"] + 2)
    pad = {c: (["x"] * 0 if c in ("z", "observed") else np.zeros(0)) for c in one}
    pad |= {"sample": np.full(3, -1), "variate": np.full(3, -1), "role": np.zeros(3, int), "role_ft": np.zeros(3, int), "tier": np.zeros(3, int), "content_state": np.full(3, NA), "t_center": np.zeros(3), "a": np.zeros(3), "sigma": np.ones(3), "z": [np.zeros(4)] * 3, "observed": [np.zeros(4, bool)] * 3}
    parts = [one, moved, pad]
    whole = net(_joined(parts), basis)
    assert np.allclose(whole[0][: len(alone)], alone, rtol=1e-6, atol=1e-8)
    order = np.random.default_rng(0).permutation(sum(len(p["a"]) for p in parts))
    turned = net(_joined(parts, order), basis)
    assert np.allclose(turned[0], whole[0][order], rtol=1e-6, atol=1e-8)
    assert all(np.allclose(a, b[order], rtol=1e-6, atol=1e-8) for a, b in zip(turned[1], whole[1]))


def test_context_doesn_t_see_what_comes_later():
    net, rows = network.Network(d=16, heads=2), _segment(5, 8, 2)
    rows["content_state"][:8] = OBSERVED
    before = net(rows)[0]
    last = int(np.argmax(np.where(rows["role"] == CTX, rows["t_center"], -np.inf)))
    rows["z"][last] = rows["z"][last] + 1
    after = net(rows)[0]
    earlier = (rows["role"] == CTX) & (rows["t_center"] < rows["t_center"][last])
    assert np.allclose(before[earlier], after[earlier]) and not np.allclose(before[rows["role"] == QRY], after[rows["role"] == QRY])


def test_heads_and_size():
    net = network.Network(d=16, heads=2, p_out=8)
    horizon, aux = net(_segment(3))
    assert horizon.shape == (8, 8) and [a.shape[1] for a in aux] == list(PATCH)
    assert net.parameters() > sum(p * 33 * 16 for p in PATCH)
