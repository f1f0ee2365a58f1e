"""A bidirectional gated recurrent network over bytes, in numpy: every position gets class probabilities."""

from __future__ import annotations

import numpy as np

LENGTH, HIDDEN = 64, 8
F32 = np.float32


def new_weights(classes: int, seed: int = 3) -> dict[str, np.ndarray]:
    """x: input tables of both directions (gates z, r, candidate n), u: recurrent weights, v and c: output layer."""
    rng = np.random.Generator(np.random.PCG64(seed))
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(F32)
    x = normal(512, 3 * HIDDEN, scale=0.3)
    return {"x": x, "u": normal(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "v": normal(2, HIDDEN, classes, scale=0.3), "c": np.zeros(classes, F32)}


def _states(w: dict, bytes_: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States h[step, direction, segment, unit]; direction 1 reads backwards. bytes_: [LENGTH, segments]."""
    steps, n = bytes_.shape
    h = np.zeros((2, n, HIDDEN), F32)
    out, saved = np.empty((steps, 2, n, HIDDEN), F32), []
    index = np.stack([bytes_, bytes_[::-1].astype(np.int64) + 256], 1).astype(np.int64)
    for t in range(steps):
        a = w["x"][index[t]]
        b = h @ w["u"]
        gate = np.tanh(F32(0.5) * (a[..., : 2 * HIDDEN] + b[..., : 2 * HIDDEN]))
        gate += F32(1)
        gate *= F32(0.5)
        z, r, m = gate[..., :HIDDEN], gate[..., HIDDEN:], b[..., 2 * HIDDEN :]
        c = np.tanh(a[..., 2 * HIDDEN :] + r * m)
        new = c + z * (h - c)
        if keep:
            saved.append((h, z, r, m, c))
        h = new
        out[t] = h
    return out, saved


def position_scores(w: dict, bytes_: np.ndarray) -> np.ndarray:
    """Class probabilities of every position, [step, segment, class]."""
    h, _ = _states(w, bytes_, False)
    logits = h[:, 0] @ w["v"][0] + h[::-1, 1] @ w["v"][1] + w["c"]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(-1, keepdims=True)
    return p


def _gradients(w: dict, bytes_: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of the masked positions, and its gradient by backpropagation through time."""
    steps, n = bytes_.shape
    h, saved = _states(w, bytes_, True)
    back = h[::-1, 1]
    logits = h[:, 0] @ w["v"][0] + back @ w["v"][1] + w["c"]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    weight = (mask / max(mask.sum(), 1)).astype(F32)
    loss = -(np.log(np.maximum(p[:, np.arange(n), label], 1e-9)) * weight).sum()
    error = p * weight[..., None]
    error[:, np.arange(n), label] -= weight
    g = {k: np.zeros_like(a) for k, a in w.items()}
    g["c"] = error.sum((0, 1))
    flat = error.reshape(-1, error.shape[-1])
    g["v"][0] = h[:, 0].reshape(-1, HIDDEN).T @ flat
    g["v"][1] = back.reshape(-1, HIDDEN).T @ flat
    into = np.stack([error @ w["v"][0].T, (error @ w["v"][1].T)[::-1]], 1)
    index = np.stack([bytes_, bytes_[::-1].astype(np.int64) + 256], 1).astype(np.int64)
    dh = np.zeros((2, n, HIDDEN), F32)
    rows = np.empty((steps, 2, n, 3 * HIDDEN), F32)
    for t in range(steps - 1, -1, -1):
        h0, z, r, m, c = saved[t]
        dh = dh + into[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h0 - c) * z * (1 - z)
        dr = dc * m * r * (1 - r)
        da = np.concatenate([dz, dr, dc], -1)
        db = np.concatenate([dz, dr, dc * r], -1)
        rows[t] = da
        g["u"] += np.transpose(h0, (0, 2, 1)) @ db
        dh = dh * z + db @ np.transpose(w["u"], (0, 2, 1))
    order = np.argsort(index.ravel(), kind="stable")
    key = index.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    g["x"][key[first]] = np.add.reduceat(rows.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    return float(loss), g


def train(bytes_: np.ndarray, mask: np.ndarray, label: np.ndarray, classes: int, steps: int = 300, batch: int = 256, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam over random batches of segments; bytes_ and mask are [LENGTH, segments]."""
    rng, w = np.random.Generator(np.random.PCG64(seed)), new_weights(classes, seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        own = rng.integers(0, bytes_.shape[1], min(batch, bytes_.shape[1]))
        _, g = _gradients(w, bytes_[:, own], mask[:, own], label[own])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.03 * min(1.0, 4 * (1 - t / (steps + 1)))
        for k in w:
            x = g[k] * F32(min(1.0, 2.0 / max(norm, 1e-9)))
            m[k] = F32(0.9) * m[k] + F32(0.1) * x
            v[k] = F32(0.99) * v[k] + F32(0.01) * x * x
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(F32)
    return w
