"""Gated recurrent units in numpy, with backpropagation through time, and Adam.

Arrays have time first and the batch last, so that each step works on one block
of memory: inputs (T, 3H, B), states (T + 1, H, B).
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def forward(gates: np.ndarray, weights: np.ndarray, bias: np.ndarray, start: np.ndarray, keep: bool = False, alive: np.ndarray | None = None):
    """States of a unit over inputs ``gates`` (T, 3H, B), which already hold input weights and bias.

    ``weights`` (3H, H): of update, reset and candidate, ``bias`` (H, 1): of the
    candidate's recurrent part.  ``keep``: also what ``backward`` needs.
    ``alive`` (T, B): 0 where a step begins anew, with a state of zeros, 1 elsewhere.
    """
    steps, h3, batch = gates.shape
    h = h3 // 3
    states = np.empty((steps + 1, h, batch), np.float32)
    states[0] = start
    kept = np.empty((steps, 4 * h, batch), np.float32) if keep else None
    both = np.empty((h3, batch), np.float32)
    for t in range(steps):
        now = states[t] if alive is None else states[t] * alive[t]
        np.dot(weights, now, out=both)
        g = gates[t]
        zr = both[: 2 * h]
        zr += g[: 2 * h]
        sigmoid(zr)
        recurrent = both[2 * h :]
        recurrent += bias
        if keep:
            kept[t, : 2 * h], kept[t, 3 * h :] = zr, recurrent
        candidate = recurrent
        candidate *= zr[h:]
        candidate += g[2 * h :]
        np.tanh(candidate, out=candidate)
        if keep:
            kept[t, 2 * h : 3 * h] = candidate
        # z * now + (1 - z) * candidate
        new = states[t + 1]
        np.subtract(now, candidate, out=new)
        new *= zr[:h]
        new += candidate
    return (states, kept) if keep else states


def backward(d_states: np.ndarray, states: np.ndarray, kept: np.ndarray, weights: np.ndarray, alive: np.ndarray | None = None):
    """Gradients of inputs, weights and bias from those of the states 1 to T."""
    steps, h, batch = d_states.shape
    before = states[:-1] if alive is None else states[:-1] * alive[:, None]
    z, r, c, recurrent = (kept[:, k * h : (k + 1) * h] for k in range(4))
    # What each step multiplies its states' gradients by, of all steps at once.
    keeps = 1 - z
    to_candidate = 1 - c * c
    to_candidate *= keeps
    keeps *= z
    to_update = before - c
    to_update *= keeps
    to_reset = 1 - r
    to_reset *= r
    to_reset *= recurrent
    d_gates = np.empty((steps, 3 * h, batch), np.float32)
    d_recurrent = np.empty((steps, 3 * h, batch), np.float32)
    carry = np.zeros((h, batch), np.float32)
    back = np.ascontiguousarray(weights.T)
    for t in range(steps - 1, -1, -1):
        carry += d_states[t]
        dg, dr = d_gates[t], d_recurrent[t]
        dc = dg[2 * h :]
        np.multiply(carry, to_candidate[t], out=dc)
        np.multiply(carry, to_update[t], out=dg[:h])
        np.multiply(dc, to_reset[t], out=dg[h : 2 * h])
        dr[: 2 * h] = dg[: 2 * h]
        np.multiply(dc, r[t], out=dr[2 * h :])
        carry *= z[t]
        carry += back @ dr
        if alive is not None:
            carry *= alive[t]
    d_weights = np.tensordot(d_recurrent, before, axes=((0, 2), (0, 2)))
    return d_gates, d_weights, d_recurrent[:, 2 * h :].sum((0, 2))[:, None]


class Adam:
    """Adam over a dictionary of arrays, with gradients clipped by their common norm."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, clip: float = 5.0):
        self.params, self.rate, self.clip, self.step = params, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}
        self.room = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.step += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        factor = min(1.0, self.clip / (norm + 1e-9))
        for k, g in grads.items():
            m, v, room = self.m[k], self.v[k], self.room[k]
            np.multiply(g, factor, out=room)
            m *= 0.9
            v *= 0.999
            m += 0.1 * room
            np.multiply(room, room, out=room)
            room *= 0.001
            v += room
            np.divide(v, 1 - 0.999**self.step, out=room)
            np.sqrt(room, out=room)
            room += 1e-8
            np.divide(m, room, out=room)
            room *= (rate or self.rate) / (1 - 0.9**self.step)
            self.params[k] -= room


def glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.normal(size=shape) * np.sqrt(2 / (shape[0] + shape[-1]))).astype(np.float32)


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    """In place."""
    x -= x.max(axis=axis, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=axis, keepdims=True)
    return x
