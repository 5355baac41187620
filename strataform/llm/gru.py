"""A bidirectional gated recurrent network in NumPy: forward pass, and backpropagation through time.

Inputs are rows of a gate table, one row for each input symbol: its three input contributions
(update, reset, candidate) already multiplied out, so a step gathers rows and multiplies only the
state. The update and reset halves hold half the usual pre-activation, as sigmoid(2x) =
(1 + tanh x) / 2. A padding symbol's update gate is saturated: it leaves a zero state zero in
either direction, so sequences may be padded at their end without a mask.
"""

from __future__ import annotations

import numpy as np

#: Half pre-activation at which float32 tanh is 1.
SHUT = np.float32(20.0)


def pad_row(hidden: int) -> np.ndarray:
    row = np.zeros(3 * hidden, np.float32)
    row[:hidden] = SHUT
    return row


def run(table: np.ndarray, symbols: np.ndarray, u: np.ndarray, out: np.ndarray, backward: bool) -> None:
    """States of one direction for symbols (steps, batch), written into out (steps, batch, hidden)."""
    steps, batch = symbols.shape
    hidden = u.shape[0]
    h = np.zeros((batch, hidden), np.float32)
    g = np.empty((batch, 3 * hidden), np.float32)
    a = np.empty_like(g)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        np.take(table, symbols[t], axis=0, out=g, mode="clip")
        np.matmul(h, u, out=a)
        zr = g[:, : 2 * hidden] + a[:, : 2 * hidden]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= np.float32(0.5)
        n = a[:, 2 * hidden :] * zr[:, hidden:]
        n += g[:, 2 * hidden :]
        np.tanh(n, out=n)
        new = out[t]
        np.subtract(h, n, out=new)
        new *= zr[:, :hidden]
        new += n
        h = new


def trace(g: np.ndarray, u: np.ndarray, backward: bool) -> tuple[np.ndarray, list]:
    """As `run` for gate inputs (steps, batch, 3 * hidden), keeping what `gradient` needs."""
    steps, batch, width = g.shape
    hidden = width // 3
    h = np.zeros((batch, hidden), np.float32)
    states, kept = np.empty((steps, batch, hidden), np.float32), [None] * steps
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        a = h @ u
        zr = (np.tanh(g[t, :, : 2 * hidden] + a[:, : 2 * hidden]) + 1) * np.float32(0.5)
        n = np.tanh(g[t, :, 2 * hidden :] + zr[:, hidden:] * a[:, 2 * hidden :])
        kept[t] = (h, zr, n, a[:, 2 * hidden :])
        h = n + zr[:, :hidden] * (h - n)
        states[t] = h
    return states, kept


def gradient(d_states: np.ndarray, u: np.ndarray, kept: list, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of u, by backpropagation through time."""
    steps, batch, hidden = d_states.shape
    dg, du, dh = np.empty((steps, batch, 3 * hidden), np.float32), np.zeros_like(u), np.zeros((batch, hidden), np.float32)
    for t in range(steps) if backward else range(steps - 1, -1, -1):
        h, zr, n, an = kept[t]
        z, r = zr[:, :hidden], zr[:, hidden:]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        da = np.empty((batch, 3 * hidden), np.float32)
        da[:, :hidden] = 2 * dh * (h - n) * z * (1 - z)
        da[:, hidden : 2 * hidden] = 2 * dn * an * r * (1 - r)
        da[:, 2 * hidden :] = dn * r
        dg[t] = da
        dg[t, :, 2 * hidden :] = dn
        du += h.T @ da
        dh = dh * z + da @ u.T
    return dg, du


class Adam:
    """Adam over named arrays; rows that a step does not touch keep their moments."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray] | None = None, scale: float = 1.0) -> None:
        """rows: for tables, the touched rows, whose gradients `grads` holds in that order."""
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * self.rate * scale
        for k, g in grads.items():
            at = rows[k] if rows and k in rows else slice(None)
            g = np.clip(g, -1.0, 1.0).astype(np.float32)
            m = self.m[k][at] * np.float32(0.9) + g * np.float32(0.1)
            v = self.v[k][at] * np.float32(0.999) + g * g * np.float32(0.001)
            self.m[k][at], self.v[k][at] = m, v
            self.params[k][at] -= (fix * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


def orthogonal(rng: np.random.Generator, hidden: int) -> np.ndarray:
    parts = [np.linalg.qr(rng.normal(size=(hidden, hidden)))[0] for _ in range(3)]
    return np.concatenate([parts[0] * 0.5, parts[1] * 0.5, parts[2]], axis=1).astype(np.float32)
