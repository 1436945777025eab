"""The E8 lattice: nearest points and neighbouring cells."""

from __future__ import annotations

import numpy as np


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum, for rows of eight numbers."""
    r = np.rint(x)
    odd = (r.sum(axis=1) % 2) != 0
    if odd.any():
        d = x[odd] - r[odd]
        k = np.abs(d).argmax(axis=1)
        at = np.arange(len(d))
        fix = r[odd]
        fix[at, k] += np.where(d[at, k] >= 0, 1.0, -1.0)
        r[odd] = fix
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 point of every row (twice, so that coordinates are whole numbers)."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], 2 * b, 2 * a).astype(np.int64)


def _roots() -> np.ndarray:
    """Twice the 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8, dtype=np.int64)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([1 if bits >> k & 1 else -1 for k in range(8)], dtype=np.int64)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, 1 + probes, 8): twice the nearest point and the nearest of its neighbours, by distance to x."""
    own = nearest(x)
    if not probes:
        return own[:, None, :]
    off = x - own / 2
    score = off @ (ROOTS.T / 2)  # the larger, the nearer is own + root; all roots have one length
    k = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(score, k, axis=1), axis=1, kind="stable")
    k = np.take_along_axis(k, order, axis=1)
    return np.concatenate([own[:, None, :], own[:, None, :] + ROOTS[k]], axis=1)
