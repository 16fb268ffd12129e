"""The E8 lattice: nearest points, neighbouring cells and cell identifiers, vectorised over rows."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


MINIMAL = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors of even sum: round, and where the sum is odd move the worst entry the other way."""
    near = np.rint(x)
    odd = np.nonzero(near.sum(axis=1) % 2 != 0)[0]
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.argmax(np.abs(off), axis=1)
        step = np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        near[odd, worst] += step
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the nearest points of D8 and of D8 shifted by one half."""
    whole = _nearest_d8(x)
    half = _nearest_d8(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(better[:, None], half, whole)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, 1 + probes, 8) lattice points: the own cell, then the neighbours nearest to the row."""
    own = nearest(x)
    gain = (x - own) @ MINIMAL.T
    best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
    return np.concatenate([own[:, None, :], own[:, None, :] + MINIMAL[best]], axis=1)


def cell_ids(points: np.ndarray) -> np.ndarray:
    """One signed 64-bit identifier for each lattice point (last axis of 8, doubled to be whole)."""
    twice = np.rint(points * 2).astype(np.int64)
    odd = np.array([2 * k + 1 for k in range(8)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.zeros(points.shape[:-1], dtype=np.uint64)
    for k in range(8):
        mixed = (mixed ^ (twice[..., k].astype(np.uint64) * odd[k])) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def projections(dim: int, tables: int, scale: float, seed: int) -> np.ndarray:
    """(tables, dim, 8) Gaussian projections; a unit step moves a projection by about ``scale``."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables, dim, 8)) * (scale / np.sqrt(8))
