"""Linear support vector machines on bounded samples, and hashed byte n-grams for numpy scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from signbridge.llm.common import text_arrays

_STEP = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts with every ASCII character that is no letter as a space, and offsets."""
    raw, offsets = text_arrays(pc.utf8_lower(column.fill_null("")))
    keep = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    return np.where(keep, raw, np.uint8(32)), offsets


def gram_slots(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A slot below 2**bits for the byte n-gram that begins at each byte (the last n - 1 have none)."""
    size = max(0, len(raw) - n + 1)
    h = np.full(size, n, np.uint32)
    for i in range(n):
        h = (h + raw[i: i + size]) * _STEP[i]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def gram_counts(raw: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each text the counts of its n-grams of all orders, by slot."""
    slots = {n: gram_slots(raw, n, bits) for n in orders}
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        parts = [slots[n][a: max(a, b - n + 1)] for n in orders]
        out.append(np.bincount(np.concatenate(parts), minlength=1 << bits))
    return out


def gram_means(raw: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int, weights: np.ndarray) -> np.ndarray:
    """For each text the mean of ``weights[slot]`` over its n-grams: a row of as many values as weights has columns."""
    total = np.zeros((len(offsets) - 1, weights.shape[1]))
    count = np.zeros(len(offsets) - 1)
    for n in orders:
        slots = gram_slots(raw, n, bits)
        stop = np.maximum(offsets[:-1], offsets[1:] - n + 1)
        for c in range(weights.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(weights[:, c][slots])])
            total[:, c] += sums[np.minimum(stop, len(slots))] - sums[np.minimum(offsets[:-1], len(slots))]
        count += stop - offsets[:-1]
    return total / np.maximum(count, 1)[:, None]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 12, ones: bool = False) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear machine with squared hinge loss (y is -1 or 1), by Newton steps
    whose linear systems conjugate gradients solve. With ``ones`` the last column of ``x`` is the intercept's."""
    if not ones:
        x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w = np.zeros(x.shape[1], x.dtype)
    weight = (weight / weight.sum()).astype(x.dtype)
    y = y.astype(x.dtype)

    def loss(w: np.ndarray) -> float:
        return ridge * float(w @ w) + float(weight @ np.maximum(0, 1 - y * (x @ w)) ** 2)

    now = loss(w)
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ w))
        g = 2 * ridge * w - 2 * x.T @ (weight * y * gap)
        held = 2 * weight * (gap > 0)
        step, r = np.zeros_like(w), -g
        p, rr = r.copy(), float(r @ r)
        stop = 1e-4 * rr
        for _ in range(25):
            hp = 2 * ridge * p + x.T @ (held * (x @ p))
            a = rr / max(float(p @ hp), 1e-30)
            step += a * p
            r -= a * hp
            rr, old = float(r @ r), rr
            if rr <= stop:
                break
            p = r + (rr / old) * p
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if new >= now * (1 - 1e-4):
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])
