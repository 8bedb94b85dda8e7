"""Hashed words of a text, for the linear models."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np

BITS = 17
SIZE = 1 << BITS
_UPPER, _LOWER, _DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")
#: Words remembered, and bytes of the longest remembered.
_CACHE, _CACHE_BYTES = 200_000, 64
_shapes: dict[bytes, int] = {}


def _slot(data: bytes) -> int:
    return zlib.crc32(data) & (SIZE - 1)


def shape_slot(word: bytes) -> int:
    """Slot of a word's shape: runs of capitals, letters and digits are one A, a or 9; the rest stands as it is."""
    slot = _shapes.get(word)
    if slot is None:
        shape = _DIGIT.sub(b"9", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))
        slot = _slot(b"\0" + shape)
        if len(word) <= _CACHE_BYTES:
            if len(_shapes) >= _CACHE:
                _shapes.clear()
            _shapes[word] = slot
    return slot


def word_slots(text: str | None, shapes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of lower-cased words, bare of outer punctuation, and of word shapes if asked."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    slots = [zlib.crc32(w.lower().strip(b".,;:!?\"'()[]#*$%&|<>")) & (SIZE - 1) for w in words]
    if shapes:
        slots += [shape_slot(w) for w in words]
    return np.unique(np.array(slots, np.int64), return_counts=True)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking from x; loss gives the value and gradient."""
    value, grad = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, alphas = grad.copy(), []
        for s, y, rho in reversed(steps):
            alphas.append(rho * (s @ way))
            way -= alphas[-1] * y
        if steps:
            s, y, rho = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, rho), alpha in zip(steps, reversed(alphas), strict=True):
            way += (alpha - rho * (y @ way)) * s
        slope, rate = grad @ way, 1.0 if steps else 1.0 / max(1.0, float(np.abs(grad).sum()))
        if slope <= 0:
            way, slope, steps = grad.copy(), float(grad @ grad), []
        for _ in range(30):
            nx = x - rate * way
            nv, ng = loss(nx)
            if nv <= value - 1e-4 * rate * slope:
                break
            rate *= 0.5
        else:
            break
        s, y = nx - x, ng - grad
        if s @ y > 1e-12:
            steps = [*steps[-(memory - 1) :], (s, y, 1.0 / (s @ y))]
        done = value - nv < 1e-7 * max(1.0, abs(value))
        x, value, grad = nx, nv, ng
        if done:
            break
    return x
