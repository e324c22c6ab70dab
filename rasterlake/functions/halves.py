"""16-bit floats: IEEE, and the compat form that truncates and knows no denormals, infinities or NaN."""

from __future__ import annotations

import numpy as np


def to_half_bits(x: np.ndarray, ieee: bool = True) -> np.ndarray:
    f = np.asarray(x, np.float32)
    if ieee:
        return f.astype(np.float16).view(np.uint16)
    u = f.view(np.uint32).astype(np.int64)
    e = u >> 23 & 255
    e = np.where(e < 112, 0, np.where(e > 143, 31, e - 112))
    return np.where(u == 0, 0, (u >> 16 & 0x8000) | (u >> 13 & 0x3FF) | e << 10).astype(np.uint16)


def from_half_bits(h: np.ndarray, ieee: bool = True) -> np.ndarray:
    h = np.asarray(h, np.uint16)
    if ieee:
        return h.view(np.float16).astype(np.float32)
    v = h.astype(np.int64)
    u = ((v & 0x8000) << 16 | (v & 0x3FF) << 13 | ((v >> 10 & 31) + 112) << 23).astype(np.uint32)
    return np.where(v == 0, np.float32(0), u.view(np.float32))
