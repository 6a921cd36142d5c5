"""Non-negative numbers as bytes of seven bits."""

from __future__ import annotations

import numpy as np


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ``values`` one after the other, low bits first, the top bit set on all but a number's last; and each one's size."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1 << bits)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for i in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > i)
        part = (values[at] >> np.uint64(7 * i)) & np.uint64(127)
        out[starts[at] + i] = part | np.where(sizes[at] > i + 1, 128, 0).astype(np.uint64)
    return out, sizes


def from_varints(raw: bytes) -> np.ndarray:
    """The numbers that ``varints`` made bytes of."""
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    starts = np.r_[0, ends[:-1] + 1]
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((data & 127).astype(np.uint64) << shift.astype(np.uint64), starts).astype(np.int64)
