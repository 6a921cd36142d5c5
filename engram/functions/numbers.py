"""Exact 64-bit generators and hashes that have no SQL function."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Fixed values of the generators.
ZERO_SEED = 0xDEAD_BEEF_DEAD_BEEF
DAY_MULTIPLIER = 0xDEAD_BEEF
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
#: Texts below which ``fnv1a_all`` goes on one by one, and those that it takes at once.
TOGETHER = 24
SLICE = 2048


def xorshift(seed: int) -> Iterator[int]:
    """The 64-bit shift register sequence (13, 7, 17)."""
    x = seed & MASK or ZERO_SEED
    while True:
        x = (x ^ (x << 13)) & MASK
        x ^= x >> 7
        x = (x ^ (x << 17)) & MASK
        yield x


def jitter(seed: int) -> Iterator[float]:
    """Factors in [-1, 1) from the top 53 bits of the sequence."""
    for x in xorshift(seed):
        yield (x >> 11) / float(1 << 53) * 2.0 - 1.0


def day_seed(unix_seconds: int) -> int:
    return max(0, unix_seconds) // 86_400 * DAY_MULTIPLIER & MASK


def draw(items: Sequence, count: int, seed: int) -> list:
    """Up to ``count`` items: the head of a partial Fisher-Yates shuffle."""
    work = list(items)
    take = min(count, len(work))
    for i, x in zip(range(take), xorshift(seed)):
        j = i + x % (len(work) - i)
        work[i], work[j] = work[j], work[i]
    return work[:take]


def fnv1a(text: str) -> str:
    """FNV-1a 64 of the UTF-8 bytes as sixteen hex digits."""
    h = FNV_OFFSET
    for byte in text.encode("utf-8"):
        h = ((h ^ byte) * FNV_PRIME) & MASK
    return f"{h:016x}"


def fnv1a_all(texts: pa.Array) -> pa.Array:
    """``fnv1a`` of every text; null stays null.

    All texts take their next byte together, the longest first, so that those which go on are
    always the first ones. Once fewer than ``TOGETHER`` go on, each is finished by itself.
    """
    raw = texts.cast(pa.large_binary())
    n = len(raw)
    if not n or raw.null_count == n:
        return pa.nulls(n, pa.string())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    ascending, starts = sizes[order][::-1], offsets[:-1][order]
    h = np.full(n, FNV_OFFSET, dtype=np.uint64)
    prime = np.uint64(FNV_PRIME)
    j, going = 0, n - int(np.searchsorted(ascending, 0, side="right"))
    while going >= TOGETHER:
        # No text ends before the shortest of those that go on.
        for j in range(j, int(ascending[n - going])):
            h[:going] = (h[:going] ^ data[starts[:going] + j]) * prime
        j = int(ascending[n - going])
        going = n - int(np.searchsorted(ascending, j, side="right"))
    out = h.tolist()
    for i in range(going):
        x = out[i]
        for byte in data[starts[i] + j : starts[i] + ascending[n - 1 - i]].tobytes():
            x = ((x ^ byte) * FNV_PRIME) & MASK
        out[i] = x
    made = np.empty(n, dtype=object)
    made[order] = [f"{x:016x}" for x in out]
    return pa.array(made, pa.string(), mask=raw.is_null().to_numpy(zero_copy_only=False))


def content_fingerprint(content: Column) -> Column:
    """``fnv1a`` of a column, in Arrow batches (a wrapping 64-bit product has no SQL form)."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([fnv1a_all(texts.slice(lo, SLICE)) for lo in range(0, len(texts), SLICE)] or [pa.nulls(0, pa.string())])

    return F.arrow_udf(run, "string")(content)
