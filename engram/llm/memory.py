"""Python workers live on between tasks: what a task has held is given back at its end."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def tidy() -> None:
    """Return freed memory of Python, Arrow and the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, with ``tidy`` after its last batch."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        tidy()

    return wrapped
