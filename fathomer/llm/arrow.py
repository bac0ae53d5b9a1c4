"""Python workers: what they hold between tasks.

A worker stays alive after its task, and the allocators of Arrow and of the C
library keep what its largest batch took.  Functions over batches are wrapped so
that a worker gives this back when its task's rows end.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return unused memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over an iterator of batches that gives memory back at its end."""

    @functools.wraps(batches)
    def run(parts: Iterator) -> Iterator:
        try:
            yield from batches(parts)
        finally:
            give_back()

    return run
