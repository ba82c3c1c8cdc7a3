"""Memory of Python workers: they are reused, so what a task took at its peak would stay with them."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return this process's free memory to the system. Python workers are reused, and an idle one would keep what its task's peak took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
