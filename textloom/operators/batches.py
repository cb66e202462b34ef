"""How Arrow functions take a batch of rows: Python objects are made of a part of it at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

PART = 2 << 20  #: bytes of Arrow data that are Python objects at a time


def parts(x: pa.Array, most: int = PART) -> list[pa.Array]:
    """The rows in slices of at most so many bytes, or of one row."""
    if len(x) < 2 or x.nbytes <= most:
        return [x]
    half = len(x) // 2
    return parts(x[:half], most) + parts(x[half:], most)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = None


def by_parts(x: pa.Array, f: Callable[[pa.Array], pa.Array], most: int = PART) -> pa.Array:
    """f over the parts, joined. A batch holds up to 64 MB; as lists of strings and numbers it would be many times that."""
    some = parts(x, most)
    if len(some) == 1:
        return f(x)
    out = pa.concat_arrays([f(p) for p in some])
    pa.default_memory_pool().release_unused()  # the worker waits in its pool afterwards
    if _trim:
        _trim(0)
    return out
