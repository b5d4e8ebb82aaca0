"""What a Python worker keeps between tasks.

Workers are used again by later stages, of other operators too. So a worker keeps one thing only, the model or vocabulary
of the operator it ran last with the words that were looked up in it. The next operator's takes its place, or nothing
does. What stages have kept thus never adds up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")

_HELD: list[tuple[Hashable, object]] = []


def let_go() -> None:
    """Drop what this worker holds, and hand free memory back to the system where its C library can."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def held(key: Hashable, make: Callable[[], T]) -> T:
    """What was made for ``key`` in this worker, made now unless the last call had an equal key."""
    if not _HELD or _HELD[0][0] != key:
        # the old one goes before the new one comes
        let_go()
        _HELD.append((key, make()))
    return _HELD[0][1]
