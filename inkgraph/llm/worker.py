"""What a Python worker keeps from one task to the next: one large object at most.

Workers are used again by the tasks of other stages, so a table kept for one of them would otherwise
lie beside those of the next.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_KEPT: dict[Hashable, Any] = {}


def trim() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of this key, made if it isn't the one kept; the one kept before is let go."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Keep nothing."""
    if _KEPT:
        _KEPT.clear()
        trim()
