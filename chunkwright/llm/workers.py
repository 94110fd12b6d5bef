"""What a reused Python worker keeps between tasks: the tables of one operator at a time."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

_KEPT: dict[str, Callable[[], None]] = {}


def enter(name: str, release: Callable[[], None] = lambda: None) -> None:
    """Begin a task of operator ``name``: other operators' tables go; ``release`` frees this one's when its turn comes."""
    others = [n for n in _KEPT if n != name]
    for other in others:
        _KEPT.pop(other)()
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps the memory
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _KEPT[name] = release
