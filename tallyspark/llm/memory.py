"""Python workers stay alive between tasks and stages: each holds one operator's model at a time, and what a finished task has freed goes back to the system."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[object, Any] = {}


def held(key: object, make: Callable[[], Any]) -> Any:
    """The worker's model under ``key``, made where it isn't there; any other model goes."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Returns freed memory: Python's own, Arrow's, and the C library's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim keeps its memory
        ctypes.CDLL("libc.so.6").malloc_trim(0)
