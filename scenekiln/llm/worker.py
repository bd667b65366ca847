"""What a Python worker keeps from task to task. Workers serve one stage after the other and are not ended between."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_KEPT: dict[str, dict] = {}


def _give_back() -> None:
    """Free memory that allocators hold on to, which a worker would else keep through the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library gives memory back by itself or not at all
        pass


def kept(owner: str) -> dict:
    """The operator's store in this worker. Stores of other operators are let go. Called once a batch."""
    if owner not in _KEPT:
        _KEPT.clear()
        gc.collect()
        _KEPT[owner] = {}
    _give_back()
    return _KEPT[owner]
