"""Memory of Python workers: one large kept object, small slices of batches.

Spark reuses Python workers from task to task and from operator to operator.
What an operator keeps for its next task (a tokenizer with its word cache)
would otherwise stay while another operator needs the memory.  What is freed
goes back to the system at once: an executor's limit counts what its idle
workers hold.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa

ROWS_AT_ONCE = 2000

_kept: dict[Hashable, Any] = {}


def give_back() -> None:
    """Return freed memory (Arrow's and, on Linux, the allocator's) to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object kept under ``key``, made now if another one (or none) is kept."""
    if key not in _kept:
        free()
        _kept[key] = make()
    return _kept[key]


def free() -> None:
    """Drop what is kept; called by operators that keep nothing."""
    _kept.clear()
    give_back()


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most ``rows`` rows, so that what is made of their texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()
