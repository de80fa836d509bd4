"""Small helpers of the corpus operators, and their scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import Scratch, partitions, shared_dir

__all__ = ["SPACE", "WORD", "Scratch", "enter", "partitions", "shared_dir", "text_or_empty", "worker_cache"]

#: `[\x20\x09-\x0D]`, the white space of every contract here.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_caches: dict[str, Callable[[], None]] = {}


def worker_cache(owner: str, clear: Callable[[], None]) -> None:
    """Names a cache that Python workers keep between tasks of one operator."""
    _caches[owner] = clear


def enter(owner: str) -> None:
    """Called when a worker starts a task: Spark reuses workers, so what other operators cached there goes, and freed
    memory goes back to the system."""
    for other, clear in _caches.items():
        if other != owner:
            clear()
    leave()


def leave() -> None:
    """Called when a task is done: what it no longer uses goes back to the system, as idle workers stay alive."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
