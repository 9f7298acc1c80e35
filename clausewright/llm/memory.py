"""Memory of Python workers, which live longer than the task that needed it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return what is free in Arrow's pool and the C library's heap to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def kept(name: str, forget: Callable[[], None]) -> None:
    """Tell of a cache that lives as long as its worker, and how to empty it."""
    _kept[name] = forget


def make_room(keep: str | None = None) -> None:
    """Empty what other operators have kept in this worker."""
    for name, forget in _kept.items():
        if name != keep:
            forget()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with caches of other operators than keep's emptied before, and give_back
    when a partition ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(keep)
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
