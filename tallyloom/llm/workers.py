"""What a Python worker keeps between its tasks, and gives back.

A worker lives on from stage to stage. What one operator remembers there goes when a task of another one begins, and large
arrays that a task has freed are handed back to the system at its end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, clear: Callable[[], None]) -> None:
    """The operators of a name keep something in this process, which clear() drops."""
    _kept[name] = clear


def task(work: Callable[[Iterator], Iterator], name: str = "", *, fast: bool = False) -> Callable[[Iterator], Iterator]:
    """work as a task of a name: what others keep is dropped before it, and what it has freed is given back.

    fast: freed memory stays with the process, which saves some time.
    """

    def run(batches: Iterator) -> Iterator:
        if not fast:
            # Arrays of a megabyte or more are mapped on their own (-3 names that threshold), so that they go back when they are freed.
            _c("mallopt", -3, 1 << 20)
            pa.set_memory_pool(pa.system_memory_pool())
        for other, clear in _kept.items():
            if other != name:
                clear()
        yield from work(batches)
        if not fast:
            release()

    return run


def _c(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):  # another C library
        pass


def release() -> None:
    pa.default_memory_pool().release_unused()
    _c("malloc_trim", 0)
