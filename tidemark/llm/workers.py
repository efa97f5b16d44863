"""Memory of Python workers, which go on from task to task."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

PAUSE = 2.0


def give_back() -> None:
    """Memory that this process holds but doesn't use goes back to the system: a worker that waits for its next task would
    keep it beside the executor's heap. Where the C library can't, it stays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``. The worker gives memory back at the end, and after results every ``PAUSE`` seconds: it
    takes time to give it back and to get it again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() - last > PAUSE:
                give_back()
                last = time.monotonic()
        give_back()

    return wrapped


def frugal_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for ``applyInArrow`` of a group."""

    def wrapped(t: pa.Table) -> pa.Table:
        out = run(t)
        give_back()
        return out

    return wrapped


def frugal_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for ``applyInArrow`` of two groups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return wrapped
