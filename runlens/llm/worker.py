"""What a Python worker holds between its tasks: one operator's model at a time, and no spare memory.

Workers are used again by later tasks, of other operators, too. Without this, what each operator has kept and the
heap that it has once needed add up within an executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa

_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """``make()``, kept under ``name`` until an operator of another name runs in this worker."""
    leave(name)
    if name not in _held:
        _held[name] = make()
    return _held[name]


def leave(name: str) -> None:
    """Drop what is held under other names."""
    if any(other != name for other in _held):
        mine = {k: v for k, v in _held.items() if k == name}
        _held.clear()
        _held.update(mine)
        give_back()


def give_back() -> None:
    """Return free memory to the system: Arrow's pool and, with glibc, the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str = "") -> Callable:
    """``run`` for ``mapInArrow``, by a worker that holds nothing but ``name`` and gives memory back at the end."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave(name)
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def tidy_group(run: Callable[[pd.DataFrame], pd.DataFrame], name: str = "") -> Callable:
    """The same for ``applyInPandas``."""
    def task(group: pd.DataFrame) -> pd.DataFrame:
        leave(name)
        try:
            return run(group)
        finally:
            give_back()
    return task
