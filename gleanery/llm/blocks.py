"""Arrow batches to bounded blocks of rows, for operators that run in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 4 << 20


def blocks(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in ``column`` take about ``limit`` bytes; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = lengths(batch.column(column))
        ends, at, total = np.cumsum(size), 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, total + limit, "right")))
            yield batch.slice(at, to - at)
            at, total = to, int(ends[to - 1])


_RELEASE: list[Callable[[], None]] = []
_last: str | None = None


def held_by_process(release: Callable[[], None]) -> None:
    """Says how to drop what a module keeps in its process between tasks."""
    _RELEASE.append(release)


def enter(module: str) -> None:
    """A task of a module begins: what modules kept for another one's tasks goes."""
    global _last
    if _last is not None and _last != module:
        for release in _RELEASE:
            release()
        give_back()
    _last = module


def tidy(work: Callable) -> Callable:
    """The same work on batches; its process, which is kept for other tasks, gives freed memory back before and after."""
    module = work.__module__

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(module)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each value; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets_of(lists: pa.Array) -> np.ndarray:
    """Offsets of a list array (sliced ones too), starting at 0."""
    o = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return o - o[0] if len(o) else np.zeros(1, np.int64)


def take_ranges(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + counts[i]]`` for all i, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
    return values[at]


class RecentCache:
    """A dictionary of at most twice ``half`` entries; those not asked for lately go first."""

    def __init__(self, half: int):
        self.half, self.young, self.old = half, {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def get_all(self, keys: list, make) -> list:
        """The values of the keys; ``make(missing keys)`` gives the missing ones' values."""
        young, old, missing = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    missing.append(k)
        if missing:
            young.update(zip(missing, make(missing), strict=True))
        out = [young[k] for k in keys]
        if len(young) > self.half:
            self.young, self.old = {}, young
        return out
