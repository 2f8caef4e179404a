"""What all tasks in Python workers share."""
from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def tidy(run):
    """A task's function that gives freed memory back to the system at its end: Python workers outlive their tasks, and those of earlier
    stages would keep what they once needed."""
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass
    return wrapped
