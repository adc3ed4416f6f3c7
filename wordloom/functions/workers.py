"""Python workers' memory."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def lean() -> None:
    """For the functions that run in workers: Arrow's buffers come from the system, and what is free goes back to it.
    Workers stay when their tasks are done, several to a core, and would hold the most that each has ever used."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
