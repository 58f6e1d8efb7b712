"""Memory of Python workers, which Spark uses again for task after task.

What a task frees should go back to the system: Arrow must not keep it in a
pool of its own, and the C library not in its heap. Every module whose
functions run in workers imports this one.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: mallopt(M_MMAP_THRESHOLD): blocks of this size or more are mapped alone and unmapped when freed. Fixed value of the C library.
_M_MMAP_THRESHOLD = -3
_MAPPED_BYTES = 1 << 17

pa.set_memory_pool(pa.system_memory_pool())
_LIBRARY = ctypes.CDLL(None)
if hasattr(_LIBRARY, "mallopt"):
    _LIBRARY.mallopt(_M_MMAP_THRESHOLD, _MAPPED_BYTES)


def give_back() -> None:
    """Returns freed memory to the system; called where a task has dropped much."""
    if hasattr(_LIBRARY, "malloc_trim"):
        _LIBRARY.malloc_trim(0)
