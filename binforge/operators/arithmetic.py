"""The switch of free arithmetic: negative frequencies, and arrays as operands of histograms.

It is off unless switched on, for a block of code and the thread or task that runs it.
"""

from __future__ import annotations

import contextlib
import contextvars
from collections.abc import Iterator

_free: contextvars.ContextVar[bool] = contextvars.ContextVar("free_arithmetic", default=False)


def is_free() -> bool:
    return _free.get()


@contextlib.contextmanager
def free_arithmetic(on: bool = True) -> Iterator[None]:
    """Within, frequencies may be negative and arrays be added to, multiplied with and divide histograms."""
    was = _free.set(on)
    try:
        yield
    finally:
        _free.reset(was)
