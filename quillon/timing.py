"""Seconds and calls by operation, for the whole process."""

from __future__ import annotations

import functools
import threading
import time
from collections.abc import Callable

_lock = threading.Lock()
_seen: dict[str, list] = {}


def timed(name: str | Callable | None = None):
    """Decorator, with or without a name; failed calls count too."""

    def wrap(fn: Callable) -> Callable:
        label = name if isinstance(name, str) else fn.__qualname__

        @functools.wraps(fn)
        def call(*args, **kwargs):
            began = time.perf_counter()
            try:
                return fn(*args, **kwargs)
            finally:
                with _lock:
                    entry = _seen.setdefault(label, [0.0, 0])
                    entry[0] += time.perf_counter() - began
                    entry[1] += 1

        return call

    return wrap(name) if callable(name) else wrap


def timings() -> dict[str, dict[str, float]]:
    with _lock:
        return {k: {"total_seconds": s, "calls": n} for k, (s, n) in _seen.items()}


def reset_timings() -> None:
    with _lock:
        _seen.clear()
