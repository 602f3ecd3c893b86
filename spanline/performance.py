"""Figures of the jobs that operators run themselves, for a callback.

A result is lazy, so its own run is the caller's and stands in Spark's UI; what is told here is the
time to plan a merge and the jobs that planning takes.
"""
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

_callback: Callable[[str, dict[str, float]], None] | None = None


def configure_performance_logger(callback: Callable[[str, dict[str, float]], None] | None) -> None:
    """Have callback(event, figures) called after each event; None turns it off.

    Events: `merge` (seconds, actions, keys), `length_classes` (seconds, classes) and `written_table` (seconds, columns).
    """
    global _callback
    _callback = callback


@contextmanager
def timed(event: str, **figures: float) -> Iterator[dict[str, float]]:
    """Tell the callback how long a block took; the block may add figures. A block that fails tells nothing."""
    began = time.perf_counter()
    yield figures
    if _callback:
        _callback(event, {"seconds": time.perf_counter() - began} | {k: float(v) for k, v in figures.items()})
