"""Small helpers: sizes, numbers, lists, timing and a log with the levels of a run."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

SUCCESS, SKIP, RESUME = 25, 24, 23
for _level, _name in ((SUCCESS, "SUCCESS"), (SKIP, "SKIP"), (RESUME, "RESUME")):
    logging.addLevelName(_level, _name)


def bytes_to_mb(n: float) -> float:
    return n / 2**20


def bytes_to_gb(n: float) -> float:
    return n / 2**30


def format_number(n: float) -> str:
    return f"{n:,.2f}".rstrip("0").rstrip(".") if isinstance(n, float) else f"{n:,}"


def flatten(items: Iterable) -> list:
    """Nested lists and tuples as one list."""
    return [y for x in items for y in (flatten(x) if isinstance(x, list | tuple) else [x])]


def clamp(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def safe_divide(a: float, b: float, default: float = 0.0) -> float:
    return a / b if b else default


def divided(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, default where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


class RunLog:
    """Entries of a run, kept for its report and passed on to `logging`."""

    def __init__(self, name: str = "lapidary") -> None:
        self.entries: list[dict] = []
        self._log = logging.getLogger(name)

    def _add(self, level: int, text: str) -> None:
        self.entries.append({"time": time.time(), "level": logging.getLevelName(level), "text": text})
        self._log.log(level, text)

    def info(self, text: str) -> None:
        self._add(logging.INFO, text)

    def success(self, text: str) -> None:
        self._add(SUCCESS, text)

    def warning(self, text: str) -> None:
        self._add(logging.WARNING, text)

    def error(self, text: str) -> None:
        self._add(logging.ERROR, text)

    def skip(self, text: str) -> None:
        self._add(SKIP, text)

    def resume(self, text: str) -> None:
        self._add(RESUME, text)

    def section(self, title: str) -> None:
        self._add(logging.INFO, f"--- {title} ---")


@contextmanager
def timed(name: str, log: RunLog | None = None) -> Iterator[dict]:
    """Seconds of a block, in the dict's `seconds` afterwards."""
    out, began = {"name": name, "seconds": 0.0}, time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        if log:
            log.info(f"{name}: {out['seconds']:.2f} s")
