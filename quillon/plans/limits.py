"""Runs under limits: wall time and cancellation by job tags, and reservations of memory among runs of one driver."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """A run was ended by its token or its wall limit."""


class Token:
    """Cooperative cancellation: a run asks it between steps, and its jobs carry its tag."""

    def __init__(self) -> None:
        self.tag = f"quillon-{uuid.uuid4().hex}"
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("the run was cancelled")


def limited(spark: SparkSession, run: Callable[[Token], object], seconds: float, token: Token | None = None) -> object:
    """``run(token)`` with its Spark jobs tagged; beyond so many seconds its jobs are interrupted and Cancelled is raised."""
    token = token or Token()
    timer = threading.Timer(seconds, lambda: (token.cancel(), spark.interruptTag(token.tag)))
    spark.addTag(token.tag)
    timer.start()
    try:
        out = run(token)
        token.check()
        return out
    except Exception as e:
        if token.cancelled and not isinstance(e, Cancelled):
            raise Cancelled(f"stopped after {seconds} seconds or by its token") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(token.tag)


class Reservations:
    """Bytes that runs of one driver reserve before they start; what does not fit waits or is refused."""

    def __init__(self, total: int) -> None:
        self.total, self.used = total, 0
        self._free = threading.Condition()

    def try_reserve(self, size: int) -> bool:
        with self._free:
            if size < 0 or self.used + size > self.total:
                return False
            self.used += size
            return True

    def release(self, size: int) -> None:
        with self._free:
            self.used -= size
            self._free.notify_all()

    @contextmanager
    def reserved(self, size: int, timeout: float | None = None) -> Iterator[None]:
        """Waits for the bytes; more than there are at all is an error at once."""
        if size > self.total:
            raise MemoryError(f"{size} bytes are more than all {self.total}")
        with self._free:
            if not self._free.wait_for(lambda: self.used + size <= self.total, timeout):
                raise TimeoutError("no memory became free in time")
            self.used += size
        try:
            yield
        finally:
            self.release(size)
