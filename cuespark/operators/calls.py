"""Calls in flight: a task keeps several requests of a slow completer open, and all tasks share one budget.

A task that asks row by row waits for every answer.  ``in_flight`` keeps up to ``Budget.in_flight`` calls open,
takes the next row when any of them is done and gives results in the order in which they come.  Calls begin at a
``Pace``: a stage of n tasks may begin ``per_second`` calls a second, so each of them begins one every
n / per_second seconds, whichever tasks run at a time.  A completer that is rate limited holds up all calls of its task,
not only its own.  A task that ends early begins no further call.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice
from queue import SimpleQueue


class RateLimited(Exception):
    """A completer's signal that it may be asked again later."""


class Stopped(Exception):
    """The task has ended; the call was not begun."""


@dataclass(frozen=True)
class Budget:
    """What the tasks of a stage may use."""

    #: Open calls of a task.
    in_flight: int = 8
    #: Calls begun in a second by all tasks together; None: no bound.
    per_second: float | None = None
    #: Tasks that share it; None: as many as the session has shuffle partitions.
    tasks: int | None = None
    #: How often a rate-limited call is made, and the seconds between which the pause after it lies.
    attempts: int = 10
    least: float = 5.0
    most: float = 60.0


@dataclass
class Pace:
    """When the calls of one task may begin."""

    apart: float = 0.0
    _next: float = 0.0
    _held: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)
    _over: threading.Event = field(default_factory=threading.Event, repr=False)

    def turn(self) -> None:
        """Wait for the next free place; raises ``Stopped`` if the task ends meanwhile."""
        while True:
            with self._lock:
                now = time.monotonic()
                at = max(now, self._next, self._held)
                self._next = at + self.apart
            if self._over.wait(at - now) if at > now else self._over.is_set():
                raise Stopped
            if time.monotonic() >= self._held:  # else another call was told to wait meanwhile
                return

    def hold(self, seconds: float) -> None:
        with self._lock:
            self._held = max(self._held, time.monotonic() + seconds)

    def stop(self) -> None:
        self._over.set()


@dataclass
class Patient:
    """The wrapped completer at a pace, asked again while it is rate limited: up to ``attempts`` times, with
    random exponential pauses between ``least`` and ``most`` seconds that hold up the whole pace."""

    completer: Callable[[list[dict]], dict]
    attempts: int = 10
    least: float = 5.0
    most: float = 60.0
    pace: Pace = field(default_factory=Pace)

    def __call__(self, messages: list[dict]) -> dict:
        for attempt in range(1, self.attempts + 1):
            self.pace.turn()
            try:
                return self.completer(messages)
            except RateLimited:
                if attempt == self.attempts:
                    raise
                self.pace.hold(min(self.most, max(self.least, random.uniform(0, 2.0 ** (attempt - 1)))))
        raise ValueError("a budget needs at least one attempt")


def patient(completer: Callable[[list[dict]], dict], budget: Budget, tasks: int) -> Patient:
    """A task's completer under its share of the budget."""
    return Patient(completer, budget.attempts, budget.least, budget.most, Pace(tasks / budget.per_second if budget.per_second else 0.0))


def in_flight(work: Callable, rows: Iterable, most: int, pace: Pace) -> Iterator:
    """``work(row)`` for every row, at most ``most`` at a time, as they are done; rows are read as places get free."""
    rows, n_open, done = iter(rows), 0, SimpleQueue()
    pool = ThreadPoolExecutor(most, "call")
    try:
        while True:
            for row in islice(rows, most - n_open):
                pool.submit(work, row).add_done_callback(done.put)
                n_open += 1
            if not n_open:
                return
            call = done.get()
            n_open -= 1
            yield call.result()
    finally:
        pace.stop()
        pool.shutdown(wait=True, cancel_futures=True)
