"""Calls to a generator that only takes so many of them: kept apart, tried again, and given up for the day."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


class TooFast(Exception):
    """The generator asks to wait; for_today says that waiting doesn't help before the next day."""

    def __init__(self, message: str = "", for_today: bool = False):
        super().__init__(message)
        self.for_today = for_today


@dataclass
class Paced:
    """A generator (prompt -> response) behind its limits.

    Calls begin at least `apart` seconds after each other. One that comes too fast is tried again after
    `pause` seconds, `retries` times at most; one that fails has no response. Once the day's quota is
    spent, TooFast is raised for this and every later call, and what was kept before stays: a later
    run goes on from there, as corpus.generate() only tries what is lacking.
    """

    call: Callable[[str], str]
    apart: float = 2.0
    pause: float = 60.0
    retries: int = 3
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    spent: bool = field(default=False, init=False)
    _next: float = field(default=float("-inf"), init=False)

    def __call__(self, prompt: str) -> str | None:
        for left in range(self.retries, -1, -1):
            if self.spent:
                raise TooFast("the day's quota is spent", for_today=True)
            if (wait := self._next - self.clock()) > 0:
                self.sleep(wait)
            self._next = self.clock() + self.apart
            try:
                return self.call(prompt)
            except TooFast as limit:
                self.spent = limit.for_today
                if left and not self.spent:
                    self.sleep(self.pause)
            except Exception:  # a failed call has no response; the caller discards it
                return None
        if self.spent:
            raise TooFast("the day's quota is spent", for_today=True)
        return None
