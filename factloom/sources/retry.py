"""Calls that may fail for a moment."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")

# Attempts, base delay in seconds, statuses worth another try.
ATTEMPTS, DELAY = 4, 1.0
PASSING = (429, 500, 502, 503, 504)


class HostError(Exception):
    """A host's answer other than success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_retry(call: Callable[[], T], attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; a passing failure waits twice as long each time, with some jitter, any other is final."""
    for n in range(attempts):
        try:
            return call()
        except HostError as e:
            if e.status not in PASSING or n == attempts - 1:
                raise
            sleep(delay * 2**n + random.uniform(0, delay / 4))
    raise ValueError("no attempt was allowed")
