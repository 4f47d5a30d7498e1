"""Seconds by phase."""

from __future__ import annotations

import time
from contextlib import contextmanager


class Clock:
    """Adds up the seconds of phases; one that ends in an error counts too."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str):
        begun = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - begun
