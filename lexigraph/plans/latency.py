"""How long the stages of a query take on the driver's clock."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Latency:
    """Milliseconds per stage; a stage that is entered again adds up."""

    def __init__(self) -> None:
        self._ms: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self._ms[name] = self._ms.get(name, 0.0) + (time.perf_counter() - start) * 1000

    def metrics(self) -> dict[str, float]:
        """Every stage, and their sum as total."""
        return {**self._ms, "total": sum(self._ms.values())}
