"""Collections kept in memory while they are searched, and let go when they are idle."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

IDLE_SECONDS = 15 * 60


@dataclass
class Resident:
    rows: DataFrame
    leases: int = 0
    used: float = 0.0


@dataclass
class Residency:
    """Loads a collection for the first lease and unloads those without a lease that weren't used for a while; one that is leased is never unloaded."""

    load: Callable[[str], DataFrame]
    idle: float = IDLE_SECONDS
    clock: Callable[[], float] = time.monotonic
    held: dict[str, Resident] = field(default_factory=dict)

    @contextmanager
    def lease(self, name: str) -> Iterator[DataFrame]:
        """The rows of a collection, in memory as far as they fit, else on disk."""
        if name not in self.held:
            self.held[name] = Resident(self.load(name).persist(StorageLevel.MEMORY_AND_DISK))
        here = self.held[name]
        here.leases += 1
        try:
            yield here.rows
        finally:
            here.leases -= 1
            here.used = self.clock()

    def state(self, name: str) -> str:
        """ready, if it is leased, idle, if it is loaded only, or absent."""
        here = self.held.get(name)
        return "absent" if here is None else "ready" if here.leases else "idle"

    def sweep(self) -> list[str]:
        """Unload what is idle; its names."""
        now = self.clock()
        gone = [n for n, r in self.held.items() if not r.leases and now - r.used >= self.idle]
        for name in gone:
            self.held.pop(name).rows.unpersist()
        return gone

    def unload(self, name: str) -> bool:
        """Unload now, unless it is leased."""
        if name not in self.held or self.held[name].leases:
            return False
        self.held.pop(name).rows.unpersist()
        return True
