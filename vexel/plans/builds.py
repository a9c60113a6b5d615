"""Index builds that wait for their turn."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(order=True)
class _Build:
    rank: tuple[int, int]
    name: str = field(compare=False)
    build: Callable[[], object] = field(compare=False)


class BuildQueue:
    """Builds by priority, the greatest first, and in the order they came among equals. A name waits once: asked again, it keeps the greater priority."""

    def __init__(self) -> None:
        self.heap: list[_Build] = []
        self.came = 0
        self.failed: dict[str, str] = {}

    def add(self, name: str, build: Callable[[], object], priority: int = 0) -> bool:
        """False if the name waits already with a priority as great."""
        for b in self.heap:
            if b.name == name:
                if -b.rank[0] >= priority:
                    return False
                self.heap.remove(b)
                heapq.heapify(self.heap)
                break
        heapq.heappush(self.heap, _Build((-priority, self.came), name, build))
        self.came += 1
        return True

    def run(self) -> list[str]:
        """Runs what waits, each to its end; the names in the order they ran. A failure is noted and the rest goes on."""
        done = []
        while self.heap:
            b = heapq.heappop(self.heap)
            try:
                b.build()
            except Exception as e:
                self.failed[b.name] = str(e)[:500]
            done.append(b.name)
        return done
