"""Timers for jobs and plain functions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Profiler:
    """Seconds by name, and how often each was timed."""

    seconds: dict[str, float] = field(default_factory=dict)
    calls: dict[str, int] = field(default_factory=dict)
    began: float = field(default_factory=time.perf_counter)

    def record(self, name: str, seconds: float) -> None:
        self.seconds[name] = self.seconds.get(name, 0.0) + seconds
        self.calls[name] = self.calls.get(name, 0) + 1

    def elapsed(self) -> float:
        return time.perf_counter() - self.began

    def operations_per_second(self, name: str) -> float:
        spent = self.seconds.get(name, 0.0)
        return self.calls.get(name, 0) / spent if spent else 0.0

    def table(self, spark):
        """Rows (name, calls, seconds)."""
        return spark.createDataFrame([(k, self.calls[k], v) for k, v in sorted(self.seconds.items())], "name string, calls bigint, seconds double")


def measure(run: Callable[[], Any]) -> tuple[Any, float]:
    """What ``run`` returns, and its seconds."""
    began = time.perf_counter()
    found = run()
    return found, time.perf_counter() - began


def benchmark(run: Callable[[], Any], times: int, warm_ups: int = 10) -> dict[str, float]:
    """Least, mean and greatest seconds of ``times`` runs, after as many warm-ups, at most ``warm_ups``."""
    if times < 1:
        raise ValueError("at least one run")
    for _ in range(min(times, warm_ups)):
        run()
    spent = [measure(run)[1] for _ in range(times)]
    return {"min": min(spent), "mean": sum(spent) / times, "max": max(spent)}
