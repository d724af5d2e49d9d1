"""Seconds and memory of steps, and text tables for the command line."""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def memory(spark: SparkSession | None = None) -> dict[str, float]:
    """Megabytes: the peak of this process, and what the driver's JVM uses of its heap now."""
    out = {"python_peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}
    if spark is not None:
        jvm = spark._jvm.java.lang.Runtime.getRuntime()
        out["jvm_used_mb"] = (jvm.totalMemory() - jvm.freeMemory()) / 2**20
    return out


class Steps:
    """Named steps with their seconds, rows and memory, in the order of their ends."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.rows = spark, []

    @contextmanager
    def step(self, name: str) -> Iterator[dict]:
        """Times a block, also one that fails. The block may set ``rows`` in what it is given."""
        note: dict = {}
        began = time.perf_counter()
        try:
            yield note
        finally:
            self.rows.append({"step": name, "seconds": time.perf_counter() - began, "rows": note.get("rows")} | memory(self.spark))

    def table(self) -> str:
        lines = [(r["step"], f"{r['seconds']:.3f}s", thousands(r["rows"]), rate(r["rows"], r["seconds"]), *(f"{v:,.0f}" for k, v in r.items() if k.endswith("_mb"))) for r in self.rows]
        return text_table(["step", "time", "rows", "rate", "python MB", *(["JVM MB"] if self.spark is not None else [])], lines)


def thousands(n: int | None) -> str:
    return "" if n is None else f"{n:,}"


def rate(n: int | None, seconds: float) -> str:
    return "" if n is None else f"{n / seconds:,.0f}/s" if seconds > 0 else "n/a"


def text_table(columns: list[str], rows: list[tuple]) -> str:
    """Columns of equal width under a rule; numbers stand at the right."""
    cells = [["" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r] for r in rows]
    right = [bool(rows) and all(isinstance(r[i], (int, float)) or r[i] is None for r in rows) for i in range(len(columns))]
    widths = [max(len(c), *(len(r[i]) for r in cells), 0) if cells else len(c) for i, c in enumerate(columns)]
    line = lambda r: "  ".join(c.rjust(w) if at_right else c.ljust(w) for c, w, at_right in zip(r, widths, right)).rstrip()
    return "\n".join([line(columns), "  ".join("-" * w for w in widths), *map(line, cells)])
