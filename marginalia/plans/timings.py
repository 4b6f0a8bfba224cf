"""How long the stages of a check take, and how many rows they give."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Timings:
    """Seconds and rows of named stages. Rows are observed while a sink runs, so nothing is run for being counted."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self._observed: dict[str, Observation] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """The time of an action within; stages of one name add up."""
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start

    def counted(self, name: str, rows: DataFrame) -> DataFrame:
        """`rows`, whose number is known once an action has read them."""
        self._observed[name] = Observation(name)
        return rows.observe(self._observed[name], F.count("*").alias("rows"))

    def report(self) -> list[tuple[str, float | None, int | None]]:
        """stage, seconds, rows, in the order in which stages were named."""
        names = dict.fromkeys([*self.seconds, *self._observed])
        return [(n, self.seconds.get(n), self._observed[n].get["rows"] if n in self._observed else None) for n in names]
