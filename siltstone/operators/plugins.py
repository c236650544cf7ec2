"""Simulations by name: a callable takes (rows, arguments) and returns a frame."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

Plugin = Callable[[DataFrame, Mapping], DataFrame]
_known: dict[str, Plugin] = {}


def register(name: str, run: Plugin) -> None:
    _known[name] = run


def simulate(name: str, rows: DataFrame, args: Mapping | None = None) -> DataFrame:
    """Runs a registered plugin, or the function ``init`` of the module of that name."""
    run = _known.get(name)
    if run is None:
        run = importlib.import_module(name).init
    return run(rows, args or {})


def each_partition(rows: DataFrame, ingest: Callable, columns: list[str]) -> int:
    """Calls ``ingest`` with an iterator of each partition's rows (walks and enumerations); gives how many rows there were."""
    total = rows.sparkSession.sparkContext.accumulator(0)

    def run(part) -> None:
        n = 0

        def counted():
            nonlocal n
            for r in part:
                n += 1
                yield r

        ingest(counted())
        total.add(n)

    rows.select(*columns).foreachPartition(run)
    return total.value
