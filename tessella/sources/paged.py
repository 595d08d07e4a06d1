"""Paged services as a Spark data source: a partition a cell of the grid, pages read until a short one.

fetch(cell, start, count) -> list of rows is given by the caller and runs on the executors. A filter
that the service can test (text in its own language, such as CQL) is handed to it as a fourth argument; what it
cannot test stays a filter of the DataFrame, and is applied to what comes back in any case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import last_wins


def pages(fetch: Callable[[tuple, int, int], list[dict]], cell: tuple, count: int) -> Iterator[dict]:
    start = 0
    while True:
        rows = fetch(cell, start, count)
        yield from rows
        if len(rows) < count:
            return
        start += count


def cql(tests: list[tuple[str, str, object]]) -> str:
    """(column, operator, value) tests as one predicate text; operators: = <> < <= > >= in."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return " AND ".join(f"{c} IN ({', '.join(map(quoted, v))})" if op == "in" else f"{c} {op} {quoted(v)}" for c, op, v in tests)


def paged(
    spark: SparkSession, fetch: Callable[..., list[dict]], cells: list[tuple], schema: str, key: str = "id", count: int = 1000,
    pushed: list[tuple[str, str, object]] | None = None, residual: str | None = None,
) -> DataFrame:
    """All rows of all cells, once each by key: a feature across cells is taken from the last cell.

    pushed: tests that the service applies; these, which a service may apply loosely, and residual (SQL) filter what comes back.
    """
    import pandas as pd

    names = [c.split()[0] for c in schema.split(",")]
    more = (cql(pushed),) if pushed else ()

    def read(parts):
        for part in parts:
            for n, *cell in part.itertuples(index=False):
                rows = [(*[r.get(c) for c in names], n) for r in pages(lambda *x: fetch(*x, *more), tuple(cell), count)]
                yield pd.DataFrame(rows, columns=[*names, "_cell"])

    frame = spark.createDataFrame([(n, *map(float, c)) for n, c in enumerate(cells)], "n int, x0 double, y0 double, x1 double, y1 double")
    found = frame.repartition(max(1, len(cells)), "n").mapInPandas(read, f"{schema}, _cell int")
    for test in [*more, *([residual] if residual else [])]:
        found = found.filter(test)
    return last_wins(found, [key], [F.col("_cell")]).drop("_cell")
