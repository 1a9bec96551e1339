"""Windows over one symbol's bars in order of date, and guarded frames."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def along(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("date")


def trail(n: int, *keys: str) -> WindowSpec:
    """The row and the n - 1 before it."""
    return along(*keys).rowsBetween(1 - n, 0)


def guarded(value: Column, counted: Column | str, least: int, window: WindowSpec) -> Column:
    """An aggregate over a frame, null while the frame holds fewer than ``least`` values."""
    return F.when(F.count(counted).over(window) >= least, value.over(window))


def mean(column: str, n: int, least: int | None = None, *keys: str) -> Column:
    return guarded(F.avg(column), column, least or n, trail(n, *keys))


def deviation(column: str, n: int, least: int | None = None, *keys: str) -> Column:
    return guarded(F.stddev_samp(column), column, least or n, trail(n, *keys))


def zscore(column: str, n: int = 252, least: int = 60, floor: float = 0.0, *keys: str) -> Column:
    """Trailing z score; null where the deviation is not above ``floor``."""
    sd = deviation(column, n, least, *keys)
    return (F.col(column) - mean(column, n, least, *keys)) / F.when(sd > floor, sd)
