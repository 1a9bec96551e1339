"""Bar intervals and weekly bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """How often bars come and how many make a year."""

    key: str
    label: str
    periods_per_year: float
    weekly: bool
    least_bars: int

    @property
    def ann(self) -> float:
        return self.periods_per_year**0.5


DAILY = Interval("1d", "daily", 252.0, False, 500)
WEEKLY = Interval("1wk", "weekly", 52.0, True, 150)
SPELLINGS = {DAILY: ("1d", "d", "day", "daily"), WEEKLY: ("1wk", "w", "wk", "week", "weekly")}


def interval(key: str | Interval | None) -> Interval:
    """An interval by key or spelling in any case; None is daily."""
    if key is None or isinstance(key, Interval):
        return key or DAILY
    wanted = str(key).strip().lower()
    for found, names in SPELLINGS.items():
        if wanted in names:
            return found
    raise ValueError(f"no interval {key!r}; known: {', '.join(n for names in SPELLINGS.values() for n in names)}")


def week_end(date: Column | str) -> Column:
    """The Friday that closes the (Saturday, Friday] week of a date."""
    return F.next_day(F.date_sub(F.col(date) if isinstance(date, str) else date, 1), "FRI")


def weekly(bars: DataFrame) -> DataFrame:
    """Weekly bars labelled by Friday, the trailing partial week kept.

    Open and close are the first and last that are not null; weeks without a
    close go. data_end is the symbol's last daily date, last_bar_partial
    whether the last label lies past it.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)
    weeks = bars.groupBy("symbol", week_end("date").alias("week")).agg(first("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.max("date").alias("__last"))
    ends = weeks.groupBy("symbol").agg(F.max("__last").alias("data_end"), F.max(F.when(F.col("close").isNotNull(), F.col("week"))).alias("__week"))
    out = weeks.where("close is not null").join(ends, "symbol")
    return out.select("symbol", F.col("week").alias("date"), "open", "high", "low", "close", "volume", "data_end", (F.col("__week") > F.col("data_end")).alias("last_bar_partial"))


def at(bars: DataFrame, key: str | Interval | None) -> DataFrame:
    """Daily bars at an interval, with interval and periods_per_year as columns."""
    i = interval(key)
    out = weekly(bars) if i.weekly else bars
    return out.withColumns({"interval": F.lit(i.key), "periods_per_year": F.lit(i.periods_per_year)})


def require_daily(rows: DataFrame, who: str) -> DataFrame:
    """``rows`` as they are; a read fails on any that carry another ``periods_per_year`` than the 252 that ``who`` fixes."""
    if "periods_per_year" not in rows.columns:
        return rows
    ok = F.col("periods_per_year").isNull() | (F.col("periods_per_year") == 252)
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"{who} is defined for daily bars only")).cast("boolean")))
