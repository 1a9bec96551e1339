"""Aligning many symbols on one calendar, and cross-sectional measures. Prices are never padded."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabar.functions.windows import along


@dataclass
class Panel:
    """Aligned bars, returns on the shared calendar, and what alignment cost."""

    bars: DataFrame
    returns: DataFrame
    coverage: DataFrame
    how: str

    @property
    def symbols(self) -> list[str]:
        return [r[0] for r in self.coverage.select("symbol").orderBy("symbol").collect()]


def shared_dates(bars: DataFrame, how: str = "intersect") -> DataFrame:
    """Dates of every symbol, or of any."""
    if how == "union":
        return bars.select("date").distinct()
    if how != "intersect":
        raise ValueError(f"how is 'intersect' or 'union', not {how!r}")
    n = bars.agg(F.count_distinct("symbol")).first()[0]
    return bars.groupBy("date").agg(F.count_distinct("symbol").alias("n")).where(F.col("n") == n).select("date")


def aligned(bars: DataFrame, how: str = "intersect") -> DataFrame:
    """(symbol, date, close) on the shared dates; under union a missing bar is null."""
    dates = shared_dates(bars, how)
    if how == "intersect":
        return bars.join(dates, "date", "left_semi").select("symbol", "date", "close")
    grid = dates.join(F.broadcast(bars.select("symbol").distinct()), F.lit(True))
    return grid.join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left")


def returns(bars: DataFrame, how: str = "intersect") -> DataFrame:
    """Log returns on the aligned calendar: a null close makes its own and the next return null."""
    return aligned(bars, how).select("symbol", "date", (F.ln("close") - F.lag(F.ln("close")).over(along())).alias("ret"))


def coverage(bars: DataFrame, how: str = "intersect") -> DataFrame:
    """(symbol, own_bars, in_panel, dropped, missing_in_panel)."""
    dates = shared_dates(bars, how)
    total = dates.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    own = bars.groupBy("symbol").agg(F.count_distinct("date").alias("own_bars"))
    kept = bars.select("symbol", "date").distinct().join(dates, "date", "left_semi").groupBy("symbol").agg(F.count("*").alias("in_panel"))
    both = own.join(kept, "symbol", "left").withColumn("in_panel", F.coalesce("in_panel", F.lit(0))).withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
    return both.select("symbol", "own_bars", "in_panel", (F.col("own_bars") - F.col("in_panel")).alias("dropped"), (F.col("n") - F.col("in_panel")).alias("missing_in_panel"))


def spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def breakdown(bars: DataFrame) -> DataFrame:
    """One row: dates available and kept, and those lost before, after and inside the common span."""
    edge = spans(bars).agg(F.max("first").alias("panel_start"), F.min("last").alias("panel_end"), F.count("*").alias("symbols"))
    days = bars.groupBy("date").agg(F.count_distinct("symbol").alias("n")).withColumn("k", F.lit(1)).join(F.broadcast(edge.withColumn("k", F.lit(1))), "k")
    inside = (F.col("date") >= F.col("panel_start")) & (F.col("date") <= F.col("panel_end"))
    return days.groupBy("panel_start", "panel_end").agg(
        F.count("*").alias("available"), F.count_if(F.col("n") == F.col("symbols")).alias("kept"), F.count_if(F.col("date") < F.col("panel_start")).alias("leading"),
        F.count_if(F.col("date") > F.col("panel_end")).alias("trailing"), F.count_if(inside & (F.col("n") < F.col("symbols"))).alias("interior"),
    )


def blame(bars: DataFrame) -> DataFrame:
    """(symbol, missing): how many dates lost inside the common span each symbol lacks."""
    edge = spans(bars).agg(F.max("first").alias("a"), F.min("last").alias("z"), F.count("*").alias("symbols")).withColumn("k", F.lit(1))
    lost = bars.groupBy("date").agg(F.count_distinct("symbol").alias("n")).withColumn("k", F.lit(1)).join(F.broadcast(edge), "k").where("date between a and z and n < symbols").select("date")
    grid = lost.join(F.broadcast(bars.select("symbol").distinct()), F.lit(True))
    return grid.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti").groupBy("symbol").agg(F.count("*").alias("missing"))


def notes(bars: DataFrame, how: str = "intersect", least: float = 0.90, thin: float = 0.02) -> DataFrame:
    """(symbol, note) on symbols that thin the panel, or that a union leaves empty."""
    c = coverage(bars, how)
    if how == "union":
        n = F.col("in_panel") + F.col("missing_in_panel")
        return c.where(F.col("missing_in_panel") > thin * n).select("symbol", F.format_string("null on %d of %d dates", F.col("missing_in_panel"), n).alias("note"))
    widest = c.withColumn("k", F.lit(1)).join(F.broadcast(c.agg(F.max("own_bars").alias("widest")).withColumn("k", F.lit(1))), "k")
    return widest.where(F.col("own_bars") < least * F.col("widest")).select("symbol", F.format_string("%d of %d bars", "own_bars", "widest").alias("note"))


def load(bars: DataFrame, how: str = "intersect") -> Panel:
    return Panel(aligned(bars, how), returns(bars, how), coverage(bars, how), how)


def average_correlation(rets: DataFrame, window: int = 60, least: int | None = None) -> DataFrame:
    """(date, avg_corr): mean trailing correlation over all pairs, null while a pair lacks one."""
    least = max(window // 2, 20) if least is None else least
    n = rets.agg(F.count_distinct("symbol")).first()[0]
    pairs = n * (n - 1) // 2
    a, b = rets.select("date", F.col("symbol").alias("a"), F.col("ret").alias("x")), rets.select("date", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    both = a.join(b, "date").where("a < b")
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(1 - window, 0)
    known = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)
    corr = both.select("date", F.when(F.count(known).over(w) >= least, F.corr("x", "y").over(w)).alias("c"))
    per = corr.groupBy("date").agg(F.when(F.count("c") == max(pairs, 1), F.avg("c")).alias("avg_corr"))
    dates = rets.select("date").distinct()
    return dates.join(per, "date", "left")


def dispersion(rets: DataFrame) -> DataFrame:
    return rets.groupBy("date").agg(F.stddev_samp("ret").alias("dispersion"))


def breadth(rets: DataFrame) -> DataFrame:
    return rets.groupBy("date").agg(F.try_divide(F.count_if(F.col("ret") > 0), F.count("ret")).alias("breadth"))


def absorption_ratio(rets: DataFrame, window: int = 252, components: int = 1) -> DataFrame:
    """(date, absorption): share of the largest eigenvalues of the trailing correlation matrix over complete dates.

    Needs eigenvalues of a matrix over all symbols, so dates are dealt in
    chunks, each with the window before it, and solved in numpy batches.
    """
    symbols = [r[0] for r in rets.select("symbol").distinct().orderBy("symbol").collect()]
    wide = rets.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "ret"))).alias("m")).select("date", F.array(*(F.element_at("m", F.lit(s)) for s in symbols)).alias("v"))
    numbered = wide.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    size = max(window, 250)
    chunk = F.floor((F.col("i") - 1) / size).cast("int")
    dealt = numbered.withColumn("c", F.explode(F.array(chunk, chunk + 1)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        c = int(frame["c"].iloc[0])
        x = np.array([[np.nan if v is None else v for v in row] for row in frame["v"]], dtype=float)
        own = ((frame["i"].to_numpy() - 1) // size) == c
        out = np.full(len(x), np.nan)
        for t in np.flatnonzero(own):
            part = x[max(0, t - window + 1) : t + 1]
            part = part[np.isfinite(part).all(axis=1)]
            if len(part) < window or part.shape[1] < 2 or (part.std(axis=0) == 0).any():
                continue
            values = np.linalg.eigvalsh(np.corrcoef(part.T))[::-1]
            out[t] = values[:components].sum() / values.sum()
        return pd.DataFrame({"date": frame["date"][own], "absorption": pd.Series(out[own], index=frame.index[own])}).replace({np.nan: None})

    return dealt.groupBy("c").applyInPandas(solve, "date date, absorption double")


def cross_asset_features(rets: DataFrame, corr_window: int = 60, absorption_window: int = 252) -> DataFrame:
    """(date, avg_corr, dispersion, absorption, breadth)."""
    return average_correlation(rets, corr_window).join(dispersion(rets), "date", "left").join(absorption_ratio(rets, absorption_window), "date", "left").join(breadth(rets), "date", "left")
