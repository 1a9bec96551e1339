"""Rule-based state estimators as window expressions, and the common softmax."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabar.functions.windows import along, deviation, mean, zscore

STATES = ("down", "range", "up")
STATE_COLUMNS = ("p_down", "p_range", "p_up", "map_state", "score")


def tanh(x: Column) -> Column:
    return F.tanh(x)


def softmax(score: Column, sharpness: float = 2.0, margin: float = 0.6) -> list[Column]:
    """p_down, p_range, p_up, map_state and score of a score in [-1, 1]; null counts as nought."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(score, F.lit(0.0))))
    down, level, up = F.exp(-sharpness * s), F.exp(F.lit(margin)), F.exp(sharpness * s)
    total = down + level + up
    first = F.when((down >= level) & (down >= up), "down").when(level >= up, "range").otherwise("up")
    return [(down / total).alias("p_down"), (level / total).alias("p_range"), (up / total).alias("p_up"), first.alias("map_state"), s.alias("score")]


def softmax_arrays(score: np.ndarray, sharpness: float = 2.0, margin: float = 0.6) -> dict[str, np.ndarray]:
    """The same on arrays, for estimators that run in Python."""
    s = np.clip(np.nan_to_num(score), -1, 1)
    raw = np.exp(np.stack([-sharpness * s, np.full(len(s), margin), sharpness * s]))
    p = raw / raw.sum(axis=0)
    return {"p_down": p[0], "p_range": p[1], "p_up": p[2], "map_state": np.array(STATES, dtype=object)[p.argmax(axis=0)], "score": s}


def ma_cross(features: DataFrame, fast: int = 50, slow: int = 200, z: int = 252) -> DataFrame:
    """tanh of the trailing z score of the spread between two moving averages."""
    spread = features.withColumn("__spread", F.try_divide(mean("close", fast), mean("close", slow)) - 1)
    return spread.withColumn("__z", zscore("__spread", z)).select("symbol", "date", *softmax(tanh(F.col("__z"))))


def return_sign(features: DataFrame, window: int = 60) -> DataFrame:
    """tanh of the t statistic of the mean return."""
    t = F.try_divide(mean("ret", window), F.nullif(deviation("ret", window), F.lit(0.0))) * F.sqrt(F.lit(float(window)))
    return features.withColumn("__t", t).select("symbol", "date", *softmax(tanh(F.col("__t"))))


def always_range(features: DataFrame) -> DataFrame:
    return features.select("symbol", "date", *softmax(F.lit(0.0)))


def ewm(features: DataFrame, column: str, span: int, out: str = "ewm") -> DataFrame:
    """Exponentially weighted mean, seeded with the first value: a recursion, so one Arrow batch a symbol."""
    alpha = 2.0 / (span + 1)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        frame[out] = frame["x"].ewm(alpha=alpha, adjust=False).mean()
        return frame[["symbol", "date", out]]

    return features.select("symbol", "date", F.col(column).alias("x")).groupBy("symbol").applyInPandas(run, f"symbol string, date date, {out} double")


def ewma_slope(features: DataFrame, span: int = 40, z: int = 252) -> DataFrame:
    """tanh of the trailing z score of the slope of the smoothed log close."""
    smooth = ewm(features.select("symbol", "date", F.ln("close").alias("lnc")), "lnc", span)
    slope = smooth.withColumn("__slope", F.col("ewm") - F.lag("ewm").over(along()))
    return slope.withColumn("__z", zscore("__slope", z)).select("symbol", "date", *softmax(tanh(F.col("__z"))))


RULES = {"ma_cross": ma_cross, "return_sign": return_sign, "ewma_slope": ewma_slope, "always_range": always_range}


def states(features: DataFrame, methods: list[str] | tuple[str, ...], params: dict[str, dict] | None = None) -> DataFrame:
    """Long table (symbol, date, method, state columns) of rule methods, some with parameters of their own."""
    out = None
    for m in methods:
        one = RULES[m](features, **(params or {}).get(m, {})).withColumn("method", F.lit(m)).select("symbol", "date", "method", *STATE_COLUMNS)
        out = one if out is None else out.unionByName(one)
    return out


def invalid(frame: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows that break the state contract: probabilities of a complete row add to one, and its label is known."""
    total = F.col("p_down") + F.col("p_range") + F.col("p_up")
    complete = total.isNotNull()
    return frame.where(complete & ((F.abs(total - 1) > tolerance) | ~F.coalesce(F.col("map_state"), F.lit("?")).isin(*STATES) | (F.abs("score") > 1 + tolerance)))
