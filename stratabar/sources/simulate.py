"""Simulated markets with a known hidden regime."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Yearly drift and volatility of the down, range and up regimes.
REGIMES = ((-0.25, 0.28), (0.02, 0.12), (0.18, 0.14))
SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, true_state int"


def market(n: int = 2500, seed: int = 0, persistence: float = 0.985, start: str = "2010-01-04") -> pd.DataFrame:
    """Bars on business days with ``true_state`` 0, 1 or 2, from range."""
    rng = np.random.default_rng(seed)
    stay = rng.random(n) < persistence
    jump = rng.integers(1, 3, size=n)  # to one of the two others, alike
    moves = np.where(stay, 0, jump)
    moves[0] = 0
    state = (1 + np.cumsum(moves)) % 3
    drift = np.array([r[0] for r in REGIMES])[state] / 252
    sd = np.array([r[1] for r in REGIMES])[state] / np.sqrt(252)
    close = 100 * np.exp(np.cumsum(rng.normal(drift, sd)))
    opened = np.append(close[:1], close[:-1]) * (1 + rng.normal(0, 0.3 * sd))
    top, bottom = np.maximum(opened, close), np.minimum(opened, close)
    spread = sd.std() or 1.0
    return pd.DataFrame({
        "date": pd.bdate_range(start, periods=n).date, "open": opened, "high": top * (1 + np.abs(rng.normal(0, 0.6 * sd))), "low": bottom * (1 - np.abs(rng.normal(0, 0.6 * sd))),
        "close": close, "volume": rng.lognormal(16 + 4 * (sd - sd.mean()) / spread, 0.25), "true_state": state.astype("int32"),
    })


def markets(spark: SparkSession, seeds: int = 8, n: int = 2500, persistence: float = 0.985) -> DataFrame:
    """One market a seed, under the symbol sim<seed>; made where the seed's task runs."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        seed = int(frame["seed"].iloc[0])
        out = market(n, seed, persistence)
        out.insert(0, "symbol", f"sim{seed}")
        return out

    return spark.range(seeds).withColumnRenamed("id", "seed").repartition(seeds, "seed").groupBy("seed").applyInPandas(one, SCHEMA)
