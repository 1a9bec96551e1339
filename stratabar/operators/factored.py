"""Two small hidden chains, of trend and of volatility, against one large one on both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabar.functions.numerics import forward_probabilities, hac_t
from stratabar.operators.chains import GaussianChain
from stratabar.operators.decision import BASE, TARGETS, targets


def observations(features: DataFrame) -> DataFrame:
    """(symbol, date, trend, vol): the return, and the logarithm of volatility floored at 1e-8."""
    return features.select("symbol", "date", F.col("ret").alias("trend"), F.ln(F.greatest("rv20", F.lit(1e-8))).alias("vol"), *BASE)


def posteriors(x: np.ndarray, mode: str, k: int, warm: int = 750, every: int = 63, longest: int = 1250, seed: int = 0) -> np.ndarray:
    """Filtered posteriors by walk-forward refits: k + k columns factored, else k * k. Rows before the first fit are nan."""
    models = [(GaussianChain(k, seed), [0]), (GaussianChain(k, seed), [1])] if mode == "factored" else [(GaussianChain(k * k, seed), [0, 1])]
    out = np.full((len(x), sum(m.k for m, _ in models)), np.nan)
    for start in range(warm, len(x), every):
        low, stop = max(0, start - longest), min(start + every, len(x))
        out[start:stop] = np.hstack([m.fit(x[low:start][:, cols]).filtered(x[low:stop][:, cols])[start - low :] for m, cols in models])
    return out


def joint_labels(p: np.ndarray, mode: str, k: int) -> np.ndarray:
    """One of k * k cells a row, nan where a posterior is missing."""
    ok = np.isfinite(p).all(axis=1)
    q = np.where(ok[:, None], p, 0)
    cells = q[:, :k].argmax(axis=1) * k + q[:, k:].argmax(axis=1) if mode == "factored" else q.argmax(axis=1)
    return np.where(ok, cells, np.nan)


def parameters(k: int) -> dict[str, int]:
    big = k * k
    return {"factored": 2 * (k * (k - 1) + 2 * k), "flat": big * (big - 1) + 4 * big}


def stability(labels: DataFrame) -> DataFrame:
    """Per symbol and model: mean duration, flip rate and cells used, over complete rows; nulls under ten."""
    order = Window.partitionBy("symbol", "model").orderBy("date")
    rows = labels.where("cell is not null").withColumn("flip", (F.col("cell") != F.lag("cell").over(order)).cast("int"))
    out = rows.groupBy("symbol", "model").agg(F.count("*").alias("n"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"), F.count_distinct("cell").alias("cells"))
    enough = F.col("n") >= 10
    return out.select("symbol", "model", F.when(enough, F.col("n") / F.greatest("flips", F.lit(1))).alias("mean_duration"), F.when(enough, F.col("flips") / (F.col("n") - 1)).alias("flip_rate"), F.when(enough, F.col("cells")).otherwise(0).alias("n_cells_used"))


WALKED = "symbol string, date date, mode string, cell int, p array<double>"


def walked(features: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """(symbol, date, mode, cell, p) of both models; one group a symbol and mode."""
    rows = observations(features).withColumn("mode", F.explode(F.array(F.lit("factored"), F.lit("flat"))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        mode = frame["mode"].iloc[0]
        p = posteriors(frame[["trend", "vol"]].to_numpy(dtype=float), mode, k, seed=seed)
        cell = joint_labels(p, mode, k)
        return pd.DataFrame({"symbol": frame["symbol"], "date": frame["date"], "mode": mode, "cell": [None if c != c else int(c) for c in cell], "p": [None if c != c else row.tolist() for c, row in zip(cell, p, strict=True)]})

    return rows.select("symbol", "date", "mode", "trend", "vol").repartition("symbol", "mode").groupBy("symbol", "mode").applyInPandas(run, WALKED)


VALUE = "symbol string, target string, model string, n long, brier double, brier_base double, delta_vs_base double, t_vs_base double, t_factored_vs_flat double"


def compare(features: DataFrame, k: int = 3, horizon: int = 5, splits: int = 5, seed: int = 0, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(decision value, stability): volatility alone, with factored and with flat posteriors, on the same rows."""
    states = walked(features, k, seed) if states is None else states
    sizes = parameters(k)
    stab = stability(states.withColumnRenamed("mode", "model")).withColumn("n_params", F.when(F.col("model") == "factored", sizes["factored"]).otherwise(sizes["flat"]))
    wide = states.where("p is not null").groupBy("symbol", "date").agg(F.max(F.when(F.col("mode") == "factored", F.col("p"))).alias("fac"), F.max(F.when(F.col("mode") == "flat", F.col("p"))).alias("flat"))
    rows = wide.join(features.select("symbol", "date", *BASE), ["symbol", "date"]).join(targets(features, horizon), ["symbol", "date"]).dropna()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        out = []
        if len(frame) >= 300:
            base = frame[list(BASE)].to_numpy(dtype=float)
            sets = {"base": base, "factored": np.hstack([base, np.array(frame["fac"].tolist())]), "flat": np.hstack([base, np.array(frame["flat"].tolist())])}
            for target in TARGETS:
                y = frame[target].to_numpy(dtype=float)
                if len(np.unique(y)) < 2:
                    continue
                p = {name: forward_probabilities(x, y, splits, horizon) for name, x in sets.items()}
                ok = np.all([np.isfinite(v) for v in p.values()], axis=0)
                if ok.sum() < 100:
                    continue
                loss = {name: (np.clip(v[ok], 1e-6, 1 - 1e-6) - y[ok]) ** 2 for name, v in p.items()}
                versus = hac_t(loss["factored"] - loss["flat"], horizon)
                for model in ("factored", "flat"):
                    out.append((frame["symbol"].iloc[0], target, model, int(ok.sum()), loss[model].mean(), loss["base"].mean(), loss[model].mean() - loss["base"].mean(), hac_t(loss[model] - loss["base"], horizon), versus))
        return pd.DataFrame(out, columns=[c.split()[0] for c in VALUE.split(", ")])

    return rows.repartition("symbol").groupBy("symbol").applyInPandas(run, VALUE), stab
