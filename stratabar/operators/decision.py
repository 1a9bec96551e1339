"""Decision value: targets, calibration gain, significance, and risk control."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabar.functions.calendar import require_daily
from stratabar.functions.numerics import forward_probabilities, hac_t, two_sided_p
from stratabar.functions.windows import along, guarded, trail

TARGETS = ("direction", "loss", "volatility")
BASE = ("rv20", "rv60")
PROBS = ("p_down", "p_range", "p_up")
YEAR = 252.0


def targets(features: DataFrame, horizon: int = 5) -> DataFrame:
    """Direction, loss and volatility of the next ``horizon`` returns as 0 or 1.

    All are null where the forward return is. A comparison with a missing
    threshold counts as false, so its label is 0.
    """
    ahead = along().rowsBetween(1, horizon)
    features = require_daily(features, "targets")
    fwd = features.select(
        "symbol", "date", "rv20", guarded(F.sum("ret"), "ret", horizon, ahead).alias("fwd_ret"),
        (guarded(F.stddev_samp("ret"), "ret", horizon, ahead) * F.sqrt(F.lit(YEAR))).alias("fwd_vol"),
    )
    mid = fwd.withColumn("mid", guarded(F.percentile("fwd_vol", F.lit(0.5)), "fwd_vol", 60, trail(252)))
    known = F.col("fwd_ret").isNotNull()
    flag = lambda c: F.when(known, F.coalesce(c, F.lit(False)).cast("double"))
    return mid.select(
        "symbol", "date", flag(F.col("fwd_ret") > 0).alias("direction"),
        flag(F.col("fwd_ret") < -F.col("rv20") / math.sqrt(YEAR) * math.sqrt(horizon)).alias("loss"), flag(F.col("fwd_vol") > F.col("mid")).alias("volatility"),
    )


def instability(results: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """(symbol, method, date, flip_rate): trailing share of changes of state; a first row, or one after a gap, is a change."""
    keys = ("symbol", "method")
    before = F.lag("map_state").over(along(*keys))
    changed = F.when(F.col("map_state").isNull(), None).when(before.isNull() | (before != F.col("map_state")), 1.0).otherwise(0.0)
    return results.select(*keys, "date", changed.alias("c")).select(*keys, "date", guarded(F.avg("c"), "c", least, trail(window, *keys)).alias("flip_rate"))


def scored(results: DataFrame, features: DataFrame, horizon: int = 5, control: bool = False) -> DataFrame:
    """Rows with every input of the calibration: base features, probabilities, targets, and the flip rate under control."""
    rows = results.select("symbol", "method", "date", *PROBS).join(features.select("symbol", "date", *BASE), ["symbol", "date"]).join(targets(features, horizon), ["symbol", "date"])
    need = [*BASE, *PROBS, *TARGETS]
    if control:
        rows = rows.join(instability(results), ["symbol", "method", "date"])
        need.append("flip_rate")
    return rows.dropna(subset=need)


def common_window(rows: DataFrame) -> DataFrame:
    """Rows on the dates that all methods of their symbol have."""
    every = rows.groupBy("symbol").agg(F.count_distinct("method").alias("m"))
    dates = rows.groupBy("symbol", "date").agg(F.count_distinct("method").alias("k")).join(every, "symbol").where("k = m").select("symbol", "date")
    return rows.join(dates, ["symbol", "date"], "left_semi")


def diebold_mariano(losses: DataFrame, keys: list[str], lag: int) -> DataFrame:
    """Per key: n, mean difference and HAC t of ``loss_s - loss_b`` in order of date, by lags and sums."""
    w = Window.partitionBy(*keys)
    d = losses.select(*keys, "date", (F.col("loss_s") - F.col("loss_b")).alias("d")).withColumn("e", F.col("d") - F.avg("d").over(w))
    order = Window.partitionBy(*keys).orderBy("date")
    d = d.select(*keys, "d", "e", *(F.lag("e", k).over(order).alias(f"e{k}") for k in range(1, lag + 1)))
    v = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lag + 1):
        v = v + 2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0))
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), v.alias("v"))
    return out.select(*keys, "n", "mean_diff", (F.col("mean_diff") / F.sqrt(F.greatest(F.col("v") / F.col("n"), F.lit(1e-18)) / F.col("n"))).alias("t_stat"))


CALIBRATION = "symbol string, method string, target string, n long, base_rate double, brier_base double, brier_state double, brier_delta double, t_stat double, p_value double, logloss_base double, logloss_state double"


def compared(y: np.ndarray, base: np.ndarray, state: np.ndarray, lag: int, least: int = 100) -> dict | None:
    """Scores of two probability forecasts on the rows that both have; None if those are too few."""
    ok = np.isfinite(base) & np.isfinite(state)
    if ok.sum() < least:
        return None
    y, b, s = y[ok], np.clip(base[ok], 1e-6, 1 - 1e-6), np.clip(state[ok], 1e-6, 1 - 1e-6)
    lb, ls = (b - y) ** 2, (s - y) ** 2
    t = hac_t(ls - lb, lag)
    log = lambda p: float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    return {"n": int(ok.sum()), "base_rate": y.mean(), "brier_base": lb.mean(), "brier_state": ls.mean(), "brier_delta": ls.mean() - lb.mean(), "t_stat": t, "p_value": two_sided_p(t), "logloss_base": log(b), "logloss_state": log(s)}


def calibration_gain(rows: DataFrame, horizon: int = 5, splits: int = 5, control: bool = False) -> DataFrame:
    """What the state adds to a volatility baseline, by symbol, method and target; groups under 300 rows are left out."""
    extra = ["flip_rate"] if control else []

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        out = []
        if len(frame) >= 300:
            base = frame[[*BASE, *extra]].to_numpy(dtype=float)
            state = frame[[*BASE, *extra, *PROBS]].to_numpy(dtype=float)
            target = frame["target"].iloc[0]
            y = frame["y"].to_numpy(dtype=float)
            if len(np.unique(y)) > 1:
                got = compared(y, forward_probabilities(base, y, splits, horizon), forward_probabilities(state, y, splits, horizon), horizon)
                if got:
                    out.append({"symbol": frame["symbol"].iloc[0], "method": frame["method"].iloc[0], "target": target, **got})
        return pd.DataFrame(out, columns=[c.split()[0] for c in CALIBRATION.split(", ")])

    long = rows.select("symbol", "method", "date", *BASE, *extra, *PROBS, *TARGETS).unpivot(["symbol", "method", "date", *BASE, *extra, *PROBS], list(TARGETS), "target", "y")
    return long.repartition("symbol", "method", "target").groupBy("symbol", "method", "target").applyInPandas(run, CALIBRATION)


def deflated(grid: DataFrame, fdr: float = 0.10) -> DataFrame:
    """Benjamini-Hochberg adjusted p values and the bar that the number of comparisons sets.

    The grid is one row a comparison, a few hundred at most, so one ordered
    window over it is bounded.
    """
    everything = Window.partitionBy(F.lit(1))
    ranked = grid.withColumn("n_tests", F.count("*").over(everything)).withColumn("rank", F.row_number().over(everything.orderBy("p_value", "symbol", "method", "target")))
    adjusted = F.min(F.col("p_value") * F.col("n_tests") / F.col("rank")).over(everything.orderBy("rank").rowsBetween(0, Window.unboundedFollowing))
    out = ranked.withColumn("p_fdr", F.greatest(F.lit(0.0), F.least(F.lit(1.0), adjusted))).withColumn("t_threshold", F.sqrt(2 * F.ln(F.greatest(F.col("n_tests"), F.lit(2)).cast("double"))))
    return out.withColumn("survives_fdr", (F.col("p_fdr") < fdr) & (F.col("brier_delta") < 0)).withColumn("survives_deflated", F.col("t_stat") < -F.col("t_threshold")).drop("n_tests", "rank")


def winners(grid: DataFrame) -> DataFrame:
    return grid.where("survives_fdr or survives_deflated").orderBy("t_stat")


def harms(grid: DataFrame) -> DataFrame:
    return grid.where("t_stat > t_threshold").orderBy(F.desc("t_stat"))


def by_target(grid: DataFrame) -> DataFrame:
    """Mean Brier change, one column a target."""
    return grid.groupBy("method").pivot("target", list(TARGETS)).agg(F.avg("brier_delta"))


def performance(rows: DataFrame, keys: list[str], cost_bps: str = "cost_bps") -> DataFrame:
    """Sharpe, volatility, drawdown and turnover of exposure ``w`` on the next return ``r``, in order of date.

    Turnover counts the entry from nought; deviation is that of a population;
    the peak starts from the first equity value.
    """
    order = Window.partitionBy(*keys).orderBy("date")
    turn = F.abs(F.col("w") - F.lag("w", 1, 0.0).over(order))
    net = rows.select(*keys, "date", turn.alias("turn"), (F.col("w") * F.col("r") - turn * F.col(cost_bps) / 1e4).alias("net"))
    # a product, as a loss of everything or more has no logarithm
    grown = net.withColumn("equity", F.product(1 + F.col("net")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    drawn = grown.withColumn("dd", F.col("equity") / F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = drawn.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("net").alias("m"), F.stddev_pop("net").alias("sd"), F.min("dd").alias("max_drawdown"), (F.avg("turn") * YEAR).alias("turnover_pa"))
    vol = F.col("sd") * math.sqrt(YEAR)
    return out.select(*keys, "n", F.try_divide(F.col("m") * math.sqrt(YEAR), F.nullif("sd", F.lit(0.0))).alias("sharpe"), vol.alias("ann_vol"), "max_drawdown", F.try_divide("max_drawdown", F.nullif(vol, F.lit(0.0))).alias("dd_per_vol"), "turnover_pa")


def risk_control(results: DataFrame, features: DataFrame, target_vol: float = 0.10, most: float = 2.0, cost_bps: float = 2.0, least: int = 300, dates: DataFrame | None = None) -> DataFrame:
    """Buy and hold, volatility target, and that overlaid with 1 - p_down, on the next return; groups under ``least`` rows are left out.

    ``dates`` (symbol, date) restricts all methods to the same days.
    """
    daily = require_daily(features, "risk_control")
    rows = results.select("symbol", "method", "date", *PROBS).join(daily.select("symbol", "date", "ret", "rv20"), ["symbol", "date"]).dropna()
    if dates is not None:
        rows = rows.join(dates.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
    keys = ["symbol", "method"]
    order = Window.partitionBy(*keys).orderBy("date")
    base = F.least(F.lit(most), F.greatest(F.lit(0.0), target_vol / F.greatest("rv20", F.lit(1e-6))))
    sized = rows.withColumn("size", F.count("*").over(Window.partitionBy(*keys))).where(F.col("size") >= least)
    ready = sized.withColumn("r", F.lead("ret").over(order)).where("r is not null").withColumn("base", base)
    legs = F.array(
        F.struct(F.lit("buy_and_hold").alias("strategy"), F.lit(1.0).alias("w"), F.lit(0.0).alias("cost_bps")),
        F.struct(F.lit("vol_target").alias("strategy"), F.col("base").alias("w"), F.lit(cost_bps).alias("cost_bps")),
        F.struct(F.lit("vol_target_x_state").alias("strategy"), (F.col("base") * (1 - F.col("p_down"))).alias("w"), F.lit(cost_bps).alias("cost_bps")),
    )
    long = ready.select(*keys, "date", "r", F.explode(legs).alias("leg")).select(*keys, "leg.strategy", "date", "r", "leg.w", "leg.cost_bps")
    return performance(long, [*keys, "strategy"])


def decision_value(results: DataFrame, features: DataFrame, horizon: int = 5, control: bool = False, common: bool = False) -> tuple[DataFrame, DataFrame]:
    """(calibration grid, risk table with the overlay's change against the volatility target)."""
    rows = scored(results, features, horizon, control)
    rows = common_window(rows) if common else rows
    risk = risk_control(results, features, dates=rows if common else None)
    base = risk.where("strategy = 'vol_target'").select("symbol", "method", F.col("sharpe").alias("s0"), F.col("max_drawdown").alias("d0"))
    risk = risk.join(base, ["symbol", "method"]).withColumn("sharpe_delta", F.col("sharpe") - F.col("s0")).withColumn("drawdown_delta", F.col("max_drawdown") - F.col("d0")).drop("s0", "d0")
    return calibration_gain(rows, horizon, control=control), risk
