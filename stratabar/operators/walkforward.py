"""Estimators by name, and the purged walk-forward sweep.

One group a (symbol, method): refits warm-start from the last, so blocks of a
group run in order and groups run in parallel. The features are repartitioned
on both keys, as their own partitioning on symbol alone would cap parallelism
at the number of symbols.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.operators import chains, online, rules
from stratabar.sources.config import Engine

STATE_SCHEMA = "p_down double, p_range double, p_up double, map_state string, score double"


class Estimator:
    """What a method needs: columns in, ``fit`` on past rows, states of all rows from each row's past."""

    full_replay = False
    fits = True

    def __init__(self, inner, column: Callable[[pd.DataFrame], np.ndarray]):
        self.inner, self.column = inner, column
        self.full_replay = getattr(inner, "full_replay", False)

    def fit(self, frame: pd.DataFrame) -> Estimator:
        x = self.column(frame)
        self.inner.fit(x)
        return self

    def states(self, frame: pd.DataFrame) -> pd.DataFrame:
        x = self.column(frame)
        out = self.inner.states(x) if hasattr(self.inner, "states") else chains.as_states(self.inner.filtered(x))
        return pd.DataFrame({c: out[c] for c in rules.STATE_COLUMNS}, index=frame.index)


class RuleEstimator(Estimator):
    """A rule method on one symbol's rows, for custom sweeps; tables of many symbols use the window expressions."""

    fits = False

    def __init__(self, name: str, **params):
        self.name, self.params = name, params

    def fit(self, frame):
        return self

    def states(self, frame):
        close, ret = frame["close"].astype(float), frame["ret"].astype(float)
        z = lambda s, n=252: (s - s.rolling(n, min_periods=60).mean()) / s.rolling(n, min_periods=60).std().where(lambda v: v > 0)
        p = self.params
        if self.name == "ma_cross":
            score = np.tanh(z(close.rolling(p.get("fast", 50)).mean() / close.rolling(p.get("slow", 200)).mean() - 1, p.get("z", 252)))
        elif self.name == "return_sign":
            n = p.get("window", 60)
            sd = ret.rolling(n).std()
            score = np.tanh(ret.rolling(n).mean() / sd.where(sd > 0) * np.sqrt(n))
        elif self.name == "ewma_slope":
            score = np.tanh(z(np.log(close).ewm(span=p.get("span", 40), adjust=False).mean().diff(), p.get("z", 252)))
        else:
            score = pd.Series(0.0, index=frame.index)
        out = rules.softmax_arrays(score.to_numpy(dtype=float))
        return pd.DataFrame({c: out[c] for c in rules.STATE_COLUMNS}, index=frame.index)


def _ret(frame):
    return frame["ret"].to_numpy(dtype=float)


REGISTRY: dict[str, Callable[..., Estimator]] = {}


def register(name: str, make: Callable[..., Estimator]) -> None:
    """Add a method; a name is taken once."""
    if name in REGISTRY:
        raise KeyError(f"{name} is registered already")
    REGISTRY[name] = make


def estimator(name: str, **params) -> Estimator:
    if name not in REGISTRY:
        raise KeyError(f"no method {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**params)


def methods() -> list[str]:
    return sorted(REGISTRY)


for _name in rules.RULES:
    register(_name, lambda _n=_name, **p: RuleEstimator(_n, **p))
register("kalman_trend", lambda **p: Estimator(online.KalmanTrend(**p), lambda f: np.log(f["close"].to_numpy(dtype=float))))
register("hmm_gaussian", lambda **p: Estimator(_Column(chains.HmmGaussian(**p)), _ret))
register("ms_regression", lambda **p: Estimator(chains.SwitchingAR(**p), _ret))
register("cusum", lambda **p: Estimator(online.Cusum(**p), lambda f: online.standardised(_ret(f), f["rv20"].to_numpy(dtype=float))))
register("bocpd", lambda **p: Estimator(online.ChangePoints(**p), _ret))


class _Column:
    """A chain over one column."""

    def __init__(self, chain):
        self.chain = chain

    def fit(self, x):
        self.chain.fit(x[:, None])

    def filtered(self, x):
        return self.chain.filtered(x[:, None])


def folds(n: int, engine: Engine) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, first training row, training end, first replayed row) of every block; no warm-up means a replay from the first row."""
    return [(s, min(s + engine.refit_every, n), max(0, s - engine.embargo - engine.max_train), s - engine.embargo, max(0, s - engine.warmup) if engine.warmup else 0) for s in range(engine.min_train, n, engine.refit_every)]


def fold_table(bars: DataFrame, engine: Engine | None = None) -> DataFrame:
    """The same as a DataFrame, one row a symbol and block."""
    e = engine or Engine()
    n = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") > e.min_train)
    out = n.withColumn("start", F.explode(F.sequence(F.lit(e.min_train).cast("long"), F.col("n") - 1, F.lit(e.refit_every).cast("long"))))
    end = F.col("start") - e.embargo
    return out.select("symbol", "start", F.least(F.col("start") + e.refit_every, "n").alias("stop"), F.greatest(F.lit(0).cast("long"), end - e.max_train).alias("train_from"), end.alias("train_end"), F.greatest(F.lit(0).cast("long"), F.col("start") - (e.warmup or (1 << 62))).alias("replay_from"))


def run_one(frame: pd.DataFrame, est: Estimator, engine: Engine) -> pd.DataFrame:
    """States of one symbol's rows, in order of date; rows before the first block stay empty unless the method does not fit."""
    if not est.fits:
        return est.states(frame)
    n = len(frame)
    if n <= engine.min_train + engine.embargo:
        raise ValueError(f"{n} rows; more than {engine.min_train + engine.embargo} are needed")
    out = pd.DataFrame({c: np.full(n, None if c == "map_state" else np.nan, dtype=object if c == "map_state" else float) for c in rules.STATE_COLUMNS})
    for start, stop, low, end, replay in folds(n, engine):
        est.fit(frame.iloc[low:end])
        begin = 0 if est.full_replay else replay
        got = est.states(frame.iloc[begin:stop]).iloc[start - begin :]
        for c in rules.STATE_COLUMNS:
            out[c].to_numpy()[start:stop] = got[c].to_numpy()
    return out


def sweep(spark: SparkSession, features: DataFrame, methods_: list, engine: Engine | None = None) -> DataFrame:
    """(symbol, date, method, states, error): every symbol with every method; a pair that fails gives one row with its error.

    ``methods_`` holds names or (name, parameters). Rule methods are window
    expressions, whatever their parameters.
    """
    e = engine or Engine()
    named = {(m if isinstance(m, str) else m[0]): ({} if isinstance(m, str) else dict(m[1])) for m in methods_}
    native = [m for m in named if m in rules.RULES]
    rest = {m: p for m, p in named.items() if m not in native}
    out = rules.states(features, native, named).withColumn("error", F.lit(None).cast("string")) if native else None
    if rest:
        for m in rest:
            estimator(m, **rest[m])  # an unknown name fails here, not in a task

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("date").reset_index(drop=True)
            symbol, method = frame["symbol"].iloc[0], frame["method"].iloc[0]
            try:
                got = run_one(frame, estimator(method, **rest[method]), e)
                got = got.astype(object).where(got.notna(), None)
                got.insert(0, "date", frame["date"])
                got["error"] = None
            except Exception as problem:  # noqa: BLE001  reported in the row
                got = pd.DataFrame({"date": [None], **{c: [None] for c in rules.STATE_COLUMNS}, "error": [f"{type(problem).__name__}: {problem}"]})
            got.insert(0, "method", method)
            got.insert(0, "symbol", symbol)
            return got[["symbol", "date", "method", *rules.STATE_COLUMNS, "error"]]

        wanted = features.select("symbol", "date", "ret", "rv20", "close").withColumn("method", F.explode(F.array(*(F.lit(m) for m in rest))))
        # fits are long, so groups are not put together as small tables are
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(rest) * 8)
        fitted = wanted.repartition(parts, "symbol", "method").groupBy("symbol", "method").applyInPandas(run, f"symbol string, date date, method string, {STATE_SCHEMA}, error string")
        out = fitted if out is None else out.unionByName(fitted)
    return out


def results(swept: DataFrame) -> DataFrame:
    """A sweep's rows without those of failed pairs."""
    return swept.where("error is null").drop("error")
