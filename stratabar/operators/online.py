"""Recursive filters: local linear trend, CUSUM, Bayesian change points.

Each keeps constant-size state, so the same step functions serve batch groups
and streams.
"""

from __future__ import annotations

import math

import numpy as np

from stratabar.functions.numerics import simplex_search
from stratabar.operators.rules import STATES, softmax_arrays

WARM = 20


def trend_step(state: tuple, y: float, q_level: float, q_slope: float, r: float) -> tuple[tuple, float, float]:
    """One step of the local linear trend filter: (state, innovation, its variance). State: level, slope, P11, P12, P22."""
    level, slope, a, b, c = state
    level += slope
    a, b, c = a + 2 * b + c + q_level, b + c, c + q_slope
    v, s = y - level, a + r
    k1, k2 = a / s, b / s
    return (level + k1 * v, slope + k2 * v, a - k1 * a, b - k1 * b, c - k2 * b), v, s


def trend_start(y: float) -> tuple:
    return (y, 0.0, 1e6, 0.0, 1e2)


def trend_filter(y: np.ndarray, q_level: float, q_slope: float, r: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(slope, its deviation, log likelihood after the first rows)."""
    slopes, sds, like = np.empty(len(y)), np.empty(len(y)), 0.0
    state = trend_start(float(y[0])) if len(y) else None
    for t, value in enumerate(y.tolist()):
        state, v, s = trend_step(state, value, q_level, q_slope, r)
        if s <= 1e-12:
            return slopes, sds, -math.inf
        if t >= WARM:
            like -= 0.5 * (math.log(2 * math.pi * s) + v * v / s)
        slopes[t], sds[t] = state[1], math.sqrt(max(state[4], 1e-12))
    return slopes, sds, like


class KalmanTrend:
    """Slope of the local linear trend over its deviation, through tanh.

    ``slope_var`` is None (a prior from the drift that a half-life of 42 days
    would allow), a number, or "mle" to estimate it too.
    """

    full_replay = True
    BOUNDS = (math.log(1e-10), math.log(1e-1))

    def __init__(self, slope_var: float | str | None = None, sharpness: float = 0.5, steps: int = 60, half_life: int = 42, drift: float = 0.1):
        self.slope_var, self.sharpness, self.steps, self.half_life, self.drift = slope_var, sharpness, steps, half_life, drift
        self.q_level, self.q_slope, self.r = 1e-5, 1e-8, 1e-4  # fixed values before any fit

    def fit(self, y: np.ndarray) -> KalmanTrend:
        y = y[np.isfinite(y)]
        if len(y) < 100:
            return self
        free = self.slope_var == "mle"
        if self.slope_var is None:
            self.q_slope = max((self.drift * np.diff(y).std()) ** 2 / self.half_life, 1e-14)
        elif not free:
            self.q_slope = float(self.slope_var)

        def cost(p):
            q = [math.exp(x) for x in p]
            like = trend_filter(y, q[0], q[2] if free else self.q_slope, q[1])[2]
            return -like if math.isfinite(like) else 1e12

        start = np.log([self.q_level, self.r, *([self.q_slope] if free else [])])
        best = np.exp(simplex_search(cost, start, self.BOUNDS, steps=self.steps))
        self.q_level, self.r = float(best[0]), float(best[1])
        self.q_slope = float(best[2]) if free else self.q_slope
        return self

    def states(self, y: np.ndarray) -> dict[str, np.ndarray]:
        slope, sd, _ = trend_filter(y, self.q_level, self.q_slope, self.r)
        out = softmax_arrays(np.tanh(self.sharpness * slope / sd))
        return {k: np.where(np.arange(len(y)) < WARM, None if k == "map_state" else np.nan, v) for k, v in out.items()}


def standardised(ret: np.ndarray, rv20: np.ndarray) -> np.ndarray:
    """Return over daily volatility; nan where either is missing or volatility is nought."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = ret / (np.where(rv20 == 0, np.nan, rv20) / math.sqrt(252))
    return np.where(np.isfinite(z), z, np.nan)


def cusum_step(state: tuple[float, float, int], z: float, k: float, h: float) -> tuple[tuple[float, float, int], float]:
    """One step: ((up sum, down sum, declared), evidence). Declared is 0 down, 1 range, 2 up."""
    up, down, declared = state
    up, down = max(0.0, up + z - k), max(0.0, down - z - k)
    if up > h:
        up = down = 0.0
        declared = 2
    elif down > h:
        up = down = 0.0
        declared = 0
    lean = up if declared == 2 else down if declared == 0 else max(up, down)
    return (up, down, declared), min(1.0, lean / h)


def cusum_run(z: np.ndarray, k: float, h: float) -> tuple[np.ndarray, np.ndarray]:
    """(declared, evidence) of complete values."""
    state, declared, evidence = (0.0, 0.0, 1), np.empty(len(z), dtype=np.int64), np.empty(len(z))
    for t, value in enumerate(z.tolist()):
        state, evidence[t] = cusum_step(state, value, k, h)
        declared[t] = state[2]
    return declared, evidence


class Cusum:
    """Two-sided CUSUM of standardised returns; h is set so that alarms come about once in ``target`` days."""

    full_replay = False

    def __init__(self, k: float = 0.5, h: float = 5.0, shift: int = 60, target: int = 252):
        self.k, self.h, self.shift, self.target = k, h, shift, target

    def fit(self, z: np.ndarray) -> Cusum:
        z = z[np.isfinite(z)]
        if len(z) < 250:
            return self
        sums = np.cumsum(np.append(0.0, z))
        means = (sums[self.shift :] - sums[: -self.shift]) / self.shift
        self.k = max(float(means.std(ddof=1)), 1e-3)
        aim, low, high = max(1.0, len(z) / self.target), 0.25, 25.0
        for _ in range(40):
            self.h = (low + high) / 2
            declared, _ = cusum_run(z, self.k, self.h)
            changes = int((np.diff(declared) != 0).sum())
            low, high = (self.h, high) if changes > aim else (low, self.h)
        return self

    def states(self, z: np.ndarray) -> dict[str, np.ndarray]:
        p = np.full((len(z), 3), np.nan)
        ok = np.flatnonzero(np.isfinite(z))
        if len(ok) < 5:
            ok = ok[:0]  # too few to say anything
        declared, evidence = cusum_run(z[ok], self.k, self.h)
        sure = 0.50 + 0.35 * evidence
        p[ok] = ((1 - sure) / 2)[:, None]
        p[ok, declared] = sure
        named = np.full(len(z), None, dtype=object)
        named[ok] = np.array(STATES, dtype=object)[declared]
        return {"p_down": p[:, 0], "p_range": p[:, 1], "p_up": p[:, 2], "map_state": named, "score": p[:, 2] - p[:, 0]}


class ChangePoints:
    """Bayesian online change points with a normal-inverse-gamma prior.

    The prior's variance is that of the first 250 valid returns, so earlier
    rows see a little ahead; ``causal_prior`` uses the first 30 instead, which
    the filter waits for anyway.
    """

    full_replay = False

    def __init__(self, expected_run: int = 120, longest: int = 300, sharpness: float = 0.7, causal_prior: bool = False):
        self.hazard, self.longest, self.sharpness, self.causal_prior = 1.0 / expected_run, longest, sharpness, causal_prior
        a = 1.0 + 0.5 * np.arange(longest + 2)
        self.front = np.array([math.lgamma(x + 0.5) - math.lgamma(x) for x in a])

    def fit(self, y: np.ndarray) -> ChangePoints:
        return self

    def run(self, y: np.ndarray, v0: float) -> np.ndarray:
        """Score before tanh of each complete return: mean over its error at the likeliest run length."""
        mu, kappa, alpha, beta, weight = (np.array([x]) for x in (0.0, 1.0, 1.0, v0, 1.0))
        out = np.empty(len(y))
        for t, value in enumerate(y.tolist()):
            n = len(mu)
            scale = beta * (kappa + 1) / (alpha * kappa)
            gap = (value - mu) ** 2 / scale
            dens = np.exp(self.front[:n] - 0.5 * np.log(2 * alpha * math.pi * scale) - (alpha + 0.5) * np.log1p(gap / (2 * alpha)))
            mass = weight * np.maximum(dens, 1e-12)
            weight = np.append(mass.sum() * self.hazard, mass * (1 - self.hazard))
            beta = np.append(v0, beta + kappa * (value - mu) ** 2 / (2 * (kappa + 1)))
            mu = np.append(0.0, (kappa * mu + value) / (kappa + 1))
            kappa, alpha = np.append(1.0, kappa + 1), np.append(1.0, alpha + 0.5)
            mu, kappa, alpha, beta, weight = (x[: self.longest] for x in (mu, kappa, alpha, beta, weight))
            weight = weight / weight.sum()
            j = int(weight.argmax())
            out[t] = mu[j] / math.sqrt(max(beta[j] / (alpha[j] * kappa[j]), 1e-12))
        return out

    def states(self, y: np.ndarray) -> dict[str, np.ndarray]:
        ok = np.flatnonzero(np.isfinite(y))
        empty = {k: np.full(len(y), None if k == "map_state" else np.nan, dtype=object if k == "map_state" else float) for k in ("p_down", "p_range", "p_up", "map_state", "score")}
        if len(ok) < 30:
            return empty
        v0 = max(float(y[ok][: 30 if self.causal_prior else 250].var()), 1e-10)
        got = softmax_arrays(np.tanh(self.sharpness * self.run(y[ok], v0)))
        for k, v in got.items():
            empty[k][ok] = v
        return empty
