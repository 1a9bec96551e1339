"""Hidden Markov estimators in numpy: Gaussian states, and switching autoregression.

They run inside grouped Arrow functions, one group a symbol and method. All
starts of a fit are trained together as one batch of chains.
"""

from __future__ import annotations

import math

import numpy as np

from stratabar.functions.numerics import chain_passes
from stratabar.operators.rules import STATES


def log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(..., n, K) log densities of rows x (n, d) under diagonal normals (..., K, d)."""
    gap = x[:, None] - mean[..., None, :, :]
    v = var[..., None, :, :]
    return -0.5 * (np.log(2 * math.pi * v) + gap * gap / v).sum(axis=-1)


def scaled(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logs.max(axis=-1, keepdims=True)
    return np.exp(logs - top), top[..., 0].sum(axis=-1)


def long_run(move: np.ndarray) -> np.ndarray:
    """Stationary shares of transition matrices, by solving for the unit left vector."""
    k = move.shape[-1]
    a = np.swapaxes(move, -1, -2) - np.eye(k)
    a[..., -1, :] = 1.0
    b = np.zeros((*move.shape[:-1], 1))
    b[..., -1, 0] = 1.0
    try:
        return np.abs(np.linalg.solve(a, b)[..., 0])
    except np.linalg.LinAlgError:
        return np.full(move.shape[:-1], 1.0 / k)


def train_chains(x: np.ndarray, mean, var, move, start, rounds: int, tol: float, floor: float):
    """Baum-Welch on a batch of starts; each stops by its own gain. Returns parameters and log likelihoods."""
    before = np.full(len(mean), -np.inf)
    live = np.ones(len(mean), dtype=bool)
    value = before.copy()
    for _ in range(rounds):
        at = np.flatnonzero(live)
        if not len(at):
            break
        emit, base = scaled(log_density(x, mean[at], var[at]))
        alpha, beta, ll = chain_passes(emit, move[at], start[at])
        ll = ll + base
        value[at] = ll
        good = np.isfinite(ll)
        post = alpha * beta
        post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-300)
        ahead = emit[:, 1:] * beta[:, 1:]
        norm = np.maximum(((alpha[:, :-1] @ move[at]) * ahead).sum(axis=2, keepdims=True), 1e-300)
        pairs = move[at] * (np.swapaxes(alpha[:, :-1] / norm, 1, 2) @ ahead)
        weight = np.maximum(post.sum(axis=1), 1e-300)
        centre = np.swapaxes(post, 1, 2) @ x / weight[:, :, None]
        square = np.swapaxes(post, 1, 2) @ (x * x) / weight[:, :, None]
        ok = at[good]
        move[ok] = (pairs / np.maximum(pairs.sum(axis=2, keepdims=True), 1e-300))[good]
        mean[ok], var[ok] = centre[good], np.maximum(square - centre * centre, floor)[good]
        start[ok] = post[good, 0]
        done = ~good | (np.abs(ll - before[at]) < tol * np.maximum(1.0, np.abs(before[at])))
        before[at] = ll
        live[at[done]] = False
    return mean, var, move, start, value


class GaussianChain:
    """K states of diagonal normals, fitted from several starts; refits begin from the last solution."""

    def __init__(self, k: int, seed: int = 0, starts: int = 5, rounds: int = 120, tol: float = 1e-6, least_share: float = 0.02, floor: float = 1e-10, least_rows: int | None = None):
        self.k, self.seed, self.starts, self.rounds, self.tol = k, seed, starts, rounds, tol
        self.least_share, self.floor = least_share, floor
        self.least_rows = 50 * k if least_rows is None else least_rows
        self.fitted = False
        self.mean = self.var = self.move = self.start = None

    def plain(self, x: np.ndarray) -> None:
        """Parameters before any fit: means spread over the range seen."""
        d = x.shape[1] if x.size else 1
        self.mean = np.linspace(x.min(axis=0), x.max(axis=0), self.k) if x.size else np.zeros((self.k, d))
        self.var = np.tile(np.maximum(x.var(axis=0), self.floor), (self.k, 1)) if x.size else np.ones((self.k, d))
        self.move = sticky(self.k, 0.98)
        self.start = np.full(self.k, 1.0 / self.k)

    def begin(self, x: np.ndarray, rng: np.random.Generator, attempts: range):
        """Starting means, variances and moves of the numbered attempts."""
        middle = np.quantile(x, np.linspace(0.1, 0.9, self.k), axis=0)
        means, variances, moves = [], [], []
        for a in attempts:
            spread = np.tile(np.maximum(x.var(axis=0), self.floor), (self.k, 1))
            means.append(middle + (rng.normal(0, 0.5 * x.std(axis=0), middle.shape) if a else 0))
            variances.append(spread * (rng.uniform(0.4, 1.6, spread.shape) if a else 1))
            moves.append(sticky(self.k, 0.95))
        return means, variances, moves

    def fit(self, x: np.ndarray) -> GaussianChain:
        x = np.asarray(x, dtype=float)
        x = x[np.isfinite(x).all(axis=1)]
        if len(x) < self.least_rows:
            if self.mean is None:
                self.plain(x)
            return self
        rng = np.random.default_rng(self.seed)
        means, variances, moves = self.begin(x, rng, range(1, 2) if self.fitted else range(self.starts))
        starts = [np.full(self.k, 1.0 / self.k) for _ in means]
        if self.fitted:
            means, variances, moves, starts = [self.mean, *means], [self.var, *variances], [self.move, *moves], [self.start, *starts]
        mean, var, move, start, value = train_chains(x, *(np.array(v, dtype=float) for v in (means, variances, moves, starts)), self.rounds, self.tol, self.floor)
        if not np.isfinite(value).any():
            if self.mean is None:
                self.plain(x)
            return self
        value = np.where(np.isfinite(value), value, -np.inf)
        full = long_run(move.copy()).min(axis=1) >= self.least_share
        best = int(np.argmax(np.where(full, value, -np.inf))) if (full & (value > -np.inf)).any() else int(np.argmax(value))
        order = np.argsort(mean[best][:, 0], kind="stable")
        self.mean, self.var = mean[best][order], var[best][order]
        self.move, self.start = move[best][np.ix_(order, order)], start[best][order]
        self.fitted = True
        return self

    def filtered(self, x: np.ndarray) -> np.ndarray:
        """Posteriors of each row given it and the rows before; incomplete rows are skipped and stay nan."""
        x = np.asarray(x, dtype=float)
        if self.mean is None:
            self.plain(x[np.isfinite(x).all(axis=1)])
        out = np.full((len(x), self.k), np.nan)
        ok = np.isfinite(x).all(axis=1)
        if ok.any():
            emit, _ = scaled(log_density(x[ok], self.mean[None], self.var[None]))
            out[ok] = chain_passes(emit, self.move[None], self.start[None], backward=False)[0][0]
        return out

    @property
    def parameters(self) -> int:
        d = 1 if self.mean is None else self.mean.shape[1]
        return self.k * (self.k - 1) + 2 * self.k * d


def sticky(k: int, stay: float) -> np.ndarray:
    move = np.full((k, k), (1 - stay) / max(k - 1, 1)) + stay * np.eye(k)
    return move / move.sum(axis=1, keepdims=True)


def as_states(p: np.ndarray) -> dict[str, np.ndarray]:
    """State columns from posteriors of down, range and up; rows without stay empty."""
    ok = np.isfinite(p).all(axis=1)
    top = np.full(len(p), None, dtype=object)
    top[ok] = np.array(STATES, dtype=object)[p[ok].argmax(axis=1)]
    return {"p_down": p[:, 0], "p_range": p[:, 1], "p_up": p[:, 2], "map_state": top, "score": np.where(ok, p[:, 2] - p[:, 0], np.nan)}


class HmmGaussian(GaussianChain):
    """Three Gaussian states of returns, ordered by mean."""

    def __init__(self, seed: int = 0, starts: int = 6):
        super().__init__(3, seed, starts, least_share=0.08, floor=1e-12, least_rows=200)
        # Fixed values before any fit.
        self.mean, self.var = np.array([[-1e-3], [0.0], [1e-3]]), np.array([[4e-4], [6.4e-5], [1e-4]])
        self.move, self.start = 0.01 + 0.97 * np.eye(3), np.full(3, 1 / 3)

    def begin(self, x, rng, attempts):
        means, variances, moves = [], [], []
        for a in attempts:
            q = np.sort(rng.uniform(0.05, 0.95, 3)) if a else np.array([0.15, 0.5, 0.85])
            tilt = np.exp(rng.normal(0, 0.7, (3, 1))) if a else np.array([[2.0], [0.5], [1.0]])
            stay = rng.uniform(0.90, 0.985, 3) if a else np.full(3, 0.97)
            means.append(np.quantile(x, q, axis=0))
            variances.append(np.maximum(x.var(axis=0) * tilt, self.floor))
            moves.append(np.where(np.eye(3, dtype=bool), stay[:, None], ((1 - stay) / 2)[:, None]))
        return means, variances, moves


class SwitchingAR:
    """Three regimes of y_t = c + phi y_{t-1} + e with their own c, phi and variance, by EM with weighted least squares."""

    def __init__(self, k: int = 3, rounds: int = 80, tol: float = 1e-6, least_rows: int = 200, own_rows: int = 500):
        self.k, self.rounds, self.tol, self.least_rows, self.own_rows = k, rounds, tol, least_rows, own_rows
        self.beta = None

    @staticmethod
    def design(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return y[1:], np.column_stack([np.ones(len(y) - 1), y[:-1]])

    def logs(self, t: np.ndarray, z: np.ndarray) -> np.ndarray:
        gap = t[:, None] - z @ self.beta.T
        return -0.5 * (np.log(2 * math.pi * self.var) + gap * gap / self.var)

    def fit(self, y: np.ndarray) -> SwitchingAR:
        y = np.asarray(y, dtype=float)
        y = y[np.isfinite(y)]
        if len(y) < self.least_rows:
            return self
        t, z = self.design(y)
        if self.beta is None:
            self.beta = np.column_stack([np.quantile(t, [0.2, 0.5, 0.8]), np.zeros(self.k)])
            self.var = np.maximum(t.var() * np.array([1.6, 0.5, 1.0]), 1e-12)
            self.move, self.start = sticky(self.k, 0.95), np.full(self.k, 1 / self.k)
        before = -np.inf
        for _ in range(self.rounds):
            emit, base = scaled(self.logs(t, z)[None])
            alpha, beta, ll = chain_passes(emit, self.move[None], self.start[None])
            now = float((ll + base)[0])
            if not np.isfinite(now):
                self.beta = self.var = self.move = self.start = None  # a failed fit leaves no model
                return self
            post = alpha[0] * beta[0]
            post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
            ahead = emit[0, 1:] * beta[0, 1:]
            norm = np.maximum(((alpha[0, :-1] @ self.move) * ahead).sum(axis=1, keepdims=True), 1e-300)
            pairs = self.move * ((alpha[0, :-1] / norm).T @ ahead)
            self.move = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1e-300)
            self.start = post[0]
            for s in range(self.k):
                w = post[:, s]
                a = (z * w[:, None]).T @ z + 1e-10 * np.eye(2) * max(w.sum(), 1e-12)
                self.beta[s] = np.linalg.solve(a, (z * w[:, None]).T @ t)
                self.var[s] = max((w * (t - z @ self.beta[s]) ** 2).sum() / max(w.sum(), 1e-12), 1e-10)
            if abs(now - before) < self.tol * max(1.0, abs(before)):
                break
            before = now
        order = np.argsort(self.beta[:, 0], kind="stable")
        self.beta, self.var, self.start = self.beta[order], self.var[order], self.start[order]
        self.move = self.move[np.ix_(order, order)]
        return self

    def filtered(self, y: np.ndarray) -> np.ndarray:
        """Posteriors, none under 50 pairs of rows; an unfitted model learns from its first rows, or stays empty if there are too few."""
        y = np.asarray(y, dtype=float)
        out = np.full((len(y), self.k), np.nan)
        ok = np.flatnonzero(np.isfinite(y))
        if len(ok) < 51:
            return out
        if self.beta is None:
            if len(ok) < self.own_rows:
                return out
            self.fit(y[ok[: self.own_rows + 1]])
            if self.beta is None:
                return out
        t, z = self.design(y[ok])
        emit, _ = scaled(self.logs(t, z)[None])
        out[ok[1:]] = chain_passes(emit, self.move[None], self.start[None], backward=False)[0][0]
        return out
