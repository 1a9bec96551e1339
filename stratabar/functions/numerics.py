"""Small numerical routines that the grouped estimators share."""

from __future__ import annotations

import math

import numpy as np


def two_sided_p(t: float) -> float:
    """p value of a standard normal statistic."""
    return math.erfc(abs(t) / math.sqrt(2)) if t == t else float("nan")


def logistic_fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and, last, intercept minimising |w|^2 / 2 + strength * log loss, by Newton steps with halving."""
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.ones(x.shape[1]), 0.0)
    theta = np.zeros(z.shape[1])

    def loss(th):
        m = z @ th
        return 0.5 * (ridge * th * th).sum() + strength * (np.logaddexp(0, m) - y * m).sum()

    now = loss(theta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -500, 500)))
        grad = ridge * theta + strength * z.T @ (p - y)
        hess = np.diag(ridge + 1e-12) + strength * (z * (p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(hess, grad)
        scale = 1.0
        while scale > 1e-6 and loss(theta - scale * step) > now:
            scale /= 2
        theta = theta - scale * step
        new = loss(theta)
        if now - new < 1e-12 * max(1.0, abs(now)):
            break
        now = new
    return theta


def split_folds(n: int, splits: int, gap: int) -> list[tuple[int, int, int]]:
    """(train end, test start, test stop): later and later test blocks, each trained on all rows up to ``gap`` before it."""
    size = n // (splits + 1)
    return [(start - gap, start, start + size) for start in range(n - splits * size, n, size)] if size else []


def forward_probabilities(x: np.ndarray, y: np.ndarray, splits: int = 5, gap: int = 5) -> np.ndarray:
    """Out-of-sample probabilities of y; nan before the first test block or where training knows one class."""
    out = np.full(len(y), np.nan)
    for end, start, stop in split_folds(len(y), splits, gap):
        if end < 2 or len(np.unique(y[:end])) < 2:
            continue
        mean, sd = x[:end].mean(axis=0), x[:end].std(axis=0)
        sd = np.where(sd > 0, sd, 1.0)
        theta = logistic_fit((x[:end] - mean) / sd, y[:end].astype(float))
        out[start:stop] = 1 / (1 + np.exp(-np.clip((x[start:stop] - mean) / sd @ theta[:-1] + theta[-1], -500, 500)))
    return out


def hac_t(d: np.ndarray, lag: int) -> float:
    """Mean over its Newey-West standard error (Bartlett weights)."""
    e = d - d.mean()
    n = len(e)
    v = e @ e / n + 2 * sum((1 - k / (lag + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lag + 1) if k < n)
    return float(d.mean() / math.sqrt(max(v, 1e-18) / n))


def simplex_search(f, start: np.ndarray, bounds: tuple[float, float], size: float = 0.7, steps: int = 60) -> np.ndarray:
    """Nelder and Mead's search with points held inside the bounds."""
    hold = lambda p: np.clip(p, *bounds)
    points = [hold(np.asarray(start, float))] + [hold(np.asarray(start, float) + size * e) for e in np.eye(len(start))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-7 * max(1.0, abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        tried = hold(centre + (centre - points[-1]))
        v = f(tried)
        if v < values[0]:
            far = hold(centre + 2 * (centre - points[-1]))
            fv = f(far)
            tried, v = (far, fv) if fv < v else (tried, v)
        elif v >= values[-2]:
            near = hold(centre + 0.5 * ((tried if v < values[-1] else points[-1]) - centre))
            nv = f(near)
            if nv >= min(v, values[-1]):
                points = [points[0]] + [hold(points[0] + 0.5 * (p - points[0])) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
            tried, v = near, nv
        points[-1], values[-1] = tried, v
    return points[int(np.argmin(values))]


def chain_passes(emit: np.ndarray, move: np.ndarray, start: np.ndarray, backward: bool = True):
    """Filtered and backward messages of hidden Markov chains, many at once.

    emit (R, n, K) are likelihoods scaled by row, move (R, K, K), start (R, K).
    Returns (alpha normalised by row, beta up to a factor a row, log likelihood
    less the emissions' own scale). Time is cut into about sqrt(n) blocks: the
    products of step matrices run in all blocks together, and only one vector
    a block is carried on, so the Python loop has about 2 sqrt(n) turns.
    """
    r, n, k = emit.shape
    first = np.maximum(start, 1e-100) * emit[:, 0]  # a state that training has emptied may still emit
    c0 = first.sum(axis=1)
    if n == 1:
        return (first / c0[:, None])[:, None], np.ones((r, 1, k)), np.log(c0)
    steps = n - 1
    size = int(math.ceil(math.sqrt(steps)))
    blocks = -(-steps // size)
    pad = blocks * size - steps
    lead = np.concatenate([emit[:, 1:], np.ones((r, pad, k))], axis=1).reshape(r, blocks, size, k)
    real = (np.arange(blocks * size) < steps).reshape(blocks, size)
    eye = np.eye(k)
    matrix = np.where(real[None, :, :, None, None], move[:, None, None] * lead[:, :, :, None, :], eye)

    prod = np.empty((r, blocks, size, k, k))
    scale = np.zeros((r, blocks, size))
    cur, log = matrix[:, :, 0], np.zeros((r, blocks))
    for j in range(size):
        if j:
            cur = cur @ matrix[:, :, j]
        top = np.maximum(cur.max(axis=(2, 3)), 1e-300)
        cur, log = cur / top[..., None, None], log + np.log(top)
        prod[:, :, j], scale[:, :, j] = cur, log
    into = np.empty((r, blocks, k))
    vec, total = first / c0[:, None], np.log(c0)
    for b in range(blocks):
        into[:, b] = vec
        vec = (vec[:, None] @ prod[:, b, -1])[:, 0]
        s = np.maximum(vec.sum(axis=1), 1e-300)
        vec, total = vec / s[:, None], total + np.log(s) + scale[:, b, -1]
    later = (into[:, :, None, None] @ prod)[:, :, :, 0].reshape(r, blocks * size, k)[:, :steps]
    alpha = np.concatenate([(first / c0[:, None])[:, None], later / np.maximum(later.sum(axis=2, keepdims=True), 1e-300)], axis=1)
    if not backward:
        return alpha, None, total
    suffix = np.empty((r, blocks, size, k, k))
    cur = np.broadcast_to(eye, (r, blocks, k, k)).copy()
    for j in reversed(range(size)):
        cur = matrix[:, :, j] @ cur
        cur = cur / np.maximum(cur.max(axis=(2, 3)), 1e-300)[..., None, None]
        suffix[:, :, j] = cur
    out_of = np.empty((r, blocks, k))
    vec = np.ones((r, k))
    for b in reversed(range(blocks)):
        out_of[:, b] = vec
        vec = (suffix[:, b, 0] @ vec[:, :, None])[:, :, 0]
        vec = vec / np.maximum(vec.max(axis=1, keepdims=True), 1e-300)
    beta = (suffix @ out_of[:, :, None, :, None])[..., 0].reshape(r, blocks * size, k)[:, :steps]
    return alpha, np.concatenate([beta, np.ones((r, 1, k))], axis=1), total
