"""Regressions over small matrices: what is left after the panel has been aggregated or cut to one entity."""

from __future__ import annotations

import math

import numpy as np

from tideframe.functions.inference import chi2_sf, normal_cdf, two_sided


def var_ols(y: np.ndarray, lags: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients lags x k x k, residual covariance) of a vector autoregression with a constant."""
    n, k = y.shape
    x = np.column_stack([np.ones(n - lags), *[y[lags - i : n - i] for i in range(1, lags + 1)]])
    b = np.linalg.lstsq(x, y[lags:], rcond=None)[0]
    e = y[lags:] - x @ b
    return b[1:].reshape(lags, k, k).transpose(0, 2, 1), e.T @ e / max(1, len(e) - x.shape[1])


def ma_coefficients(coefs: np.ndarray, horizon: int) -> np.ndarray:
    p, k, _ = coefs.shape
    out = np.zeros((horizon, k, k))
    out[0] = np.eye(k)
    for h in range(1, horizon):
        out[h] = sum(coefs[i] @ out[h - 1 - i] for i in range(min(p, h)))
    return out


def generalized_fevd(coefs: np.ndarray, sigma: np.ndarray, horizon: int = 10) -> np.ndarray:
    """Generalised forecast-error variance decomposition, rows scaled to sum to 1."""
    psi = ma_coefficients(coefs, horizon)
    top = sum((m @ sigma) ** 2 for m in psi) / np.diag(sigma)[None, :]
    table = top / sum(np.diag(m @ sigma @ m.T) for m in psi)[:, None]
    return table / table.sum(1, keepdims=True)


def connectedness(y: np.ndarray, lags: int = 1, horizon: int = 10) -> dict:
    """Total, directional and net spillovers of a system."""
    t = generalized_fevd(*var_ols(y, lags), horizon)
    off = t - np.diag(np.diag(t))
    frm, to = off.sum(1), off.sum(0)
    return {"table": t, "total": 100 * float(off.sum() / len(t)), "from": 100 * frm, "to": 100 * to, "net": 100 * (to - frm)}


# --- selection of controls ------------------------------------------------------------------------------------------------------------------------


def lasso(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, rounds: int = 2000, tol: float = 1e-9) -> np.ndarray:
    """Coordinate descent for ||y - xb||^2 / (2n) + sum penalty |b|."""
    n, p = x.shape
    norm = (x * x).sum(0) / n
    b, r = np.zeros(p), y.astype(float).copy()
    for _ in range(rounds):
        step = 0.0
        for j in range(p):
            if norm[j] == 0:
                continue
            old = b[j]
            z = x[:, j] @ r / n + norm[j] * old
            b[j] = math.copysign(max(abs(z) - penalty[j], 0.0), z) / norm[j]
            if b[j] != old:
                r -= x[:, j] * (b[j] - old)
                step = max(step, abs(b[j] - old))
        if step < tol:
            break
    return b


def rigorous_lasso(x: np.ndarray, y: np.ndarray, c: float = 1.1, gamma: float | None = None, rounds: int = 3) -> np.ndarray:
    """Penalty from the data: loadings are the deviations of x times the residual, refitted a few times."""
    from tideframe.functions.kernels import normal_quantile

    n, p = x.shape
    gamma = gamma or 0.1 / math.log(max(n, 3))
    level = c / math.sqrt(n) * float(normal_quantile(np.array([1 - gamma / (2 * p)]))[0])
    e, b = y - y.mean(), np.zeros(p)
    for _ in range(rounds):
        b = lasso(x, y, level * np.sqrt(((x * e[:, None]) ** 2).mean(0)))
        e = y - post_ols(x, y, np.flatnonzero(b))
    return b


def post_ols(x: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Fitted values of least squares on the chosen columns and a constant."""
    a = np.column_stack((np.ones(len(y)), x[:, chosen]))
    return a @ np.linalg.lstsq(a, y, rcond=None)[0]


def _effect(y: np.ndarray, d: np.ndarray) -> dict:
    theta = float(d @ y / (d @ d))
    psi = d * (y - theta * d)
    se = math.sqrt(float(psi @ psi)) / float(d @ d)
    return {"theta": theta, "std_error": se, "tstat": theta / se, "pvalue": two_sided(theta / se)}


def post_double_selection(y: np.ndarray, d: np.ndarray, x: np.ndarray) -> dict:
    """Effect of d on y with the controls that matter for either."""
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    chosen = np.flatnonzero((rigorous_lasso(z, y - y.mean()) != 0) | (rigorous_lasso(z, d - d.mean()) != 0))
    return _effect(y - post_ols(z, y, chosen), d - post_ols(z, d, chosen)) | {"selected": chosen.tolist()}


def double_ml(y: np.ndarray, d: np.ndarray, x: np.ndarray, folds: int = 5, horizon: int = 0) -> dict:
    """Cross-fitted partially linear model over blocks of time, with ``horizon`` rows left out around each."""
    n = len(y)
    z = np.column_stack((np.ones(n), x))
    ry, rd = np.empty(n), np.empty(n)
    for block in np.array_split(np.arange(n), folds):
        train = np.ones(n, bool)
        train[max(0, block[0] - horizon) : block[-1] + horizon + 1] = False
        for out, v in ((ry, y), (rd, d)):
            out[block] = v[block] - z[block] @ np.linalg.lstsq(z[train], v[train], rcond=None)[0]
    return _effect(ry, rd)


# --- predictive regressions and unit roots ------------------------------------------------------------------------------------------------------------


def ivx(y: np.ndarray, x: np.ndarray, delta: float = 0.95, c_z: float = 1.0) -> dict:
    """Wald test of a persistent predictor with a mildly integrated instrument built from its differences."""
    n = len(y) - 1
    rho = 1 - c_z / n**delta
    dx = np.diff(x)
    z = np.zeros(n)
    for t in range(1, n):
        z[t] = rho * z[t - 1] + dx[t - 1]
    yt, xt = y[1:] - y[1:].mean(), x[:-1] - x[:-1].mean()
    beta = float(z @ yt / (z @ xt))
    e = yt - float(xt @ yt / (xt @ xt)) * xt
    w = beta**2 * float(z @ xt) ** 2 / (float(e @ e / n) * float(z @ z))
    return {"beta": beta, "wald": float(w), "pvalue": chi2_sf(w, 1)}


def panel_unit_root(stats: np.ndarray, n: int, simulate, reps: int = 400, seed: int = 0) -> tuple[float, float]:
    """(z, p) of the mean of the entities' Dickey-Fuller statistics, standardised by simulated random walks of the length."""
    rng = np.random.default_rng(seed)
    null = np.array([simulate(np.cumsum(rng.normal(size=n))) for _ in range(reps)])
    null = null[np.isfinite(null)]
    z = math.sqrt(len(stats)) * (np.mean(stats) - null.mean()) / null.std(ddof=1)
    return float(z), normal_cdf(z)


def causal_decompose(x: np.ndarray, period: int, trend: int | None = None, cycles: int = 4, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, remainder) from trailing means alone: nothing reads a later value."""
    x = np.asarray(x, float)
    n, trend = len(x), trend or 2 * period + 1

    def trailing(v, w):
        c = np.concatenate(([0.0], np.cumsum(v)))
        i = np.arange(1, n + 1)
        return (c[i] - c[np.maximum(i - w, 0)]) / np.minimum(i, w)

    s, at = np.zeros(n), np.arange(n)
    t = trailing(x, trend)
    for _ in range(rounds):
        t = trailing(x - s, trend)
        d = x - t
        s = sum((d[np.maximum(at - k * period, 0)] * (at >= k * period) for k in range(cycles - 1, -1, -1)), np.zeros(n)) / np.minimum(at // period + 1, cycles)
        s = s - trailing(s, period)
    return t, s, x - t - s
