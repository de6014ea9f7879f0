"""The 22 canonical time-series characteristics (and mean and deviation), after their published definitions."""

from __future__ import annotations

import bisect
import math

import numpy as np


def _z(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    s = x.std(ddof=1) if len(x) > 1 else 0.0
    return (x - x.mean()) / s if s > 0 else x - x.mean()


def _acf(x: np.ndarray) -> np.ndarray:
    n = len(x)
    f = np.fft.rfft(x - x.mean(), 1 << (2 * n - 1).bit_length())
    c = np.fft.irfft(f * np.conj(f))[:n]
    return c / c[0] if c[0] > 0 else np.zeros(n)


def _first(cond: np.ndarray, default: float) -> float:
    i = np.flatnonzero(cond)
    return float(i[0]) if len(i) else default


def histogram_mode(z: np.ndarray, bins: int) -> float:
    lo, hi = z.min(), z.max()
    if hi == lo:
        return float(lo)
    edges = np.linspace(lo, hi, bins + 1)
    n = np.bincount(np.minimum(((z - lo) / (hi - lo) * bins).astype(int), bins - 1), minlength=bins)
    best = np.flatnonzero(n == n.max())
    return float(((edges[:-1] + edges[1:]) / 2)[best].mean())


def acf_first_1e(z: np.ndarray) -> float:
    a, e = _acf(z), 1 / math.e
    k = np.flatnonzero(a < e)
    if not len(k) or k[0] == 0:
        return float(len(z))
    i = int(k[0])
    return i - 1 + (e - a[i - 1]) / (a[i] - a[i - 1])


def acf_first_min(z: np.ndarray) -> float:
    a = _acf(z)
    return _first((a[1:-1] < a[:-2]) & (a[1:-1] < a[2:]), len(z) - 1.0) + 1 if len(z) > 2 else float(len(z))


def histogram_ami(z: np.ndarray, lag: int = 2, bins: int = 5) -> float:
    lo, hi = z.min() - 0.1, z.max() + 0.1
    b = np.minimum(((z - lo) / (hi - lo) * bins).astype(int), bins - 1)
    p = np.histogram2d(b[:-lag], b[lag:], bins=bins, range=((0, bins), (0, bins)))[0]
    p /= p.sum()
    q = p.sum(1)[:, None] * p.sum(0)[None, :]
    ok = p > 0
    return float((p[ok] * np.log(p[ok] / q[ok])).sum())


def gaussian_ami_first_min(z: np.ndarray, most: int = 40) -> float:
    most = min(most, math.ceil(len(z) / 2))
    ami = []
    for k in range(1, most + 1):
        r = np.corrcoef(z[:-k], z[k:])[0, 1] if len(z) - k > 1 else 0.0
        ami.append(-0.5 * math.log(max(1e-12, 1 - r * r)))
        if k > 2 and ami[-2] < ami[-3] and ami[-2] < ami[-1]:
            return float(k - 2)
    return float(most)


def trev(z: np.ndarray) -> float:
    return float((np.diff(z) ** 3).mean())


def pnn40(z: np.ndarray) -> float:
    return float((np.abs(np.diff(z)) * 1000 > 40).mean())


def longest_run(b: np.ndarray) -> float:
    best = run = 0
    for v in b:
        run = run + 1 if v else 0
        best = max(best, run)
    return float(best)


def motif_three(z: np.ndarray) -> float:
    s = _coarse(z, 3)
    p = np.bincount(s[:-1] * 3 + s[1:], minlength=9) / (len(s) - 1)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def _coarse(z: np.ndarray, groups: int) -> np.ndarray:
    q = np.quantile(z, np.linspace(0, 1, groups + 1)[1:-1])
    return np.searchsorted(q, z, side="left")


def transition_matrix(z: np.ndarray) -> float:
    tau = max(1, int(_first(_acf(z) <= 0, len(z))))
    s = _coarse(z[::tau], 3)
    if len(s) < 2:
        return math.nan
    t = np.zeros((3, 3))
    np.add.at(t, (s[:-1], s[1:]), 1)
    return float(np.trace(np.cov(t / (len(s) - 1), rowvar=False, ddof=1)))


def periodicity_wang(z: np.ndarray, threshold: float = 0.01) -> float:
    """First peak of the autocorrelation that stands out from the trough before it, after a spline-like detrend."""
    n = len(z)
    t = np.linspace(-1, 1, n)
    knots = [np.maximum(t - k, 0) ** 3 for k in (-1 / 3, 1 / 3)]
    a = np.column_stack([t**k for k in range(4)] + knots)
    y = z - a @ np.linalg.lstsq(a, z, rcond=None)[0]
    most = math.ceil(n / 3)
    f = np.fft.rfft(y, 1 << (2 * n - 1).bit_length())
    c = np.fft.irfft(f * np.conj(f))[1 : most + 1] / (n - np.arange(1, most + 1))
    troughs = [i for i in range(1, most - 1) if c[i] < c[i - 1] and c[i] < c[i + 1]]
    for i in range(1, most - 1):
        if c[i] > c[i - 1] and c[i] > c[i + 1]:
            before = [k for k in troughs if k < i]
            if before and c[i] - c[before[-1]] >= threshold and c[i] >= 0:
                return float(i + 1)
    return 0.0


def embed2_expfit(z: np.ndarray) -> float:
    """Mean distance of the histogram of successive distances, in a two-dimensional embedding, from a fitted exponential."""
    tau = max(1, int(_first(_acf(z) <= 0, len(z))))
    tau = min(tau, max(1, len(z) // 10))
    d = np.hypot(z[1 : len(z) - tau] - z[: len(z) - tau - 1], z[1 + tau :] - z[tau:-1])
    rate = d.mean()
    width = 3.5 * d.std(ddof=1) / len(d) ** (1 / 3) if len(d) > 1 else 0
    bins = max(1, math.ceil((d.max() - d.min()) / width)) if width > 0 else 1
    n, edges = np.histogram(d, bins=bins)
    mid = (edges[:-1] + edges[1:]) / 2
    return float(np.abs(n / len(d) - np.exp(-mid / rate) / rate).mean()) if rate > 0 else math.nan


def local_simple_tau_ratio(z: np.ndarray) -> float:
    zero = lambda v: _first(_acf(v) <= 0, float(len(v)))
    return zero(np.diff(z)) / max(1.0, zero(z))


def local_simple_stderr(z: np.ndarray, window: int = 3) -> float:
    m = np.convolve(z, np.ones(window) / window, "valid")[:-1]
    return float((z[window:] - m).std(ddof=1))


def outlier_timing(z: np.ndarray, sign: int) -> float:
    """Median position of the values above rising thresholds, from -1 to 1, over the thresholds with enough values left."""
    y = z * sign
    n, out = len(y), []
    if (y == y[0]).all():
        return 0.0
    levels = np.arange(0, y.max() + 1e-12, 0.01)
    total = (y >= 0).sum()
    order = np.argsort(-y, kind="stable")  # the values above a level are the first of these
    counts = np.searchsorted(-y[order], -levels, side="right")
    last = np.flatnonzero((counts < 2) | (100 * (counts - 1) / total <= 2))
    counts = counts[: last[0]] if len(last) else counts
    medians = {}
    places = sorted(order[: counts[0]].tolist()) if len(counts) else []
    for c, more in zip(counts, np.append(counts[1:], -1), strict=False):  # levels rise: values fall out
        if c not in medians:
            m = len(places)
            medians[c] = (places[(m - 1) // 2] + places[m // 2]) / 2
        for gone in order[max(more, 0) : c] if more >= 0 else ():
            del places[bisect.bisect_left(places, gone)]
        out.append(medians[c] / (n / 2) - 1 + 1 / (n / 2))
    return float(np.median(out)) if out else 0.0


def _rect_welch(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << (len(z) - 1).bit_length()
    f = np.fft.rfft(z - z.mean(), n)
    p = np.abs(f) ** 2 / len(z) / (2 * np.pi)
    p[1:-1] *= 2
    return 2 * np.pi * np.arange(len(p)) / n, p


def welch_area(z: np.ndarray) -> float:
    w, p = _rect_welch(z)
    return float(p[: len(p) // 5].sum() * (w[1] - w[0]))


def welch_centroid(z: np.ndarray) -> float:
    w, p = _rect_welch(z)
    c = np.cumsum(p)
    return float(w[np.flatnonzero(c > c[-1] / 2)[0]]) if c[-1] > 0 else 0.0


def fluctuation(z: np.ndarray, dfa: bool, lag: int = 1) -> float:
    """Part of the scales in the first of the two regimes that fit the fluctuations of the profile best."""
    y = np.cumsum(z[:: 2 if dfa else 1]) if dfa else np.cumsum(z)
    n = len(y)
    scales = np.unique(np.round(np.exp(np.linspace(math.log(5), math.log(max(6, n // 2)), 50))).astype(int))
    if len(scales) < 12:
        return 0.0
    f = []
    for s in scales:
        part = y[: n // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        rest = part - part.mean(axis=1, keepdims=True)
        rest -= np.outer(rest @ t / (t @ t), t)
        f.append(math.sqrt((rest**2).mean()) if dfa else math.sqrt(((rest.max(1) - rest.min(1)) ** 2).mean()))
    x, v = np.log(scales), np.log(np.maximum(f, 1e-300))

    if (v == v[0]).all():  # no fluctuation at any scale: nothing to fit
        return 0.0
    least = 6
    one, sx, sy, sxx, sxy, syy = (np.concatenate(([0.0], np.cumsum(q))) for q in (np.ones(len(x)), x - x.mean(), v - v.mean(), (x - x.mean()) ** 2, (x - x.mean()) * (v - v.mean()), (v - v.mean()) ** 2))

    def error(lo, hi):
        n, a, b, aa, ab, bb = (q[hi] - q[lo] for q in (one, sx, sy, sxx, sxy, syy))
        xx, xy, yy = aa - a * a / n, ab - a * b / n, bb - b * b / n
        return np.sqrt(np.maximum(yy - xy * xy / xx, 0))

    i = np.arange(least - 1, len(x) - least + 1)
    fit = error(0, i + 1) + error(i, len(x))
    return float((int(np.argmin(fit)) + least) / len(x))


FEATURES = {
    "DN_HistogramMode_5": lambda z: histogram_mode(z, 5),
    "DN_HistogramMode_10": lambda z: histogram_mode(z, 10),
    "CO_f1ecac": acf_first_1e,
    "CO_FirstMin_ac": acf_first_min,
    "CO_HistogramAMI_even_2_5": histogram_ami,
    "CO_trev_1_num": trev,
    "MD_hrv_classic_pnn40": pnn40,
    "SB_BinaryStats_mean_longstretch1": lambda z: longest_run(z[:-1] > z.mean()),
    "SB_BinaryStats_diff_longstretch0": lambda z: longest_run(np.diff(z) < 0),
    "SB_TransitionMatrix_3ac_sumdiagcov": transition_matrix,
    "PD_PeriodicityWang_th0_01": periodicity_wang,
    "CO_Embed2_Dist_tau_d_expfit_meandiff": embed2_expfit,
    "IN_AutoMutualInfoStats_40_gaussian_fmmi": gaussian_ami_first_min,
    "FC_LocalSimple_mean1_tauresrat": local_simple_tau_ratio,
    "DN_OutlierInclude_p_001_mdrmd": lambda z: outlier_timing(z, 1),
    "DN_OutlierInclude_n_001_mdrmd": lambda z: outlier_timing(z, -1),
    "SP_Summaries_welch_rect_area_5_1": welch_area,
    "SB_MotifThree_quantile_hh": motif_three,
    "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": lambda z: fluctuation(z, False),
    "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": lambda z: fluctuation(z, True),
    "SP_Summaries_welch_rect_centroid": welch_centroid,
    "FC_LocalSimple_mean3_stderr": local_simple_stderr,
}


def catch22_all(x: np.ndarray, catch24: bool = False, names=None) -> dict[str, float]:
    """All features (or those named) of one series, z-scored first; NaN where a series is too short for one."""
    x = np.asarray(x, float)
    x, out = x[np.isfinite(x)], {}
    z = _z(x)
    for k in names or FEATURES:
        try:
            out[k] = float(FEATURES[k](z)) if len(z) > 3 else math.nan
        except (ValueError, IndexError, np.linalg.LinAlgError):
            out[k] = math.nan
    if catch24:
        out |= {"DN_Mean": float(x.mean()) if len(x) else math.nan, "DN_Spread_Std": float(x.std(ddof=1)) if len(x) > 1 else math.nan}
    return out
