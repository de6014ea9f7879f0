"""Selection among candidates of a search, and the honest account of how many were tried: NumPy over scores, not over rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from tideframe.functions.inference import expected_maximum_sharpe, normal_cdf

# --- several objectives, all to be maximised ---------------------------------------------------------------------------------------


def _dominates(points: np.ndarray) -> np.ndarray:
    """[i, j]: i is nowhere worse than j and somewhere better."""
    a, b = points[:, None, :], points[None, :, :]
    return (a >= b).all(axis=2) & (a > b).any(axis=2)


def fast_non_dominated_sort(points) -> list[list[int]]:
    """Fronts of a (candidates, objectives) array, the best first."""
    beats = _dominates(np.asarray(points, float))
    rest, out = np.arange(len(beats)), []
    while len(rest):
        free = ~beats[np.ix_(rest, rest)].any(axis=0)
        out.append(rest[free].tolist())
        rest = rest[~free]
    return out


def pareto_front(points) -> list[int]:
    return fast_non_dominated_sort(points)[0] if len(points) else []


def crowding_distance(points) -> np.ndarray:
    """For each point the sum over objectives of the gap between its neighbours, in parts of the range; the ends are infinite."""
    x = np.asarray(points, float)
    out = np.zeros(len(x))
    for column in x.T:
        order = np.argsort(column, kind="stable")
        s = column[order]
        span = s[-1] - s[0] if len(s) else 0
        gap = np.full(len(s), np.inf)
        if span > 0 and len(s) > 2:
            gap[1:-1] = (s[2:] - s[:-2]) / span
        elif len(s) > 2:
            gap[1:-1] = 0
        out[order] += gap
    return out


def nsga2_survival(points, size: int) -> list[int]:
    """The survivors: whole fronts while they fit, and of the next one the least crowded."""
    x, out = np.asarray(points, float), []
    for front in fast_non_dominated_sort(x):
        if len(out) + len(front) > size:
            near = crowding_distance(x[front])
            front = [front[i] for i in np.argsort(-near, kind="stable")[: size - len(out)]]
        out += front
        if len(out) >= size:
            break
    return out


def age_fitness_pareto_survival(scores, ages, size: int) -> list[int]:
    """Survivors by score and youth at once, so that young lines are not driven out by old ones."""
    return nsga2_survival(np.column_stack([np.asarray(scores, float), -np.asarray(ages, float)]), size)


# --- parents ------------------------------------------------------------------------------------------------------------------------


def tournament(scores, rng: np.random.Generator, size: int = 3) -> int:
    """The best of ``size`` candidates drawn with replacement."""
    drawn = rng.integers(0, len(scores), size)
    return int(drawn[np.argmax(np.asarray(scores, float)[drawn])])


@dataclass(frozen=True)
class LexicaseDiagnostics:
    chosen: int
    cases_used: int
    tied: int


def eps_lexicase_with_diagnostics(cases, rng: np.random.Generator, eps: np.ndarray | float | None = None) -> LexicaseDiagnostics:
    """One parent of a (candidates, cases) matrix: cases in random order each leave those within eps of the best.

    Without ``eps`` it is each case's median absolute deviation. NaN is the worst score.
    """
    x = np.where(np.isnan(cases), -np.inf, np.asarray(cases, float))
    if eps is None:
        finite = np.where(np.isfinite(x), x, np.nan)
        with np.errstate(all="ignore"):
            centre = np.nanmedian(finite, axis=0) if len(x) else np.zeros(x.shape[1])
            eps = np.nan_to_num(np.nanmedian(np.abs(finite - centre), axis=0))
    eps = np.broadcast_to(np.asarray(eps, float), x.shape[1:])
    left, used = np.arange(len(x)), 0
    for c in rng.permutation(x.shape[1]):
        if len(left) == 1:
            break
        best = x[left, c].max()
        left, used = (left[x[left, c] >= best - eps[c]] if best > -np.inf else left), used + 1
    return LexicaseDiagnostics(int(rng.choice(left)), used, len(left))


def eps_lexicase(cases, rng: np.random.Generator, eps: np.ndarray | float | None = None) -> int:
    return eps_lexicase_with_diagnostics(cases, rng, eps).chosen


def lexicase(cases, rng: np.random.Generator) -> int:
    return eps_lexicase(cases, rng, 0.0)


# --- quality and diversity ---------------------------------------------------------------------------------------------------------


class Archive:
    """The best candidate of each cell of a grid over descriptors; ``edges`` cut each descriptor into its cells."""

    def __init__(self, edges: Sequence[Sequence[float]]) -> None:
        self.thresholds = [np.asarray(e, float) for e in edges]
        self._held: dict[tuple[int, ...], tuple[float, object]] = {}
        self.n_added = self.n_accepted = 0

    @property
    def n_cells(self) -> int:
        return math.prod(len(e) + 1 for e in self.thresholds)

    def cell_of(self, descriptors) -> tuple[int, ...]:
        return tuple(int(np.searchsorted(e, d, side="right")) for e, d in zip(self.thresholds, descriptors, strict=True))

    def add(self, candidate, score: float, descriptors) -> bool:
        """Whether the candidate took its cell. Scores that are no numbers are refused."""
        self.n_added += 1
        cell = self.cell_of(descriptors)
        if not math.isfinite(score) or (cell in self._held and self._held[cell][0] >= score):
            return False
        self._held[cell] = (float(score), candidate)
        self.n_accepted += 1
        return True

    def elites(self) -> list:
        return [c for _, c in (self._held[k] for k in sorted(self._held))]

    def best(self):
        return max(self._held.values(), key=lambda x: x[0])[1] if self._held else None

    def qd_score(self) -> float:
        return sum(s for s, _ in self._held.values())

    @property
    def coverage(self) -> float:
        return len(self._held) / self.n_cells

    def to_records(self) -> list[dict]:
        return [{"cell": k, "score": self._held[k][0], "candidate": self._held[k][1]} for k in sorted(self._held)]


# --- how much was tried ------------------------------------------------------------------------------------------------------------


def minimum_backtest_length(trials: int, target: float = 1.0) -> float:
    """Years of returns under which the best of so many worthless trials is expected to reach the yearly Sharpe ratio ``target``."""
    return (expected_maximum_sharpe(trials, 1.0) / target) ** 2 if trials > 1 else 0.0


def significance_hurdle(trials: int, alpha: float = 0.05) -> float:
    """Smallest |t| that stays significant at ``alpha`` after so many independent trials (Sidak)."""
    each = 1 - (1 - alpha) ** (1 / max(trials, 1))
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 2 * (1 - normal_cdf(mid)) > each else (lo, mid)
    return hi


def haircut_sharpe_ratio(sharpe: float, observations: int, trials: int, method: str = "bonferroni") -> float:
    """The Sharpe ratio (per period) that one single trial would need for the p-value that remains after ``trials``."""
    p = 2 * (1 - normal_cdf(abs(sharpe) * math.sqrt(observations)))
    p = min(1.0, p * trials) if method == "bonferroni" else 1 - (1 - p) ** trials
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 2 * (1 - normal_cdf(mid)) > p else (lo, mid)
    return math.copysign(hi if p < 1 else 0.0, sharpe) / math.sqrt(observations)


@dataclass
class TrialLedger:
    """Every candidate that a search evaluated. All scores are kept; of the series a uniform sample of at most ``reservoir``."""

    reservoir: int = 2000
    seed: int = 0
    _scores: list[float] = field(default_factory=list)
    _held_out: list[float] = field(default_factory=list)
    _keys: list = field(default_factory=list)
    _sample: list[np.ndarray] = field(default_factory=list)
    _best: tuple = (-math.inf, None, None)
    _seen: int = 0

    def __post_init__(self) -> None:
        self._rng = np.random.default_rng(self.seed)

    def record(self, key, score: float, series=None, held_out: float = math.nan) -> None:
        self._keys.append(key)
        self._scores.append(float(score))
        self._held_out.append(float(held_out))
        series = None if series is None else np.asarray(series, float)
        if score > self._best[0]:
            self._best = (float(score), key, series)
        if series is not None:
            self._seen += 1
            if len(self._sample) < self.reservoir:
                self._sample.append(series)
            elif (at := int(self._rng.integers(0, self._seen))) < self.reservoir:
                self._sample[at] = series

    @property
    def n_trials(self) -> int:
        return len(self._scores)

    @property
    def scores(self) -> np.ndarray:
        return np.array(self._scores)

    @property
    def held_out(self) -> np.ndarray:
        return np.array(self._held_out)

    @property
    def score_variance(self) -> float:
        return float(np.var(self._scores, ddof=1)) if self.n_trials > 1 else math.nan

    @property
    def best_score(self) -> float:
        return self._best[0]

    @property
    def best_key(self):
        return self._best[1]

    @property
    def best_series(self):
        return self._best[2]

    def correlation_matrix(self) -> np.ndarray:
        """Of the sampled series' periods; a constant series correlates with nothing."""
        with np.errstate(all="ignore"):
            c = np.nan_to_num(np.corrcoef(np.stack(self._sample))) if len(self._sample) > 1 else np.ones((len(self._sample),) * 2)
        c = np.atleast_2d(c)
        np.fill_diagonal(c, 1.0)
        return c

    def mean_pairwise_correlation(self) -> float:
        c = self.correlation_matrix()
        n = len(c)
        return float((c.sum() - n) / (n * (n - 1))) if n > 1 else math.nan

    def implied_independent_trials(self) -> float:
        """rho + (1 - rho) * trials: from all alike (one) to all independent."""
        if self.n_trials < 2 or len(self._sample) < 2:
            return float(self.n_trials)
        rho = min(1.0, max(0.0, self.mean_pairwise_correlation()))
        return rho + (1 - rho) * self.n_trials

    def effective_trials_pca(self, share: float = 0.95) -> int:
        """Principal components of the correlations that explain so much of the variance."""
        values = np.sort(np.clip(np.linalg.eigvalsh(self.correlation_matrix()), 0, None))[::-1] if self._sample else np.zeros(0)
        return int(np.searchsorted(np.cumsum(values), share * values.sum() - 1e-12) + 1) if len(values) else 0

    def summary(self) -> dict:
        return {"n_trials": self.n_trials, "best_key": self.best_key, "best_score": self.best_score, "score_variance": self.score_variance, "independent_trials": self.implied_independent_trials()}


class AlphaPool:
    """A bounded pool of signals combined by least squares: ``ic`` with the target and ``mutual`` with each other."""

    def __init__(self, max_size: int = 50, ridge: float = 1e-8) -> None:
        self.max_size, self.ridge = max_size, ridge
        self.reset()

    def reset(self) -> None:
        self.names: list = []
        self._ic, self._mutual = np.zeros(0), np.zeros((0, 0))

    def single_ic(self) -> np.ndarray:
        return self._ic.copy()

    def mutual_ic(self) -> np.ndarray:
        return self._mutual.copy()

    def weights(self) -> np.ndarray:
        return np.linalg.solve(self._mutual + self.ridge * np.eye(len(self._ic)), self._ic) if len(self._ic) else np.zeros(0)

    def loss(self, w=None) -> float:
        """Squared error of the combination for standardised signals: 1 - 2 w'c + w'Mw."""
        w = self.weights() if w is None else np.asarray(w, float)
        return float(1 - 2 * w @ self._ic + w @ self._mutual @ w)

    def score(self) -> float:
        return 1 - self.loss()

    def _with(self, ic: float, mutual) -> AlphaPool:
        new = AlphaPool(self.max_size, self.ridge)
        k = len(self._ic)
        m = np.zeros(k) if mutual is None else np.asarray(mutual, float)
        new.names, new._ic = list(self.names), np.append(self._ic, ic)
        new._mutual = np.block([[self._mutual, m[:, None]], [m[None, :], np.ones((1, 1))]])
        return new

    def marginal_contribution(self, ic: float, mutual=None) -> float:
        """What the score gains if a signal with that IC and those correlations with the members comes in."""
        return self._with(ic, mutual).score() - self.score()

    def add(self, ic: float, mutual=None, name=None) -> int | None:
        """Takes the signal in; the place of the member that had to go if the pool was full, the one of least weight."""
        new = self._with(ic, mutual)
        new.names.append(name)
        gone = None
        if len(new._ic) > self.max_size:
            gone = int(np.argmin(np.abs(new.weights())))
            keep = [i for i in range(len(new._ic)) if i != gone]
            new._ic, new._mutual, new.names = new._ic[keep], new._mutual[np.ix_(keep, keep)], [new.names[i] for i in keep]
        self.names, self._ic, self._mutual = new.names, new._ic, new._mutual
        return gone


def search_diagnostics(ledger: TrialLedger, objective: Callable[[np.ndarray], float] = np.mean) -> dict:
    """The ledger's summary, with how much of the best scores was left on held-out data."""
    held = ledger.held_out
    both = np.isfinite(held) & np.isfinite(ledger.scores)
    out = ledger.summary()
    out["held_out_mean"] = float(objective(held[both])) if both.any() else math.nan
    out["shrinkage"] = float(1 - np.mean(held[both]) / np.mean(ledger.scores[both])) if both.any() and np.mean(ledger.scores[both]) else math.nan
    return out
